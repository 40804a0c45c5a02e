"""Trials leave a study in the order of their ids, however they finish.

emit() is the streaming form: state per study is the next id and a bounded map of the finished
rows that wait for it; drained() holds back what is beyond the bound. The other functions answer the same questions over a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from stratamill.operators.ordered import islands, lag_within, numbered, running_max

#: Ids that are dealt to one task in ordered operations over a table.
BLOCK = 1 << 16


def projected(status: Column) -> tuple[Column, Column]:
    """(status, feasible) as the stream tells them: a violated constraint is a finished trial, every error a failed one."""
    return F.when(status.isin("ok", "constraint_violation"), "ok").when(status.isin("pruned", "partial"), status).otherwise("failed"), status == "ok"


#: The state store with single entries of a map (a fixed name).
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """State of a study: the next id, and a map of the finished rows up to `bound` ids beyond it.

    Entries are read at the start of a batch; one is written when its row comes and removed when it leaves, the others stay as they are.
    """

    def __init__(self, floor: int, bound: int):
        self.floor, self.bound = floor, bound

    def init(self, handle) -> None:
        self.following = handle.getValueState("following", "id bigint")
        self.waiting = handle.getMapState("waiting", "id bigint", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        following = self.following.get()[0] if self.following.exists() else self.floor
        before = {k[0]: v[0] for k, v in self.waiting.iterator()}  # `bound` entries at most
        here, out, pool = dict(before), [], []
        for batch in rows:
            pool += zip(batch["trial_id"].tolist(), batch["status"].tolist(), strict=True)
        for i, status in sorted(pool):
            while following in here:
                out.append((key[0], following, here.pop(following), "emitted"))
                following += 1
            if i < following or i in here:
                out.append((key[0], i, status, "rejected"))
            elif i >= following + self.bound:
                out.append((key[0], i, status, "held"))
            else:
                here[i] = status
        while following in here:
            out.append((key[0], following, here.pop(following), "emitted"))
            following += 1
        for i in before.keys() - here.keys():
            self.waiting.removeKey((i,))
        for i in here.keys() - before.keys():
            self.waiting.updateValue((i,), (here[i],))
        self.following.update((following,))
        yield pd.DataFrame(out, columns=["study", "trial_id", "status", "outcome"])


def emit(trials: DataFrame, floor: int = 0, bound: int = 1 << 16) -> DataFrame:
    """study, trial_id, status, outcome of a stream of (study, trial_id, status).

    outcome: emitted (in order), rejected (an id that was emitted, waits or lies below the floor),
    held (`bound` ids or more ahead of the next one: not taken in, and to be given again
    later, as drained() does). State needs the store ROCKS.
    """
    return trials.groupBy("study").transformWithStateInPandas(Ordered(floor, bound), "study string, trial_id bigint, status string, outcome string", "Append", "None")


def drained(spark: SparkSession, source: str, folder: str, floor: int = 0, bound: int = 1 << 16, files: int = 1000) -> DataFrame:
    """study, trial_id, status, outcome of all files of rows (study, trial_id, status; Parquet) in source, with a bounded state.

    Rows that are too far ahead hold the source back: they are written to a folder that the
    stream reads again after what it took in, for as long as any are let in. Those that
    wait for an id that never comes are `held` in the result.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "study string, trial_id bigint, status string"
    held, out = f"{folder}/held", f"{folder}/out"
    spark.createDataFrame([], schema).write.mode("append").parquet(held)

    def written(batch: DataFrame, number: int) -> None:
        """One folder for each batch, so that a batch that is done again replaces its own rows."""
        batch.where("outcome <> 'held'").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.where("outcome = 'held'").drop("outcome").write.mode("overwrite").parquet(f"{held}/batch={number}")

    last = -1
    while True:
        given, again = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(p) for p in (source, held))
        q = emit(given.union(again), floor, bound).writeStream.foreachBatch(written).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        progress = [p["batchId"] for p in q.recentProgress]
        new = spark.read.schema(schema + ", outcome string, batch int").parquet(out).where(F.col("batch") > last)
        if not progress or not new.where("outcome = 'emitted'").limit(1).count():
            break
        last = max(progress)
    done = spark.read.schema(schema + ", outcome string").option("recursiveFileLookup", True).parquet(out)
    gone = done.select("study", "trial_id").distinct()
    rest = spark.read.schema(schema).parquet(source).dropDuplicates(["study", "trial_id"])
    return done.unionByName(rest.join(gone, ["study", "trial_id"], "left_anti").withColumn("outcome", F.lit("held")))


def watermark(trials: DataFrame, floor: int = 0) -> DataFrame:
    """study, watermark: the largest id up to which all ids from the floor are there; floor - 1 if the first isn't."""
    rows = trials.where(F.col("trial_id") >= floor).select("study", "trial_id").distinct()
    first = islands(rows, ["study"], "trial_id").where(F.col("_island") == floor).groupBy("study").agg(F.max("trial_id").alias("watermark"))
    return trials.select("study").distinct().join(first, "study", "left").select("study", F.coalesce("watermark", F.lit(floor - 1)).alias("watermark"))


def beyond(trials: DataFrame, floor: int = 0) -> DataFrame:
    """trials with beyond_watermark, and rejected for those below the floor."""
    return trials.join(watermark(trials, floor), "study").withColumn("beyond_watermark", F.col("trial_id") > F.col("watermark")).withColumn("rejected", F.col("trial_id") < floor).drop("watermark")


def accounting(trials: DataFrame, floor: int = 0) -> DataFrame:
    """study, projected, emitted, rejected, gaps: slots told of, rows given out, rows refused, ids never filled up to the last."""
    g = beyond(trials, floor).groupBy("study").agg(F.count("*").alias("rows"), F.sum(F.col("rejected").cast("long")).alias("rejected"), F.max("trial_id").alias("last"), F.count_distinct(F.when(~F.col("rejected"), F.col("trial_id"))).alias("emitted"))
    return g.select("study", (F.col("last") - floor + 1).alias("projected"), "emitted", "rejected", (F.col("last") - floor + 1 - F.col("emitted")).alias("gaps"))


def patience(trials: DataFrame, limit: int, minimize: bool = False) -> DataFrame:
    """study, stops_at: the first id at which `limit` trials in a row, after the first feasible one, brought no strict improvement; null if none."""
    value = F.when(F.col("feasible"), -F.col("objective") if minimize else F.col("objective"))
    rows = trials.withColumn("_value", value).withColumn("_block", F.floor(F.col("trial_id") / BLOCK))
    rows = running_max(rows, ["study"], "_block", ["trial_id"], F.col("_value"), "_best", inclusive=False)
    rows = numbered(rows, ["study"], "_block", ["trial_id"], "_n")
    better = F.col("_value").isNotNull() & (F.col("_best").isNull() | (F.col("_value") > F.col("_best")))
    rows = running_max(rows, ["study"], "_block", ["trial_id"], F.when(better, F.col("_n")), "_last")
    hit = rows.where(F.col("_n") - F.col("_last") >= limit).groupBy("study").agg(F.min("trial_id").alias("stops_at"))
    return trials.select("study").distinct().join(hit, "study", "left")


def audit(log: DataFrame) -> DataFrame:
    """Rows of a completion log (completion_order, trial_id, completed_before) that break its rules: completed_before falls, or isn't below the row's own place."""
    rows = lag_within(log.withColumn("_block", F.floor(F.col("trial_id") / BLOCK)), ["study"], "_block", ["trial_id"], "completed_before", "_b")
    return rows.where((F.col("completed_before") < F.col("_b")) | (F.col("completed_before") > F.col("completion_order"))).drop("_b", "_block")


def late(trials: DataFrame, delay: str) -> DataFrame:
    """A stream without repeated trials within the watermark's delay; rows later than that are dropped by Spark."""
    return trials.withWatermark("at", delay).dropDuplicatesWithinWatermark(["study", "trial_id"])
