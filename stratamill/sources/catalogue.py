"""Names of data by their values: a feed's running digest, and a catalogue of data sets with one descriptor.

A feed's digest is SHA-256 over the little-endian values of its bars in order (open,
high, low, close, volume, opening and closing time), fed block by block as a sorted
partition streams by: a feed is one task's, its bars are never held together. A data
set's digest in a catalogue has two levels, so that its blocks of time are hashed
wherever they lie, and one short row for each block is put in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.sources.bars import BLOCK_MS, bar_close
from stratamill.types import Refusal

#: What the hashed bytes begin with (our own names).
FEED, DATASET, CATALOGUE = b"stratamill:feed:v1\0", b"stratamill:data-set:v1\0", b"stratamill:catalogue:v1\0"
VALUES = ("open", "high", "low", "close", "volume", "timestamp", "time_close")
#: Data sets that a catalogue may have (fixed value).
MOST_SETS = 256


def _digests(keys: list[str], columns: tuple[str, ...], domain: bytes):
    """keys, bars, digest of each run of rows with equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, h, n, kinds = None, None, 0, None

        def made() -> pa.RecordBatch:
            return pa.record_batch([*(pa.array([v], k) for v, k in zip(now, kinds, strict=True)), pa.array([n], pa.int64()), pa.array([h.hexdigest()])], names=[*keys, "bars", "digest"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            packed = np.empty((batch.num_rows, len(columns)), "<i8")
            for i, c in enumerate(columns):
                x = batch.column(c).to_numpy(zero_copy_only=False)
                packed[:, i] = x.astype("<f8").view("<i8") if x.dtype.kind == "f" else x
            for a, b in zip(edges, edges[1:], strict=False):
                if names[a] != now:
                    if h is not None:
                        yield made()
                    now, h, n = names[a], hashlib.sha256(domain), 0
                h.update(packed[a:b].tobytes())
                n += b - a
        if h is not None:
            yield made()

    return run


def feed_digests(feed: DataFrame, token: str) -> DataFrame:
    """symbol, bars, sha256 of feeds (symbol, open, high, low, close, volume, timestamp, and time_close where it isn't the time frame's). A missing volume is NaN."""
    close = bar_close(F.col("timestamp"), token)
    rows = feed.withColumn("time_close", F.coalesce("time_close", close) if "time_close" in feed.columns else close)
    rows = rows.select("symbol", *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in VALUES[:5]), *(F.col(c).cast("bigint").alias(c) for c in VALUES[5:]))
    out = rows.repartition("symbol").sortWithinPartitions("symbol", "timestamp").mapInArrow(_digests(["symbol"], VALUES, FEED), "symbol string, bars bigint, digest string")
    return out.withColumnRenamed("digest", "sha256")


def catalogue(bars: DataFrame, bindings: DataFrame) -> DataFrame:
    """dataset_id, choices, bars, first_ts, last_ts, values_sha256 of the data sets that choices are bound to; bars: dataset_id and the columns of bars."""
    if twice := bindings.groupBy("choice").agg(F.count("*").alias("k")).where("k > 1").limit(1).collect():
        raise Refusal("binding_choice", str(twice[0]["choice"]))
    sets = bindings.groupBy("dataset_id").agg(F.array_sort(F.collect_set("choice")).alias("choices"))
    if (n := sets.count()) > MOST_SETS:
        raise Refusal("binding_sets", str(n))
    columns = VALUES[:6]
    rows = bars.join(F.broadcast(sets.select("dataset_id")), "dataset_id").withColumn("block", F.floor(F.col("timestamp") / BLOCK_MS))
    rows = rows.select("dataset_id", "block", *(F.col(c).cast("double" if c != "timestamp" else "bigint").alias(c) for c in columns))
    facts = rows.groupBy("dataset_id").agg(F.count("*").alias("bars"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    kind = rows.schema["dataset_id"].dataType.simpleString()
    blocks = rows.repartition("dataset_id", "block").sortWithinPartitions("dataset_id", "block", "timestamp").mapInArrow(_digests(["dataset_id", "block"], columns, DATASET), f"dataset_id {kind}, block bigint, bars bigint, digest string")
    whole = blocks.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("_d"))  # a row for each 25 days
    value = F.sha2(F.array_join(F.transform("_d", lambda x: x["digest"]), "").cast("binary"), 256)
    out = sets.join(facts, "dataset_id", "left").join(whole, "dataset_id", "left")
    if empty := out.where("bars is null").limit(1).collect():
        raise Refusal("binding_dataset", str(empty[0]["dataset_id"]))
    return out.select("dataset_id", "choices", "bars", "first_ts", "last_ts", value.alias("values_sha256"))


def descriptor(sets: DataFrame) -> DataFrame:
    """descriptor, sha256 of a catalogue: its data sets as JSON, in order."""
    listed = F.array_sort(F.collect_list(F.struct("dataset_id", "choices", "bars", "first_ts", "last_ts", "values_sha256")))
    text = F.to_json(listed)
    return sets.agg(text.alias("descriptor")).select("descriptor", F.sha2(F.concat(F.lit(CATALOGUE.decode()), F.col("descriptor")).cast("binary"), 256).alias("sha256"))
