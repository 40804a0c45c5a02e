"""Holdout comparison and walk-forward summaries: joins of studies on the parameter vector.

Rows are (trial_id, vector, value, reason): vector is any column that names a vector,
reason is null for rows that can be used. Values are to be maximised; negate them else.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamill.operators.ranks import twice_mid_rank
from stratamill.types import Refusal


def by_vector(rows: DataFrame) -> DataFrame:
    """vector, trial_id, value: one row per vector, named by its lowest id."""
    return rows.where("reason is null").groupBy("vector").agg(F.min("trial_id").alias("trial_id"), F.min_by("value", "trial_id").alias("value"))


def disagreements(rows: DataFrame) -> DataFrame:
    """Vectors whose rows have different values."""
    return rows.where("reason is null").groupBy("vector").agg(F.count_distinct("value").alias("values"), F.min("trial_id").alias("trial_id")).where("values > 1")


def followed(selection: DataFrame, k: int) -> DataFrame:
    """place, vector, trial_id, value: the k best vectors of the selection."""
    top = by_vector(selection).orderBy(F.col("value").desc(), "trial_id").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("value").desc(), "trial_id")))  # k rows


def pool(selection: DataFrame, holdout: DataFrame) -> DataFrame:
    """vector, trial_id, value, selected_value, rank2: vectors that can be used in both, ranked in the holdout."""
    s, h = by_vector(selection), by_vector(holdout)
    both = h.join(s.select("vector", F.col("value").alias("selected_value")), "vector")
    return twice_mid_rank(both, "value", descending=True)


def compare(selection: DataFrame, holdout: DataFrame, k: int) -> DataFrame:
    """The k followed vectors with their value, difference and rank in the holdout, or why they have none."""
    matched = pool(selection, holdout)
    size = matched.groupBy().agg(F.count("*").alias("matched"))
    reasons = holdout.groupBy("vector").agg(F.min_by(F.coalesce("reason", F.lit("")), "trial_id").alias("why"))
    f = followed(selection, k).join(matched.select("vector", F.col("value").alias("holdout_value"), "rank2"), "vector", "left").join(reasons, "vector", "left").join(F.broadcast(size))
    return f.select(
        "place", "trial_id", "vector", "value", "holdout_value", (F.col("holdout_value") - F.col("value")).alias("difference"), (F.col("holdout_value") > F.col("value")).alias("improved"),
        "rank2", (F.col("rank2") <= F.col("matched") + 1).alias("better_half"), F.when(F.col("holdout_value").isNull(), F.coalesce("why", F.lit("no_row"))).alias("reason"),
    )


def spearman(selection: DataFrame, holdout: DataFrame) -> dict:
    """Rank correlation over all matched vectors, from integer sums of doubled ranks; None for fewer than 3 or without spread."""
    m = twice_mid_rank(pool(selection, holdout).withColumnRenamed("rank2", "y"), "selected_value", descending=True, out="x")
    c = F.col
    r = m.agg(F.count("*").alias("n"), *(F.sum(v.cast("decimal(38,0)")).alias(a) for v, a in ((c("x"), "x"), (c("y"), "y"), (c("x") * c("x"), "xx"), (c("y") * c("y"), "yy"), (c("x") * c("y"), "xy")))).first()
    n = r["n"]
    if n < 3:
        return {"n": n, "rho": None, "reason": "too_few"}
    sxy, sxx, syy = (n * int(r[a]) - int(r[p]) * int(r[q]) for a, p, q in (("xy", "x", "y"), ("xx", "x", "x"), ("yy", "y", "y")))
    if not sxx or not syy:
        return {"n": n, "rho": None, "reason": "constant"}
    return {"n": n, "rho": math.copysign(math.sqrt(sxy * sxy / (sxx * syy)), sxy), "reason": None}


def unmatched(selection: DataFrame, holdout: DataFrame) -> DataFrame:
    """vector, trial_id, reason, rows, first_id, last_id: vectors of the selection that the holdout has no usable row of, why, and by which of its rows."""
    missing = by_vector(selection).join(by_vector(holdout).select("vector"), "vector", "left_anti").select("vector", "trial_id")
    rows = holdout.join(missing.select("vector"), "vector", "left_semi")
    first = rows.groupBy("vector").agg(F.min_by("reason", "trial_id").alias("why"), F.count("*").alias("rows"), F.min("trial_id").alias("first_id"), F.max("trial_id").alias("last_id"))
    return missing.join(first, "vector", "left").select("vector", "trial_id", F.coalesce("why", F.lit("no_row")).alias("reason"), F.coalesce("rows", F.lit(0)).alias("rows"), "first_id", "last_id")


def holdout_only(selection: DataFrame, holdout: DataFrame) -> DataFrame:
    return by_vector(holdout).join(by_vector(selection).select("vector"), "vector", "left_anti")


def ancestors(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Ids that two studies share, which makes one the other's ancestor."""
    return rows.select("trial_id").join(other.select("trial_id"), "trial_id", "left_semi").distinct()


# ---- Walk-forward: rows have a column `window`, numbered by plan -------------


def selections(rows: DataFrame) -> DataFrame:
    """window, trial_id, vector, value: the best usable row of each window, ties to the lowest id."""
    best = F.min(F.struct((-F.col("value")).alias("v"), "trial_id", "vector", "value")).alias("b")
    return rows.where("reason is null").groupBy("window").agg(best).select("window", "b.trial_id", "b.vector", "b.value")


def carried(rows: DataFrame) -> DataFrame:
    """window, next_window, trial_id, vector, next_value, rank2, reason: each selection in the window that follows it without a gap."""
    chosen = selections(rows)
    supplied = rows.select("window").distinct()
    following = F.lead("window").over(Window.orderBy("window"))  # one row per window
    chain = supplied.select("window", following.alias("next_window")).where("next_window = window + 1")
    asked = chosen.join(chain, "window").select(F.col("window").alias("from"), F.col("next_window").alias("window"), "vector", F.col("trial_id").alias("chosen_id"))
    own = rows.join(asked, ["window", "vector"]).groupBy("window").agg(F.min_by("value", F.struct(F.col("reason").isNotNull(), "trial_id")).alias("next_value"), F.min_by(F.coalesce("reason", F.lit("")), "trial_id").alias("why"), F.max(F.col("reason").isNull()).alias("usable"))
    got = asked.join(own, "window", "left").withColumn("next_value", F.when(F.col("usable"), F.col("next_value")))
    against = rows.where("reason is null").join(got.select("window", "next_value"), "window").groupBy("window").agg(F.sum((F.col("value") > F.col("next_value")).cast("long")).alias("better"), F.sum((F.col("value") == F.col("next_value")).cast("long")).alias("equal"))
    out = got.join(against, "window", "left")
    return out.select(F.col("from").alias("window"), F.col("window").alias("next_window"), F.col("chosen_id").alias("trial_id"), "vector", "next_value", F.when(F.col("next_value").isNotNull(), 2 * F.col("better") + F.col("equal") + 1).alias("rank2"), F.when(F.col("next_value").isNull(), F.coalesce("why", F.lit("no_row"))).alias("reason"))


def breaks(rows: DataFrame) -> DataFrame:
    """Supplied windows that the next supplied one doesn't follow."""
    s = rows.select("window").distinct()
    return s.select("window", F.lead("window").over(Window.orderBy("window")).alias("next_window")).where("next_window > window + 1")


def never_run(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return plan.select("window").join(rows.select("window").distinct(), "window", "left_anti")


def stability(chosen: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, values, smallest, largest over the windows' selections, which have a column per dimension."""
    pairs = ", ".join(f"'{d}', cast(`{d}` as double)" for d in dimensions)
    long = chosen.selectExpr(f"stack({len(dimensions)}, {pairs}) as (dimension, v)")
    return long.groupBy("dimension").agg(F.count_distinct("v").alias("values"), F.min("v").alias("smallest"), F.max("v").alias("largest"))


def refuse_disagreement(rows: DataFrame) -> None:
    if bad := disagreements(rows).limit(1).collect():
        raise Refusal("vector_disagreement", str(bad[0]["trial_id"]))
