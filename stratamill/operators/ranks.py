"""Ranks over a whole table without putting it into one partition.

Rows are counted by value; values are dealt into ranges by approximate quantiles, so
that running counts are windows over a range, and one small row per range carries the
count over. A mid-rank is kept doubled, as an integer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamill.storage import written

RANGES = 64


def _ranges(counts: DataFrame, value: str) -> DataFrame:
    cuts = counts.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.005)
    if not cuts:
        return counts.withColumn("_range", F.lit(0))
    return counts.withColumn("_range", sum(((F.col(value) >= c).cast("int") for c in sorted(set(cuts))), F.lit(0)))


def below(df: DataFrame, value: str, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """by, value, n, before: how many rows have each value, and how many come before it."""
    by = by or []
    counts = _ranges(df.groupBy(*by, value).agg(F.count("*").alias("n")), value)
    order = F.col(value).desc() if descending else F.col(value).asc()
    edge_order = F.col("_range").desc() if descending else F.col("_range").asc()
    own = F.sum("n").over(Window.partitionBy(*by, "_range").orderBy(order)) - F.col("n")
    totals = counts.groupBy(*by, "_range").agg(F.sum("n").alias("_t"))
    before = Window.partitionBy(*by).orderBy(edge_order).rowsBetween(Window.unboundedPreceding, -1)
    edges = totals.withColumn("_edge", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    return counts.withColumn("_own", own).join(edges, [*by, "_range"]).select(*by, value, "n", (F.col("_own") + F.col("_edge")).alias("before"))


def in_order(df: DataFrame, key: str, out: str) -> DataFrame:
    """df, written, with `out`: how many rows come before each in the order of key, which is unique. Rows are dealt by ranges of it and numbered where they are sorted; one row per range carries the count over."""
    dealt = df.repartitionByRange(key).sortWithinPartitions(key)
    at = written(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return at.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(out, F.col("_first") + place).drop("_part", "_at", "_first")


def twice_mid_rank(df: DataFrame, value: str, by: list[str] | None = None, descending: bool = False, out: str = "rank2") -> DataFrame:
    """df with twice its mid-rank, 1-based: ties share the mean of their places."""
    by = by or []
    ranks = below(df, value, by, descending).select(*by, value, (2 * F.col("before") + F.col("n") + 1).alias(out))
    return df.join(ranks, [*by, value])
