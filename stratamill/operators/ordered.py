"""Ordered operations whose partitions are time blocks and not whole keys.

A window over a key puts all rows of the key into one task. Here a key's rows are
dealt out by (key, block); what crosses a block's edge (the last row, the sum so
far) is one small row per block, and only those rows are windowed by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_within(df: DataFrame, keys: list[str], block: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the value of the row before in the key's order; blocks must ascend with the order."""
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    last = df.groupBy(*keys, block).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    edge = last.withColumn("_edge", F.lag("_last").over(Window.partitionBy(*keys).orderBy(block))).drop("_last")
    rows = df.withColumn("_own", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    joined = rows.join(edge, [*keys, block])
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_own"))).drop("_own", "_first", "_edge")


def neighbours_within(df: DataFrame, keys: list[str], block: str, value: str, below: str, above: str) -> DataFrame:
    """df with the values of the rows before and after in the key's order by value, which is unique in a key; blocks must ascend with it."""
    inside = Window.partitionBy(*keys, block).orderBy(value)
    ends = df.groupBy(*keys, block).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    blocks = Window.partitionBy(*keys).orderBy(block)
    edge = ends.select(*keys, block, F.lag("_high").over(blocks).alias("_back"), F.lead("_low").over(blocks).alias("_on"))
    rows = df.withColumns({below: F.lag(value).over(inside), above: F.lead(value).over(inside)}).join(edge, [*keys, block])
    return rows.withColumns({below: F.coalesce(below, "_back"), above: F.coalesce(above, "_on")}).drop("_back", "_on")


def lead_within(df: DataFrame, keys: list[str], number: str, block: int, out: str) -> DataFrame:
    """df with `out`: the number of the row after in the key's order by that number, dealt out by blocks of it."""
    back = df.withColumn("_back", -F.col(number)).withColumn("_block", F.floor(F.col("_back") / block))
    return lag_within(back, keys, "_block", ["_back"], number, out).drop("_back", "_block")


def running_max(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """df with `out`: the largest value up to each row in the key's order, with or without the row's own."""
    df = df.withColumn("_v", value)
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    tops = df.groupBy(*keys, block).agg(F.max("_v").alias("_top"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    edge = tops.withColumn("_edge", F.max("_top").over(before)).drop("_top")
    rows = df.withColumn("_own", F.max("_v").over(inside)).join(edge, [*keys, block])
    return rows.withColumn(out, F.greatest("_own", "_edge")).drop("_own", "_edge", "_v")


def running(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, out: str) -> DataFrame:
    """df with `out`: the sum of value up to and with each row in the key's order."""
    df = df.withColumn("_v", value)
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, block).agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("_edge", F.sum("_sum").over(before)).drop("_sum")
    rows = df.withColumn("_own", F.sum("_v").over(inside)).join(edge, [*keys, block])
    return rows.withColumn(out, F.col("_own") + F.coalesce("_edge", F.lit(0))).drop("_own", "_edge", "_v")


def numbered(df: DataFrame, keys: list[str], block: str, order: list[str], out: str) -> DataFrame:
    """df with `out`: 0, 1, 2, ... in the key's order."""
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    counts = df.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    edge = counts.withColumn("_edge", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return df.withColumn("_own", F.row_number().over(inside) - 1).join(edge, [*keys, block]).withColumn(out, F.col("_own") + F.col("_edge")).drop("_own", "_edge")


def numbered_running(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, number: str, total: str) -> DataFrame:
    """numbered() and running() of one order together: one window over a block, one table of blocks."""
    df = df.withColumn("_v", value)
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    sums = df.groupBy(*keys, block).agg(F.count("*").alias("_k"), F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.select(*keys, block, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_t"))
    rows = df.withColumns({number: F.row_number().over(inside) - 1, total: F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0))}).drop("_v")
    return rows.join(edge, [*keys, block]).withColumns({number: F.col(number) + F.col("_n"), total: F.col(total) + F.col("_t")}).drop("_n", "_t")


def islands(df: DataFrame, keys: list[str], number: str, block: int = 1 << 16) -> DataFrame:
    """df with `_island`, the same for numbers of a key that follow each other without a gap; each number comes once."""
    rows = df.withColumn("_block", F.floor(F.col(number) / block))
    return numbered(rows, keys, "_block", [number], "_n").withColumn("_island", F.col(number) - F.col("_n")).drop("_n", "_block")
