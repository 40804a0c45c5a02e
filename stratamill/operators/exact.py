"""Exact sums of doubles: the same bits whatever the partitions and their order.

A finite double is an integer of at most 55 bits times a power of two that is read off
its size. Rows are summed by that power: the integers, and the three products of their
halves that make up a square, as decimals of 38 digits, which hold 2**70 rows. A table of such sums has at
most some 2,100 rows, one for each power, and two of them add up to that of both
inputs. The last step is a fraction, rounded once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the lower half of an integer.
HALF = 28
PARTS = ("n", "s", "hh", "hl", "ll")


def _power(value: Column) -> Column:
    """A power of two of which the value is a multiple by fewer than 2**55; log2 may be off by one at its ends."""
    return F.when(value == 0, 0).otherwise(F.floor(F.log2(F.abs(value))) - 53).cast("int")


def _whole(value: Column, power: Column) -> Column:
    """value / 2**power as an integer, in two steps that neither overflow nor lose bits."""
    first = F.floor(-power / 2)
    return (value * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), -power - first)).cast("bigint")


def sums(df: DataFrame, value: str, by: Iterable[str] = ()) -> DataFrame:
    """by, power, n, s, hh, hl, ll of the rows whose value is finite."""
    by = list(by)
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))).select(*by, v.alias("_v"))
    rows = rows.withColumn("power", _power(F.col("_v"))).withColumn("_m", _whole(F.col("_v"), F.col("power")))
    high, low = F.shiftright("_m", HALF), F.col("_m").bitwiseAND(F.lit((1 << HALF) - 1).cast("bigint"))
    total = {"s": F.col("_m"), "hh": high * high, "hl": high * low, "ll": low * low}
    return rows.groupBy(*by, "power").agg(F.count("*").alias("n"), *(F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)").alias(k) for k, c in total.items()))


def merged(tables: list[DataFrame], by: Iterable[str] = ()) -> DataFrame:
    """The sums of several inputs together."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*by, "power").agg(F.sum("n").alias("n"), *(F.sum(c).cast("decimal(38,0)").alias(c) for c in PARTS[1:]))


@dataclass
class Exact:
    """Count, sum and sum of squares as they are."""

    n: int = 0
    total: Fraction = Fraction(0)
    squares: Fraction = Fraction(0)

    def add(self, power: int, n: int, s: int, hh: int, hl: int, ll: int) -> "Exact":
        unit = Fraction(2) ** power
        self.n += n
        self.total += int(s) * unit
        self.squares += ((int(hh) << 2 * HALF) + (int(hl) << HALF + 1) + int(ll)) * unit * unit
        return self

    def mean(self) -> Fraction | None:
        return self.total / self.n if self.n else None

    def variance(self) -> Fraction | None:
        """That of a sample."""
        return (self.squares - self.total * self.total / self.n) / (self.n - 1) if self.n > 1 else None


def collected(table: DataFrame) -> Exact:
    """The figures of a table of sums without `by`; it has a row for each power."""
    out = Exact()
    for r in table.select("power", *PARTS).toLocalIterator():
        out.add(*r)
    return out


def rounded(x: Fraction | None) -> float | None:
    """The double nearest to a fraction."""
    return None if x is None else float(x)


def _figures(rows):
    import pyarrow as pa

    names = [n for n in rows.schema.names if n not in ("power", *PARTS)]
    x = Exact()
    for r in zip(*(rows.column(c).to_pylist() for c in ("power", *PARTS)), strict=True):
        x.add(*r)
    return pa.table({**{n: rows.column(n)[:1] for n in names}, "n": pa.array([x.n], pa.int64()), "mean": pa.array([rounded(x.mean())], pa.float64()), "variance": pa.array([rounded(x.variance())], pa.float64())})


def figures(table: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean, variance, each rounded once; a group holds a row for each power."""
    kinds = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in by)
    return table.groupBy(*by).applyInArrow(_figures, f"{kinds}, n bigint, mean double, variance double")
