"""Finite and continuous search spaces: dimensions, ordinals, canonical identities.

The last dimension varies fastest. A grid is spark.range(cardinality) with every
ordinal decoded by integer division; grid values of real dimensions come from tables
made with one rounding each (fused multiply-add), so that they're equal everywhere.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.types import Refusal

MOST = (1 << 63) - 1
#: Values of a real dimension that are kept as a table on the driver.
TABLE = 1 << 16


@dataclass(frozen=True)
class Integer:
    name: str
    low: int
    high: int
    step: int = 1
    log: bool = False

    def __post_init__(self):
        if self.low > self.high or self.step < 1 or (self.log and (self.low < 1 or self.step != 1)):
            raise Refusal("dimension", self.name)

    @property
    def count(self) -> int:
        return (self.high - self.low) // self.step + 1

    def value(self, index: Column) -> Column:
        return F.lit(self.low) + index * self.step

    def index(self, value: Column) -> Column:
        k = value - self.low
        return F.when((k >= 0) & (value <= self.high) & (k % self.step == 0), F.floor(k / self.step).cast("long"))

    def canonical(self):
        return ["integer", str(self.low), str(self.high), str(self.step), self.log]


@dataclass(frozen=True)
class Real:
    name: str
    low: float
    high: float
    step: float | None = None
    log: bool = False

    def __post_init__(self):
        if not (math.isfinite(self.low) and math.isfinite(self.high)) or self.low > self.high or (self.step is not None and (self.step <= 0 or self.log)) or (self.log and self.low <= 0):
            raise Refusal("dimension", self.name)

    @property
    def count(self) -> int | None:
        if self.low == self.high:
            return 1
        if self.step is None:
            return None
        last = int((self.high - self.low) / self.step)
        while last and math.fma(last, self.step, self.low) > math.nextafter(self.high, math.inf):
            last -= 1
        while math.fma(last + 1, self.step, self.low) <= math.nextafter(self.high, math.inf):
            last += 1
        return last + 1

    def values(self) -> list[float]:
        n = self.count
        if n is None or n > TABLE:
            raise Refusal("dimension_table", self.name)
        return [min(math.fma(i, self.step or 0.0, self.low), self.high) for i in range(n)]

    def value(self, index: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.values())), (index + 1).cast("int"))

    def index(self, value: Column) -> Column:
        at = F.array_position(F.array(*map(F.lit, self.values())), value)
        return F.when(at > 0, at - 1)

    def canonical(self):
        def bits(x):
            return struct.pack(">d", x + 0.0).hex()

        return ["real", bits(self.low), bits(self.high), None if self.step is None else bits(self.step), self.log]


@dataclass(frozen=True)
class Boolean:
    name: str
    count: int = 2

    def value(self, index: Column) -> Column:
        return index == 1

    def index(self, value: Column) -> Column:
        return value.cast("long")

    def canonical(self):
        return ["boolean"]


@dataclass(frozen=True)
class Categorical:
    name: str
    choices: tuple

    def __post_init__(self):
        if not self.choices or len(set(self.choices)) != len(self.choices):
            raise Refusal("dimension", self.name)

    @property
    def count(self) -> int:
        return len(self.choices)

    def value(self, index: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.choices)), (index + 1).cast("int"))

    def index(self, value: Column) -> Column:
        at = F.array_position(F.array(*map(F.lit, self.choices)), value)
        return F.when(at > 0, at - 1)

    def canonical(self):
        return ["categorical", [scalar(c) for c in self.choices]]


def scalar(v) -> list:
    if type(v) is bool:
        return ["boolean", v]
    if type(v) is int:
        return ["integer", str(v)]
    if type(v) is float:
        return ["real", struct.pack(">d", v + 0.0).hex()]
    return ["string", v]


def serialised(v) -> str:
    """A parameter as a strategy reads it: reals with 17 significant digits."""
    if type(v) is bool:
        return "true" if v else "false"
    return f"{v:.17g}" if type(v) is float else str(v)


@dataclass(frozen=True)
class Space:
    dimensions: tuple

    def __post_init__(self):
        names = [d.name for d in self.dimensions]
        if len(set(names)) != len(names):
            raise Refusal("dimension_names", str(names))

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dimensions]

    def cardinality(self) -> int | None:
        """Number of vectors; None if a dimension is continuous. An empty space has one."""
        n = 1
        for d in self.dimensions:
            if d.count is None:
                return None
            n *= d.count
        if n > MOST:
            raise Refusal("cardinality", str(n))
        return n

    def decode(self, df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
        """df with a column for each dimension."""
        rest, out = F.col(ordinal), {}
        stride = 1
        for d in reversed(self.dimensions):
            out[d.name] = d.value(F.pmod(F.floor(rest / F.lit(stride)) if stride == 1 else F.expr(f"`{ordinal}` div {stride}"), F.lit(d.count)))
            stride *= d.count
        return df.withColumns({n: out[n] for n in self.names})

    def encode(self, df: DataFrame, out: str = "ordinal") -> DataFrame:
        """df with the ordinal of its vector; null where a value isn't on the grid."""
        total, stride = F.lit(0).cast("long"), 1
        for d in reversed(self.dimensions):
            total = total + d.index(F.col(f"`{d.name}`")) * F.lit(stride)
            stride *= d.count
        return df.withColumn(out, total)

    def issues(self, df: DataFrame) -> DataFrame:
        """df's rows that aren't vectors of the space, with the first dimension that's wrong and why."""
        reason = F.lit(None).cast("string")
        for d in reversed(self.dimensions):
            c = F.col(f"`{d.name}`") if d.name in df.columns else None
            if c is None:
                reason = F.lit(f"{d.name}: missing")
                continue
            outside = d.index(c).isNull() if d.count is not None else (c < d.low) | (c > d.high)
            reason = F.when(c.isNull(), F.lit(f"{d.name}: missing")).when(outside, F.lit(f"{d.name}: off grid")).otherwise(reason)
        return df.withColumn("issue", reason).where("issue is not null")

    def grid(self, spark: SparkSession, trials: int | None = None, first: int = 0) -> DataFrame:
        """trial_id and the dimensions: the vectors in order. Nothing is kept anywhere; every task decodes its range."""
        n = self.cardinality()
        if n is None:
            raise Refusal("grid_continuous")
        n = min(n, first + trials) if trials is not None else n
        return self.decode(spark.range(first, n).withColumnRenamed("id", "trial_id"), "trial_id")

    def continued(self, spark: SparkSession, tried: DataFrame, trials: int | None = None) -> DataFrame:
        """ordinal and dimensions of vectors that aren't among `tried` (the dimensions' columns), in order."""
        done = self.encode(tried).select("ordinal").distinct()
        rest = spark.range(self.cardinality()).withColumnRenamed("id", "ordinal").join(done, "ordinal", "left_anti")
        return self.decode(rest.orderBy("ordinal").limit(trials) if trials is not None else rest)

    def canonical(self) -> str:
        return json.dumps([[d.name, *d.canonical()] for d in self.dimensions], separators=(",", ":"), ensure_ascii=False)

    def hash(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()

    def vector_key(self, values: dict) -> str:
        """An exact name of a vector: typed scalars, reals by their bits, -0.0 as 0.0."""
        return json.dumps({n: scalar(values[n]) for n in sorted(self.names)}, separators=(",", ":"), ensure_ascii=False)

    def vector_key_column(self) -> Column:
        """vector_key() of rows that have a column for each dimension; a continuous real has no such column form."""

        def one(d) -> Column:
            c = F.col(f"`{d.name}`")
            if isinstance(d, Real):
                named = F.create_map(*(x for v in d.values() for x in (F.lit(v), F.lit(json.dumps(scalar(v), separators=(",", ":"))))))
                return named[c]
            if isinstance(d, Categorical):
                return F.element_at(F.array(*(F.lit(json.dumps(scalar(v), separators=(",", ":"), ensure_ascii=False)) for v in d.choices)), F.array_position(F.array(*map(F.lit, d.choices)), c).cast("int"))
            if isinstance(d, Boolean):
                return F.when(c, '["boolean",true]').otherwise('["boolean",false]')
            return F.concat(F.lit('["integer","'), c.cast("string"), F.lit('"]'))

        by = {d.name: d for d in self.dimensions}
        parts = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), one(by[n])) for n in sorted(self.names)]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    def info(self, tried: DataFrame) -> DataFrame:
        """cardinality, tried, remaining, next_id."""
        n = self.cardinality()
        seen = self.encode(tried).agg(F.count_distinct("ordinal").alias("tried"), (F.coalesce(F.max("trial_id"), F.lit(-1)) + 1).alias("next_id"))
        return seen.select(F.lit(n).alias("cardinality"), "tried", (F.lit(n) - F.col("tried")).alias("remaining"), "next_id")
