"""Samplers whose points are addressed by index, so that any task can make any of them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space
from stratamill.types import Refusal

WORD = 1 << 64
_MASK = WORD - 1

#: Joe and Kuo's direction numbers D6 for columns 2 to 21 (fixed values): degree, polynomial, initial m.
DIRECTIONS = (
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 1, 3, 3)),
    (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)),
    (5, 11, (1, 1, 5, 1, 1)),
    (5, 13, (1, 1, 1, 3, 11)),
    (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)),
    (6, 13, (1, 1, 1, 15, 21, 21)),
    (6, 16, (1, 3, 1, 13, 27, 49)),
    (6, 19, (1, 1, 1, 15, 7, 5)),
    (6, 22, (1, 3, 1, 15, 13, 25)),
    (6, 25, (1, 1, 5, 5, 19, 61)),
    (7, 1, (1, 3, 7, 11, 23, 15, 103)),
    (7, 4, (1, 3, 7, 13, 13, 15, 69)),
)


def read_directions(text: str) -> tuple:
    """More columns from the published file (lines: column, degree, polynomial, m ...)."""
    rows = [list(map(int, x.split())) for x in text.splitlines() if x.strip() and x.split()[0].isdigit()]
    return tuple((r[1], r[2], tuple(r[3:])) for r in rows)


def split_mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
    return x ^ x >> 31


def direction_words(column: int, table=DIRECTIONS) -> list[int]:
    """V_1 ... V_64 of a Sobol column."""
    if not column:
        return [1 << 64 - k for k in range(1, 65)]
    if column > len(table):
        raise Refusal("sobol_columns", f"{column + 1} asked, {len(table) + 1} known")
    degree, polynomial, m = table[column - 1]
    m = list(m)
    for k in range(degree, 64):
        new = m[k - degree] ^ (m[k - degree] << degree)
        for j in range(1, degree):
            if polynomial >> (degree - 1 - j) & 1:
                new ^= m[k - j] << j
        m.append(new)
    return [x << 64 - k for k, x in enumerate(m, 1)]


def shift_word(seed: int, column: int) -> int:
    """A column's digital shift: SplitMix64's output number column + 1 from the seed."""
    return split_mix((seed + column * 0x9E3779B97F4A7C15) & _MASK)


def signed(x: int) -> int:
    return x - WORD if x >> 63 else x


def sobol_word(index: Column, column: int, shift: int = 0, bits: int = 40, table=DIRECTIONS) -> Column:
    """The 64-bit word (as a LONG) of point `index` < 2**bits: bitwise operations only, all in generated code."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    parts = (F.negate(F.shiftright(gray, k).bitwiseAND(F.lit(1).cast("long"))).bitwiseAND(F.lit(signed(v)).cast("long")) for k, v in enumerate(direction_words(column, table)[:bits]))
    return reduce(lambda a, b: a.bitwiseXOR(b), parts, F.lit(signed(shift)).cast("long"))


def unit(word: Column) -> Column:
    """The top 53 bits as a number in [0, 1)."""
    return F.shiftrightunsigned(word, 11) * F.lit(2.0**-53)


def high_index(word: Column, count: int) -> Column:
    """floor(word x count / 2**64), exactly: from 32-bit halves while count < 2**31."""
    if count >= 1 << 31:
        raise Refusal("count", str(count))
    high, low = F.shiftrightunsigned(word, 32), word.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.shiftrightunsigned(high * count + F.shiftrightunsigned(low * count, 32), 32)


def decoded(d, word: Column) -> Column:
    """A dimension's value from a word."""
    if d.count is not None and not getattr(d, "log", False):
        return d.value(high_index(word, d.count))
    u = unit(word)
    if isinstance(d, Integer):
        a = d.low - 0.5
        return F.least(F.greatest(F.floor(F.lit(d.low) + a * F.expm1(F.log1p(F.lit((d.high - d.low + 1) / a)) * u)), F.lit(d.low)), F.lit(d.high)).cast("long")
    if d.log:
        return F.least(F.greatest(F.lit(d.low) * F.exp(u * math.log1p((d.high - d.low) / d.low)), F.lit(d.low)), F.lit(d.high))
    return F.lit(d.low) + F.lit(d.high - d.low) * u


def varying(space: Space) -> list:
    """Dimensions that take more than one value, by the bytes of their names: Sobol columns in order."""
    return sorted((d for d in space.dimensions if d.count != 1), key=lambda d: d.name.encode())


def sobol(spark: SparkSession, space: Space, trials: int, seed: int | None = None, first: int = 0, table=DIRECTIONS) -> DataFrame:
    """trial_id (the point's index) and the dimensions. A continuation begins at the parent's last index + 1."""
    ids = spark.range(first, first + trials).withColumnRenamed("id", "trial_id")
    return sobol_at(ids, space, seed, max(1, (first + trials).bit_length()), table)


def sobol_at(ids: DataFrame, space: Space, seed: int | None = None, bits: int = 40, table=DIRECTIONS) -> DataFrame:
    """ids (trial_id, the points' indexes below 2**bits) with the dimensions. Up to WIDE columns are expressions; more are stepped over in Arrow blocks."""
    column = {d.name: i for i, d in enumerate(varying(space))}
    if len(column) > WIDE:
        return _sobol_blocks(ids, space, seed, bits, table)

    def value(d):
        if d.name not in column:
            return d.value(F.lit(0).cast("long")) if not isinstance(d, Real) else F.lit(d.low)
        c = column[d.name]
        return decoded(d, sobol_word(F.col("trial_id"), c, 0 if seed is None else shift_word(seed, c), bits, table))

    return ids.withColumns({d.name: value(d) for d in space.dimensions})


#: Columns whose 40 terms each still make one generated class.
WIDE = 24


def sobol_block(index, words):
    """Words of points (uint64: points x columns); words: V_1 ... by column. A run of indexes is stepped by Gray code, one word a step; where a run begins all of its bits are taken."""
    import numpy as np

    index = np.asarray(index, np.uint64)
    out = np.zeros((len(index), words.shape[0]), np.uint64)
    follows = np.zeros(len(index), bool)
    follows[1:] = index[1:] == index[:-1] + np.uint64(1)
    # The lowest set bit of an index says which word its step from the one before takes.
    lowest = np.bitwise_count((index & (~index + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    out[follows] = words[:, lowest[follows]].T
    first = np.flatnonzero(~follows)
    gray = index[first] ^ (index[first] >> np.uint64(1))
    for k in range(words.shape[1]):
        out[first] ^= np.where((gray >> np.uint64(k) & np.uint64(1))[:, None] == 1, words[:, k], np.uint64(0))
    for a, b in zip(first, np.append(first[1:], len(index)), strict=True):
        np.bitwise_xor.accumulate(out[a:b], axis=0, out=out[a:b])
    return out


def _sobol_blocks(ids: DataFrame, space: Space, seed: int | None, bits: int, table) -> DataFrame:
    """sobol_at() for any number of columns: words by Arrow blocks, then the same expressions of words as else."""
    import numpy as np

    dims = varying(space)
    words = np.array([direction_words(c, table)[:bits] for c in range(len(dims))], np.uint64)
    shifts = np.array([0 if seed is None else shift_word(seed, c) for c in range(len(dims))], np.uint64)
    shared = ids.sparkSession.sparkContext.broadcast((words, shifts))  # columns x 40 words
    names = ids.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                w = sobol_block(some.column("trial_id").to_numpy(zero_copy_only=False), shared.value[0]) ^ shared.value[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.view(np.int64).ravel()))
                yield pa.record_batch([*(some.column(n) for n in names), lists], names=[*names, "_words"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema.fields)
    made = ids.mapInArrow(run, f"{kinds}, _words array<bigint>")
    place = {d.name: i for i, d in enumerate(dims)}
    constant = {d.name: d.value(F.lit(0).cast("long")) if not isinstance(d, Real) else F.lit(d.low) for d in space.dimensions if d.name not in place}
    return made.select(*names, *(constant.get(d.name, decoded(d, F.col("_words")[place[d.name]]) if d.name in place else None).alias(d.name) for d in space.dimensions))


def parts(ids: DataFrame) -> DataFrame:
    """part, first_index, next_index, terminal_trials, exact_stream of a Sobol study's parts; ids: part (0, 1, ...), trial_id of every terminal trial.

    A part goes on after the largest id before it. It is exact if the parts before it hold
    all ids below its first and no others, and its own are all from there to its last, once
    each. Ids are counted in the first part that has them, so a part costs one row.
    """
    from pyspark.sql import Window

    own = ids.groupBy("part").agg(F.count("*").alias("n"), F.min("trial_id").alias("low"), F.max("trial_id").alias("high"))
    each = ids.groupBy("trial_id").agg(F.min("part").alias("part"))
    new = each.groupBy("part").agg(F.count("*").alias("new"))
    distinct = ids.groupBy("part", "trial_id").agg(F.lit(1).alias("_")).groupBy("part").agg(F.count("*").alias("k"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    rows = own.join(new, "part", "left").join(distinct, "part")
    rows = rows.withColumns({"first_index": F.coalesce(F.max("high").over(before) + 1, F.lit(0)), "_seen": F.coalesce(F.sum(F.coalesce("new", F.lit(0))).over(before), F.lit(0))})
    following = F.greatest(F.col("high") + 1, F.col("first_index"))
    exact = (F.col("_seen") == F.col("first_index")) & (F.col("low") == F.col("first_index")) & (F.col("n") == F.col("k")) & (F.col("k") == following - F.col("first_index"))
    return rows.select("part", "first_index", following.alias("next_index"), F.col("n").alias("terminal_trials"), exact.alias("exact_stream"))


def admit_sobol(spark: SparkSession, space: Space, parent: DataFrame, seed: int | None = None) -> DataFrame:
    """Rows of a parent study that its generator doesn't make at their id."""
    last = parent.agg(F.max("trial_id")).first()[0]
    made = sobol_at(parent.select("trial_id").where("trial_id >= 0").distinct(), space, seed, max(1, (last or 0).bit_length()))
    return parent.select("trial_id", *space.names).join(made, ["trial_id", *space.names], "left_anti")


# ---- Random -------------------------------------------------------------------


class Twister:
    """The 64-bit Mersenne Twister, for the serial random stream (constants are fixed values)."""

    N, M = 312, 156
    MATRIX, UPPER, LOWER = 0xB5026F5AA96619E9, 0xFFFFFFFF80000000, 0x7FFFFFFF

    def __init__(self, seed: int):
        s = [seed & _MASK]
        for i in range(1, self.N):
            s.append((6364136223846793005 * (s[-1] ^ s[-1] >> 62) + i) & _MASK)
        self.state, self.at = s, self.N

    def word(self) -> int:
        if self.at == self.N:
            s = self.state
            for i in range(self.N):
                x = (s[i] & self.UPPER) | (s[(i + 1) % self.N] & self.LOWER)
                s[i] = s[(i + self.M) % self.N] ^ (x >> 1) ^ (self.MATRIX if x & 1 else 0)
            self.at = 0
        x = self.state[self.at]
        self.at += 1
        x ^= x >> 29 & 0x5555555555555555
        x ^= x << 17 & 0x71D67FFFEDA60000 & _MASK
        x ^= x << 37 & 0xFFF7EEE000000000 & _MASK
        return x ^ x >> 43

    def bounded(self, n: int) -> int:
        """Uniform below n: words that would favour some residues are thrown away."""
        floor = (WORD - n) % n
        while (w := self.word()) < floor:
            pass
        return w % n

    def unit(self) -> float:
        return (self.word() >> 11) * 2.0**-53


def draw(d, rng: Twister):
    if isinstance(d, Boolean):
        return rng.bounded(2) == 1
    if isinstance(d, Categorical):
        return d.choices[rng.bounded(len(d.choices))]
    if isinstance(d, Integer):
        if d.log:
            a = d.low - 0.5
            return min(max(d.low + math.floor(a * math.expm1(math.log1p((d.high - d.low + 1) / a) * rng.unit())), d.low), d.high)
        return d.low + d.step * rng.bounded(d.count)
    if d.step is not None:
        return min(math.fma(rng.bounded(d.count), d.step, d.low), d.high)
    if d.log:
        return min(max(d.low * math.exp(math.log1p((d.high - d.low) / d.low) * rng.unit()), d.low), d.high)
    return d.low if d.low == d.high else d.low + (d.high - d.low) * rng.unit()


def random_serial(space: Space, seed: int, trials: int) -> list[dict]:
    """The serial stream, on the driver: dimensions draw in their declared order."""
    rng = Twister(seed)
    return [{d.name: draw(d, rng) for d in space.dimensions} for _ in range(trials)]


def random_indexed(spark: SparkSession, space: Space, seed: int, trials: int, first: int = 0) -> DataFrame:
    """A random sample made in parallel: every value comes from a hash of (seed, trial, dimension). Its stream isn't the serial one."""
    return random_at(spark.range(first, first + trials).withColumnRenamed("id", "trial_id"), space, seed)


def random_at(ids: DataFrame, space: Space, seed: int) -> DataFrame:
    """ids (trial_id) with the values that a random sample has there."""
    words = {d.name: F.xxhash64(F.lit(signed(seed & _MASK)).cast("long"), F.col("trial_id"), F.lit(i)) for i, d in enumerate(space.dimensions)}
    return ids.withColumns({d.name: decoded(d, words[d.name]) for d in space.dimensions})


def continuation_seed(seed: int, warm: int) -> int:
    return split_mix(seed ^ warm)
