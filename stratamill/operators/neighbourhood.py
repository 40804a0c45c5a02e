"""Neighbourhoods of chosen vectors, and maps of two dimensions around them.

Trials have one column per dimension, and status and objective. Centres are few and
chosen; the trials are reached by one join on the vectors asked for, which is sent to
them when it's small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space

#: A table of asked vectors up to so many rows is sent to the trials.
SENT = 1_000_000


#: How far a continuous value moves: a share of its span, and a factor where it's logarithmic.
FRACTION, RATIO = 0.05, 1.25


def _rounded(value: Column, ratio: float, up: bool) -> Column:
    """value x ratio or value / ratio, rounded half up, in exact integers: a double is a fraction of two of them."""
    p, q = ratio.as_integer_ratio()
    if not up:
        p, q = q, p
    whole = "decimal(38,0)"
    over, under = value.cast(whole) * F.lit(2 * p).cast(whole) + F.lit(q).cast(whole), F.lit(2 * q).cast(whole)
    return ((over - F.pmod(over, under)) / under).cast("long")


def candidates(d, c: Column, fraction: float = FRACTION, ratio: float = RATIO) -> Column:
    """array of the moves from c in one dimension, lower first, whether or not they are in bounds; null where there's no such step."""
    if d.count == 1:
        return F.array().cast("array<bigint>")
    if isinstance(d, Boolean):
        return F.array(~c)
    if isinstance(d, Categorical):
        return F.filter(F.array(*map(F.lit, d.choices)), lambda x: x != c)
    if isinstance(d, Integer) and d.log:
        return F.array(_rounded(c, ratio, False), _rounded(c, ratio, True))
    if isinstance(d, Integer):
        return F.array(c - d.step, c + d.step)
    if isinstance(d, Real) and d.step is not None:
        i = d.index(c)
        return F.transform(F.array(i - 1, i + 1), lambda k: F.when((k >= 0) & (k < d.count), d.value(F.greatest(F.least(k, F.lit(d.count - 1)), F.lit(0)))))
    if d.log:
        return F.array(c / ratio, c * ratio)
    delta = fraction * (d.high - d.low)
    return F.array(c - delta, c + delta)


def _outside(d, x: Column) -> Column:
    return F.lit(False) if isinstance(d, (Boolean, Categorical)) else x.isNull() | (x < d.low) | (x > d.high)


def moves(d, c: Column, fraction: float = FRACTION, ratio: float = RATIO) -> Column:
    """array of values next to c in one dimension that are in bounds and not c: one step either way, the other truth value, every other choice."""
    return F.filter(candidates(d, c, fraction, ratio), lambda x: (x != c) & ~_outside(d, x))


def neighbours(centres: DataFrame, space: Space, fraction: float = FRACTION, ratio: float = RATIO) -> DataFrame:
    """centre, dimension and the dimensions: every vector one move away that is in bounds and not the centre itself."""
    out = None
    for d in space.dimensions:
        if d.count == 1:
            continue
        new = centres.withColumn("_to", F.explode(moves(d, F.col(f"`{d.name}`"), fraction, ratio)))
        part = new.select("centre", F.lit(d.name).alias("dimension"), *(F.col("_to").alias(n) if n == d.name else F.col(f"`{n}`") for n in space.names))
        out = part if out is None else out.union(part)
    return out


def dropped(centres: DataFrame, space: Space, fraction: float = FRACTION, ratio: float = RATIO) -> DataFrame:
    """centre, dimension, bounds, same_as_centre: moves that leave the bounds, and moves that end where they began."""
    def of(d) -> DataFrame:
        c = F.col(f"`{d.name}`")
        every = candidates(d, c, fraction, ratio)
        same = F.size(F.filter(every, lambda x: x == c))
        bounds = F.size(F.filter(every, lambda x: F.coalesce(x != c, F.lit(True)) & _outside(d, x)))
        return centres.select("centre", F.lit(d.name).alias("dimension"), bounds.cast("long").alias("bounds"), same.cast("long").alias("same_as_centre"))

    return reduce(DataFrame.union, map(of, space.dimensions))


def cells(trials: DataFrame, space: Space) -> DataFrame:
    """dimensions, cell, objective, trial_id: what is known of each tried vector."""
    scored = (F.col("status").isin("ok", "constraint_violation")) & F.col("objective").isNotNull() & ~F.isnan("objective")
    cell = F.when(~scored, "unscorable").when(F.col("status") == "ok", "scored_ok").otherwise("scored_infeasible")
    g = trials.withColumn("_cell", cell).groupBy(*space.names)
    return g.agg(F.min_by("_cell", "trial_id").alias("cell"), F.min_by("objective", "trial_id").alias("objective"), F.min("trial_id").alias("trial_id"))


def disagreeing(trials: DataFrame, space: Space) -> DataFrame:
    """Vectors whose repeated trials differ in status or objective."""
    return trials.groupBy(*space.names).agg(F.count_distinct(F.struct("status", F.coalesce("objective", F.lit(float("nan"))))).alias("k"), F.min("trial_id").alias("trial_id")).where("k > 1")


def looked_up(asked: DataFrame, trials: DataFrame, space: Space) -> DataFrame:
    """asked with cell (never_evaluated if it wasn't tried), objective, trial_id."""
    wanted = asked.select(*space.names).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    known = cells(trials.join(wanted, space.names, "left_semi"), space)
    return asked.join(known, space.names, "left").withColumn("cell", F.coalesce("cell", F.lit("never_evaluated")))


def top(trials: DataFrame, space: Space, k: int, minimize: bool = False) -> DataFrame:
    """centre (1 is the best), trial_id, objective and the dimensions: the best k distinct vectors."""
    c = cells(trials.where("status = 'ok'"), space).where("cell = 'scored_ok'")
    order = [F.col("objective").asc() if minimize else F.col("objective").desc(), "trial_id"]
    return c.orderBy(*order).limit(k).withColumn("centre", F.row_number().over(Window.orderBy(*order))).select("centre", "trial_id", "objective", *space.names)


def near_best(trials: DataFrame, band: float, relative: bool = False, minimize: bool = False) -> DataFrame:
    """trials with best, the best objective of those that are ok, and near: whether their own is within the band of it."""
    best = trials.where("status = 'ok' and objective is not null and not isnan(objective)").agg((F.min if minimize else F.max)("objective").alias("best"))
    return _banded(trials.join(F.broadcast(best)), band, relative)  # one row


def _banded(rows: DataFrame, band: float, relative: bool) -> DataFrame:
    width = F.abs(F.col("best")) * band if relative else F.lit(float(band))
    return rows.withColumn("near", F.abs(F.col("best") - F.col("objective")) <= width)


def profile(trials: DataFrame, space: Space, centres: DataFrame, band: float, relative: bool = False, minimize: bool = False) -> DataFrame:
    """One row per centre: its neighbours by cell, how many are near the best objective of all trials, the share near and the coverage."""
    best = trials.where("status = 'ok' and objective is not null and not isnan(objective)").agg((F.min if minimize else F.max)("objective").alias("best"))
    found = looked_up(neighbours(centres, space), trials, space).join(F.broadcast(best))
    found = _banded(found, band, relative)
    near = (F.col("cell") == "scored_ok") & F.col("near")

    def count(what: str) -> Column:
        return F.sum((F.col("cell") == what).cast("long"))

    g = found.groupBy("centre").agg(
        F.count("*").alias("geometric"), count("scored_ok").alias("ok"), count("scored_infeasible").alias("infeasible"), count("unscorable").alias("unscorable"),
        count("never_evaluated").alias("never"), F.sum(near.cast("long")).alias("near"), F.max("best").alias("best"),
    )
    scored = F.col("ok") + F.col("infeasible")
    return g.withColumn("share", F.when(scored > 0, F.col("near") / scored)).withColumn("coverage", (F.col("geometric") - F.col("never")) / F.col("geometric"))


def missing(trials: DataFrame, space: Space, centres: DataFrame) -> DataFrame:
    """Distinct neighbours that were never tried."""
    return looked_up(neighbours(centres, space), trials, space).where("cell = 'never_evaluated'").select(*space.names).distinct()


# ---- Pairs of dimensions -----------------------------------------------------


def pair_ranking(trials: DataFrame, space: Space, centres: DataFrame, band: float, k: int, minimize: bool = False) -> DataFrame:
    """first, second, score: the k pairs of dimensions with most neighbours that aren't near the best, ties by name."""
    best = trials.where("status = 'ok' and objective is not null").agg((F.min if minimize else F.max)("objective").alias("best"))
    found = looked_up(neighbours(centres, space), trials, space).join(F.broadcast(best))
    near = (F.col("cell") == "scored_ok") & (F.abs(F.col("best") - F.col("objective")) <= band)
    far = found.groupBy("dimension").agg(F.sum((F.col("cell").isin("scored_ok", "scored_infeasible") & ~near).cast("long")).alias("far"))
    a, b = far.select(F.col("dimension").alias("first"), F.col("far").alias("fa")), far.select(F.col("dimension").alias("second"), F.col("far").alias("fb"))
    return a.join(b, F.col("first") < F.col("second")).select("first", "second", (F.col("fa") + F.col("fb")).alias("score")).orderBy(F.col("score").desc(), "first", "second").limit(k)


def pair_map(trials: DataFrame, space: Space, centres: DataFrame, first: str, second: str) -> DataFrame:
    """centre, first and second's values around it, role (centre, axis, diagonal), cell, objective."""
    by = {d.name: d for d in space.dimensions}

    def reached(name: str) -> Column:
        d, c = by[name], F.col(f"`{name}`")
        around = F.concat(F.array(c), moves(d, c))
        return around

    rows = centres.withColumn("_a", F.explode(reached(first))).withColumn("_b", F.explode(reached(second)))
    moved = (F.col("_a") != F.col(f"`{first}`")).cast("int") + (F.col("_b") != F.col(f"`{second}`")).cast("int")
    role = F.when(moved == 0, "centre").when(moved == 1, "axis").otherwise("diagonal")
    asked = rows.select("centre", role.alias("role"), *(F.col("_a").alias(n) if n == first else F.col("_b").alias(n) if n == second else F.col(f"`{n}`") for n in space.names))
    return looked_up(asked.distinct(), trials, space).select("centre", first, second, "role", "cell", "objective")
