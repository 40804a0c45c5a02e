"""Parzen estimation from a whole history, however long it is.

What tpe.Parzen makes of a list, here comes from a table. Observations of one place are
counted together, as many trials share a value: of those at one place, in the order of
their ids, the first reaches to the place below, the last to the one above, and those
between have no width of their own. So neighbour gaps are those of distinct places,
which are found by ranges of [0, 1], and a place that holds a third of all rows is one
row. Densities and masses are sums over the places: tasks add them up for a bounded
list of points, and only those sums leave the executors. The good observations are
MOST_GOOD at most; proposals are drawn from them on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.operators.ordered import neighbours_within
from stratamill.plans.samplers import draw
from stratamill.plans.space import Boolean, Categorical, Space
from stratamill.plans.tpe import DRAWN, STARTUP, Parzen, Tpe, encoded, log_interval, smoothed, split_rows, weighted_bad, weights
from stratamill.storage import cut_lineage, written

#: Ranges of [0, 1] in which places are sorted.
RANGES = 4096
#: Normals that are held against the points at once.
TOGETHER = 2048
#: Widths beyond which a normal adds nothing to a sum, and beyond which none of it lies outside.
FAR, WHOLE = 16, 9


def places(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, x, n, low, high, first, last, between of rows (keys, id, x, weight): the distinct places, the gaps to those below and above (that at an end of the line is the other one), and what the first, the last and the others there weigh.

    A place with one row has `first` alone, as wide as the larger gap.
    """
    keys = keys or ["_none"]
    own = rows if keys != ["_none"] else rows.withColumn("_none", F.lit(0))
    g = own.groupBy(*keys, "x").agg(F.count("*").alias("n"), F.min_by("weight", "id").alias("first"), F.max_by("weight", "id").alias("_last"), F.sum("weight").alias("_all"))
    g = written(g).withColumn("_r", F.floor(F.col("x") * RANGES))  # what follows reads the places more than once, and the rows are read for them alone
    g = neighbours_within(g, keys, "_r", "x", "_below", "_above")
    low, high = F.col("x") - F.col("_below"), F.col("_above") - F.col("x")
    several = F.col("n") > 1
    out = g.select(
        *keys, "x", "n", low.alias("_low"), high.alias("_high"), "first", F.when(several, F.col("_last")).otherwise(0.0).alias("last"),
        F.when(F.col("n") > 2, F.col("_all") - F.col("first") - F.col("_last")).otherwise(0.0).alias("between"),
    )
    # The lowest of several at the line's lower end has its gap to the next, which is 0; so has the highest at the upper end.
    other = F.when(several, 0.0)
    out = out.withColumns({"low": F.coalesce("_low", other, "_high"), "high": F.coalesce("_high", other, "_low")})
    return out.select(*(k for k in keys if k != "_none"), "x", "n", "low", "high", "first", "last", "between")


def components(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, mean, sigma, weight of the normals of places(), before the weights are shared out; widths lie between 1 / min(100, n + 2) and 1."""
    keys = keys or []
    total = table.groupBy(*keys).agg(F.sum("n").alias("_n")) if keys else table.agg(F.sum("n").alias("_n"))
    j = table.join(F.broadcast(total), keys) if keys else table.join(F.broadcast(total))  # a row for each key
    least = 1 / F.least(F.lit(100), F.col("_n") + 2)
    single = F.when(F.col("_n") == 1, F.greatest(F.col("x"), 1 - F.col("x"))).otherwise(F.greatest("low", "high"))

    def normal(width, weight):
        return F.struct(F.least(F.greatest(width, least), F.lit(1.0)).alias("sigma"), weight.alias("weight"))

    parts = F.when(F.col("n") == 1, F.array(normal(single, F.col("first")))).otherwise(
        F.array(normal(F.col("low"), F.col("first")), normal(F.lit(0.0), F.col("between")), normal(F.col("high"), F.col("last")))
    )
    out = j.select(*keys, F.col("x").alias("mean"), F.explode(parts).alias("p")).select(*keys, "mean", "p.sigma", "p.weight")
    return out.where("weight > 0")


def _sums(points, masses):
    """Sums over a task's normals of weight x density at points, or of weight x mass of intervals, by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        weight: dict[str, float] = {}
        for batch in batches:
            names = np.array(batch.column("dimension").to_pylist(), object)
            mean, sigma, w = (batch.column(c).to_numpy() for c in ("mean", "sigma", "weight"))
            for name in dict.fromkeys(names.tolist()):
                at = np.flatnonzero(names == name)
                at = at[np.argsort(mean[at], kind="stable")]
                weight[name] = weight.get(name, 0.0) + float(w[at].sum())
                asked = points.value[name]
                low, high = (asked[:, 0], asked[:, 1]) if masses.value[name] else (asked, asked)
                own = total.setdefault(name, np.zeros(len(asked)))
                for part in np.array_split(at, max(1, -(-len(at) // TOGETHER))):
                    m, s = mean[part], sigma[part]
                    # Neighbours reach as far; what is further away than FAR is less than a double's last bit.
                    near = np.flatnonzero((high >= m[0] - FAR * s.max()) & (low <= m[-1] + FAR * s.max()))
                    inside, edge = np.zeros(len(part)), np.flatnonzero((m < WHOLE * s) | (1 - m < WHOLE * s))
                    inside[edge] = log_interval(-m[edge] / s[edge], (1 - m[edge]) / s[edge])
                    m, s, inside = m[:, None], s[:, None], inside[:, None]
                    if masses.value[name]:
                        ln = log_interval((low[near] - m) / s, (high[near] - m) / s) - inside
                    else:
                        z = (asked[near] - m) / s
                        ln = -0.5 * z * z - np.log(s * math.sqrt(2 * math.pi)) - inside
                    own[near] += w[part] @ np.exp(ln)
        for name, x in total.items():
            yield pa.record_batch({"dimension": pa.array([name] * (len(x) + 1)), "point": pa.array(np.arange(-1, len(x)), pa.int32()), "value": pa.array(np.append(weight[name], x))})

    return run


def log_densities(normals: DataFrame, points: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """ln of the mixtures' densities, by dimension; normals: dimension, mean, sigma, weight. Points (a list, or rows of intervals, whose masses are taken) are bounded and sent to every task; the wide prior is added here."""
    sc = normals.sparkSession.sparkContext
    masses = {k: np.ndim(v) == 2 for k, v in points.items()}
    found = normals.where(F.col("dimension").isin(list(points))).mapInArrow(_sums(sc.broadcast(points), sc.broadcast(masses)), "dimension string, point int, value double")
    sums = {(r["dimension"], r["point"]): r["value"] for r in found.groupBy("dimension", "point").agg(F.sum("value").alias("value")).collect()}  # a row for each point
    out = {}
    for name, asked in points.items():
        asked = np.asarray(asked, float)
        prior = log_interval(np.array(-0.5), np.array(0.5))
        if masses[name]:
            wide = np.exp(log_interval(asked[:, 0] - 0.5, asked[:, 1] - 0.5) - prior)
        else:
            wide = np.exp(-0.5 * (asked - 0.5) ** 2 - 0.5 * math.log(2 * math.pi) - prior)
        own = np.array([sums.get((name, i), 0.0) for i in range(len(asked))])
        with np.errstate(divide="ignore"):
            out[name] = np.log((own + wide) / (sums.get((name, -1), 0.0) + 1.0))
    return out


def numeric(space: Space) -> list:
    return [d for d in space.dimensions if d.count != 1 and not isinstance(d, (Boolean, Categorical))]


def bad_normals(history: DataFrame, space: Space, minimize: bool = False) -> DataFrame:
    """dimension, mean, sigma, weight of the normals of all observations that aren't good; history: trial_id, objective, dimensions."""
    h = history.withColumn("_v", -F.col("objective") if minimize else F.col("objective"))
    bad = weighted_bad(h.select("trial_id", "_v", *(f"`{d.name}`" for d in numeric(space))), "_v")
    axes = F.explode(F.array(*(F.struct(F.lit(d.name).alias("dimension"), encoded(d, F.col(f"`{d.name}`")).alias("x")) for d in numeric(space))))
    rows = bad.select(F.col("trial_id").alias("id"), "weight", axes.alias("a")).select("id", "weight", "a.*")
    return components(places(rows, ["dimension"]), ["dimension"])


def proposals(space: Space, history: DataFrame, k: int, seed: int, minimize: bool = False) -> list[dict]:
    """k proposals from a whole history (trial_id, objective, dimensions), with one pass over it.

    Each takes the best of DRAWN draws from the good observations, as Tpe does; what is drawn for
    all of them is held against the other observations at once, so they don't see each other.
    """
    tpe = Tpe(space, seed, minimize)
    n = history.count()
    if n < max(STARTUP, 2):
        return [tpe.ask() for _ in range(k)]
    h = cut_lineage(history.select("trial_id", "objective", *space.names))
    good = split_rows(h.withColumn("_v", -F.col("objective") if minimize else F.col("objective")), "_v").where("good").orderBy("trial_id").collect()  # MOST_GOOD at most
    w = weights(len(good))
    drawn: dict[str, list] = {}
    ratio: dict[str, np.ndarray] = {}
    points: dict[str, np.ndarray] = {}
    for d in space.dimensions:
        if d.count == 1:
            drawn[d.name], ratio[d.name] = [draw(d, tpe.rng)] * (k * DRAWN), np.zeros(k * DRAWN)
        elif isinstance(d, (Boolean, Categorical)):
            values = [tpe._encode(d, r[d.name]) for r in good]
            share = smoothed(np.array([w[[int(v) == c for v in values]].sum() for c in range(d.count)]), len(good))
            picks = [min(int(np.searchsorted(np.cumsum(share), tpe.rng.unit())), d.count - 1) for _ in range(k * DRAWN)]
            drawn[d.name] = [bool(c) if isinstance(d, Boolean) else d.choices[c] for c in picks]
            ratio[d.name] = np.log(share[picks]) - np.log(bad_choices(h, d, minimize)[picks])
        else:
            model = Parzen(np.array([tpe._encode(d, r[d.name]) for r in good]), w)
            drawn[d.name] = [tpe._decode(d, model.draw(tpe.rng)) for _ in range(k * DRAWN)]
            parts = [tpe._bin(d, v) for v in drawn[d.name]]
            if parts[0]:
                points[d.name] = np.array(parts)
                ratio[d.name] = np.array([model.log_mass(*p) for p in parts])
            else:
                points[d.name] = np.array([tpe._encode(d, v) for v in drawn[d.name]])
                ratio[d.name] = np.array([model.log_density(x) for x in points[d.name].tolist()])
    for name, ln in (log_densities(bad_normals(h, space, minimize), points) if points else {}).items():
        ratio[name] = ratio[name] - ln
    totals = sum(ratio.values()).reshape(k, DRAWN)
    best = totals.argmax(1) + DRAWN * np.arange(k)
    return [{n: drawn[n][i] for n in space.names} for i in best.tolist()]


def bad_choices(history: DataFrame, d, minimize: bool = False) -> np.ndarray:
    """Smoothed probabilities of a dimension's choices among the observations that aren't good: weights are summed by choice."""
    h = history.withColumn("_v", -F.col("objective") if minimize else F.col("objective"))
    bad = weighted_bad(h.select("trial_id", "_v", f"`{d.name}`"), "_v")
    found = {r["c"]: (r["w"], r["n"]) for r in bad.groupBy(F.col(f"`{d.name}`").alias("c")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}  # a row for each choice
    choices = (False, True) if isinstance(d, Boolean) else d.choices
    return smoothed(np.array([found.get(c, (0.0, 0))[0] for c in choices]), sum(n for _, n in found.values()))
