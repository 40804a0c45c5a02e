"""Tree-structured Parzen estimation on the driver: it proposes, Spark evaluates.

Fixed values of the method: 10 startup trials, the best 10 % (25 at most) are good,
the newest 25 observations weigh in full and older ones along a ramp, 24 candidates
are drawn from the good model and the one with the best ratio of densities is taken.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.operators.ranks import in_order
from stratamill.plans.samplers import Twister, draw
from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space

STARTUP, GAMMA, MOST_GOOD, FULL, DRAWN = 10, 0.10, 25, 25, 24


def weights(n: int) -> np.ndarray:
    if n < FULL:
        return np.ones(n)
    ramp = np.linspace(1 / n, 1, n - FULL) if n - FULL > 1 else np.full(n - FULL, 1 / n)
    return np.concatenate([ramp, np.ones(FULL)])


def _weight(before: Column, n: int) -> Column:
    """weights() of n observations, of which `before` are older."""
    ramp = 1 / n + before * ((1 - 1 / n) / max(n - FULL - 1, 1)) if n else F.lit(1.0)
    return F.when(before < n - FULL, ramp).otherwise(1.0)


def weighted(trials: DataFrame, key: str = "trial_id") -> DataFrame:
    """trials and their `weight`, as weights() gives it in the order of key, which is unique."""
    rows = in_order(trials, key, "_before")
    return rows.withColumn("weight", _weight(F.col("_before"), rows.count())).drop("_before")


def weighted_bad(trials: DataFrame, objective: str = "objective", key: str = "trial_id") -> DataFrame:
    """The trials that split_rows() doesn't call good, weighted() among themselves; all of them are ordered and written once."""
    rows = in_order(trials, key, "_before")
    n = rows.count()
    good = _good(rows, objective, key, n)
    older = F.col("_before") - sum(((F.col(key) > g).cast("long") for g in good), F.lit(0).cast("long"))
    bad = rows.where(~F.col(key).isin(good)) if good else rows
    return bad.withColumn("weight", _weight(older, n - len(good))).drop("_before")


def split_size(n: int) -> int:
    """How many of n observations are good."""
    return min(max(1, math.ceil(GAMMA * n)), MOST_GOOD, n - 1)


def split(scores: list[tuple[float, int]]) -> tuple[list[int], list[int]]:
    """Ids of good and other observations, from (score, id); higher is better and ties go to the lower id."""
    order = [i for _, i in sorted(scores, key=lambda x: (-x[0], x[1]))]
    good = split_size(len(order))
    return sorted(order[:good]), sorted(order[good:])


def _good(trials: DataFrame, objective: str, key: str, n: int) -> list:
    """Keys of the good ones of n trials: the best rows by the objective, ties to the lower key, MOST_GOOD at most."""
    best = trials.orderBy(F.col(objective).desc(), key).limit(MOST_GOOD).select(key, objective).collect()
    return [r[key] for r in sorted(best, key=lambda r: (-r[objective], r[key]))[: max(0, split_size(n))]]


def split_rows(trials: DataFrame, objective: str = "objective", key: str = "trial_id") -> DataFrame:
    """trials with `good`, as split() tells it: the good keys are sent to all others; they are MOST_GOOD at most."""
    good = _good(trials, objective, key, trials.count())
    return trials.withColumn("good", F.col(key).isin(good) if good else F.lit(False))


_erfc = np.frompyfunc(math.erfc, 1, 1)


def log_phi(x: np.ndarray) -> np.ndarray:
    """ln of the normal distribution function, by its series far below where erfc is 0."""
    x = np.asarray(x, float)
    far = x < -12
    y = np.where(far, x, -12.0)
    z = 1 / (y * y)
    tail = -0.5 * y * y - np.log(-y) - 0.5 * math.log(2 * math.pi) + np.log1p(-z * (1 - 3 * z * (1 - 5 * z * (1 - 7 * z * (1 - 9 * z)))))
    return np.where(far, tail, np.log(0.5 * np.asarray(_erfc(-np.where(far, 0.0, x) / math.sqrt(2)), float)))


def log_interval(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """ln of the normal mass between low and high, taken in the tail where both lie."""
    low, high = np.broadcast_arrays(np.asarray(low, float), np.asarray(high, float))
    above = low > 0
    a, b = np.where(above, -high, low), np.where(above, -low, high)
    with np.errstate(divide="ignore"):
        return log_phi(b) + np.log1p(-np.exp(np.minimum(log_phi(a) - log_phi(b), 0)))


#: Terms so far below the largest don't count in a sum of logarithms (fixed value).
CUT = -128.0


def log_sum(x: np.ndarray) -> float:
    top = float(x.max())
    return top + math.log(float(np.exp(x[x - top >= CUT] - top).sum())) if math.isfinite(top) else top


class Parzen:
    """A mixture of normals on [0, 1], each as wide as the gap to its neighbours, and a wide prior."""

    FIELDS = ("mean", "sigma", "weight")

    @classmethod
    def restored(cls, fields: dict[str, np.ndarray]) -> "Parzen":
        out = cls.__new__(cls)
        out.mean, out.sigma, out.weight = (fields[k] for k in cls.FIELDS)
        out._ready()
        return out

    def __init__(self, x: np.ndarray, w: np.ndarray):
        n = len(x)
        order = np.argsort(x, kind="stable")
        x, w = x[order], w[order]
        if n > 1:
            gap = np.diff(x)
            sigma = np.maximum(np.append(gap[:1], gap), np.append(gap, gap[-1:]))
        else:
            sigma = np.maximum(x, 1 - x)
        sigma = np.clip(sigma, 1 / min(100, n + 2), 1.0)
        self.mean, self.sigma = np.append(x, 0.5), np.append(sigma, 1.0)
        self.weight = np.append(w, 1.0) / (w.sum() + 1.0)
        self._ready()

    def _ready(self) -> None:
        self.log_mass_of = log_interval(-self.mean / self.sigma, (1 - self.mean) / self.sigma)
        with np.errstate(divide="ignore"):
            self.log_weight = np.log(self.weight)

    def draw(self, rng: Twister) -> float:
        k = min(int(np.searchsorted(np.cumsum(self.weight), rng.unit())), len(self.mean) - 1)
        for _ in range(128):
            u, v = max(rng.unit(), 2.0**-53), rng.unit()
            x = float(self.mean[k] + self.sigma[k] * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v))
            if 0 <= x <= 1:
                return x
        return rng.unit()

    def log_density(self, x: float) -> float:
        z = (x - self.mean) / self.sigma
        return log_sum(self.log_weight - 0.5 * z * z - np.log(self.sigma * math.sqrt(2 * math.pi)) - self.log_mass_of)

    def log_mass(self, low: float, high: float) -> float:
        return log_sum(self.log_weight + log_interval((low - self.mean) / self.sigma, (high - self.mean) / self.sigma) - self.log_mass_of)


def choice_mass(index: np.ndarray, w: np.ndarray, choices: int) -> np.ndarray:
    """Smoothed probabilities of the choices."""
    return smoothed(np.array([w[index == c].sum() for c in range(choices)]), len(index))


def smoothed(share: np.ndarray, observations: int) -> np.ndarray:
    """Probabilities of choices that `observations` gave these weights."""
    total, alpha, choices = 1.0 + share.sum(), 1.0 / (observations + 1), len(share)
    return (share.sum() * alpha + share) / (total * (1 + alpha * choices)) + (1.0 / total) / choices


def choice_masses(rows: DataFrame, choice: str, choices: tuple) -> DataFrame:
    """choice, n, mass: smoothed probabilities of all choices from rows (choice, weight), as smoothed() gives them; one row for each choice, summed in parts."""
    spark = rows.sparkSession
    found = rows.groupBy(choice).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    kind = rows.schema[choice].dataType.simpleString()
    every = spark.createDataFrame([(c,) for c in choices], f"`{choice}` {kind}").join(found, choice, "left").select(choice, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("_w"))
    alpha, k = 1 / (F.col("_n") + 1), len(choices)
    mass = (F.col("_w") * alpha + F.col("w")) / ((1 + F.col("_w")) * (1 + alpha * k)) + 1 / (1 + F.col("_w")) / k
    return every.join(F.broadcast(total)).select(choice, "n", mass.alias("mass"))


def encoded(d: Integer | Real, value: Column) -> Column:
    """The place of a numeric dimension's values in [0, 1], as columns."""
    if isinstance(d, Integer):
        i, a = F.floor((value - d.low) / d.step) + 0.5, d.low - 0.5
        return F.log1p(i / a) / math.log1p(d.count / a) if d.log else i / d.count
    if d.step is not None:
        return (F.round((value - d.low) / d.step) + 0.5) / d.count
    return F.ln(value / d.low) / math.log(d.high / d.low) if d.log else (value - d.low) / (d.high - d.low)


class Tpe:
    """ask() a vector, tell() its objective or abandon() it. pending vectors count as bad ones."""

    def __init__(self, space: Space, seed: int, minimize: bool = False):
        self.space, self.rng, self.minimize = space, Twister(seed), minimize
        self.seen: list[tuple[dict, float]] = []
        self.pending: list[dict] = []

    def _encode(self, d, v) -> float:
        if isinstance(d, (Boolean, Categorical)):
            return float(v) if isinstance(d, Boolean) else float(d.choices.index(v))
        if isinstance(d, Integer):
            i = (v - d.low) // d.step + 0.5
            a = d.low - 0.5
            return math.log1p(i / a) / math.log1p(d.count / a) if d.log else i / d.count
        if d.step is not None:
            return (round((v - d.low) / d.step) + 0.5) / d.count
        return math.log(v / d.low) / math.log(d.high / d.low) if d.log else (v - d.low) / (d.high - d.low)

    def _decode(self, d, x: float):
        if isinstance(d, Integer):
            a = d.low - 0.5
            i = a * math.expm1(x * math.log1p(d.count / a)) if d.log else x * d.count
            return d.low + d.step * min(max(int(i), 0), d.count - 1)
        if d.step is not None:
            return min(math.fma(min(int(x * d.count), d.count - 1), d.step, d.low), d.high)
        return min(max(d.low * (d.high / d.low) ** x if d.log else d.low + x * (d.high - d.low), d.low), d.high)

    def _bin(self, d, v) -> tuple[float, float] | None:
        """The part of [0, 1] that stands for a discrete value."""
        if isinstance(d, Integer):
            i, a = (v - d.low) // d.step, d.low - 0.5
            return tuple(math.log1p(e / a) / math.log1p(d.count / a) if d.log else e / d.count for e in (i, i + 1))
        if d.step is not None:
            i = round((v - d.low) / d.step)
            return i / d.count, (i + 1) / d.count
        return None

    def _dimension(self, d, good: list, bad: list) -> list[tuple[object, float]]:
        """DRAWN values from the good model, each with its log ratio."""
        g, b = (np.array([self._encode(d, v) for v in vs]) for vs in (good, bad))
        wg, wb = weights(len(g)), weights(len(b))
        if isinstance(d, (Boolean, Categorical)):
            pg, pb = (choice_mass(x.astype(int), w, d.count) for x, w in ((g, wg), (b, wb)))
            picks = [min(int(np.searchsorted(np.cumsum(pg), self.rng.unit())), d.count - 1) for _ in range(DRAWN)]
            return [(bool(c) if isinstance(d, Boolean) else d.choices[c], math.log(pg[c]) - math.log(pb[c])) for c in picks]
        mg, mb, out = Parzen(g, wg), Parzen(b, wb), []
        for _ in range(DRAWN):
            x = mg.draw(self.rng)
            v = self._decode(d, x)
            part = self._bin(d, v)
            out.append((v, mg.log_mass(*part) - mb.log_mass(*part) if part else mg.log_density(x) - mb.log_density(x)))
        return out

    def ask(self) -> dict:
        if len(self.seen) < max(STARTUP, 2):
            c = {d.name: draw(d, self.rng) for d in self.space.dimensions}
        else:
            sign = -1 if self.minimize else 1
            good, bad = split([(sign * s, i) for i, (_, s) in enumerate(self.seen)])
            drawn = {}
            for d in self.space.dimensions:
                if d.count == 1:
                    drawn[d.name] = [(draw(d, self.rng), 0.0)] * DRAWN
                else:
                    rest = [self.seen[i][0][d.name] for i in bad] + [p[d.name] for p in self.pending]
                    drawn[d.name] = self._dimension(d, [self.seen[i][0][d.name] for i in good], rest)
            totals = [sum(drawn[n][k][1] for n in self.space.names) for k in range(DRAWN)]
            k = totals.index(max(totals))
            c = {n: drawn[n][k][0] for n in self.space.names}
        self.pending.append(c)
        return c

    def tell(self, candidate: dict, objective: float) -> None:
        self.abandon(candidate)
        self.seen.append((candidate, objective))

    def abandon(self, candidate: dict) -> None:
        if candidate in self.pending:
            self.pending.remove(candidate)
