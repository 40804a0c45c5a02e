"""Deflated Sharpe ratio of a selected trial among all that were tried."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.operators import exact
from stratamill.types import Refusal

#: Euler-Mascheroni constant (fixed value).
GAMMA = 0.57721566490153286


#: The largest count of returns that a row may state (fixed value).
MOST_COUNT = 1 << 53


def reasons(stats: DataFrame) -> DataFrame:
    """stats (key, sharpe_per_period, count, skew, kurt_raw, status) with `reason`: the first cause why a row can't be used, null if it can."""

    def odd(c):
        return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))

    missing = F.col("status").isNull() | F.col("count").isNull()
    reason = (
        F.when(missing, "missing")
        .when(F.col("status") != 0, F.concat(F.lit("status_"), F.col("status").cast("string")))
        .when((F.col("count") < 2) | (F.col("count") > MOST_COUNT), "count")
        .when(odd("sharpe_per_period") | odd("skew") | odd("kurt_raw"), "not_finite")
    )
    return stats.withColumn("reason", reason)


def eligible(stats: DataFrame) -> DataFrame:
    """Rows that have what is needed: status 0, a count of 2 to MOST_COUNT, finite figures."""
    return reasons(stats).where("reason is null").drop("reason")


def expected_maximum(variance: float, trials: int) -> float:
    """The Sharpe ratio that the best of `trials` without skill is expected to show."""
    q = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - GAMMA) * q(1 - 1 / trials) + GAMMA * q(1 - 1 / (trials * math.e)))


def deflated(sharpe: float, count: int, skew: float, kurt: float, variance: float, trials: int) -> dict:
    sr0 = expected_maximum(variance, trials)
    den = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    if den <= 0:
        raise Refusal("denominator", str(den))
    z = (sharpe - sr0) * math.sqrt(count - 1) / math.sqrt(den)
    return {"variance": variance, "sr0": sr0, "den": den, "z": z, "dsr": NormalDist().cdf(z)}


def sharpe_variance(good: DataFrame) -> exact.Exact:
    """Count, mean and sample variance of the Sharpe ratios of eligible rows, exactly: a last bit doesn't depend on which task came first."""
    return exact.collected(exact.sums(good, "sharpe_per_period"))


def dsr(stats: DataFrame, selected, trials: int | None = None) -> dict:
    """selected: a key of stats. trials: how many were tried, all rows of stats if not given. Only sums leave the executors."""
    good = eligible(stats)
    pick = good.where(F.col("key") == selected).limit(1).collect()
    if not pick:
        raise Refusal("selected_not_eligible", str(selected))
    found = sharpe_variance(good)
    if found.n < 2:
        raise Refusal("too_few_eligible", str(found.n))
    variance = exact.rounded(found.variance())
    if not variance > 0:
        raise Refusal("zero_variance", f"{found.n} rows of one Sharpe ratio")
    top = good.agg(F.max("sharpe_per_period")).first()[0]
    n = trials or stats.count()
    if n < 2:
        raise Refusal("trials", str(n))
    p = pick[0]
    out = deflated(p["sharpe_per_period"], p["count"], p["skew"], p["kurt_raw"], variance, n)
    return out | {"trials": n, "eligible": found.n, "selected_is_max": p["sharpe_per_period"] == top}
