"""Statistics of equity curves: returns by bar and by month, their moments, and moments of equal blocks.

A curve is rows (key, idx, time_ms, equity) with idx 0, 1, 2, ... per key. Nothing
collects a curve: moments are two rounds of partial sums, the mean and then powers
of the distance from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamill.operators.ordered import lag_within

#: Interval indices per task block when the row before is looked up.
BLOCK = 1 << 16
YEAR_MS = 365.25 * 24 * 3600 * 1000
RISK_FREE = 0.02
MOMENTS = ("count", "skipped", "periods_per_year", "mean", "std", "sharpe_per_period", "skew", "kurt_raw", "status")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def bar_returns(curve: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, idx, time_ms, prior, equity, r, skipped for every interval. A prior of 0 or less is skipped (r is null)."""
    rows = lag_within(curve.withColumn("_block", F.floor(F.col("idx") / block)), ["key"], "_block", ["idx"], "equity", "prior").drop("_block")
    skipped = F.col("prior") <= 0
    return rows.where("idx > 0").withColumn("skipped", skipped).withColumn("r", F.when(~skipped, F.col("equity") / F.col("prior") - 1))


def month(time_ms: Column) -> Column:
    """Months since year 0, UTC."""
    at = F.timestamp_millis(time_ms)
    return F.year(at) * 12 + F.month(at) - 1


def monthly_points(curve: DataFrame) -> DataFrame:
    """key, idx, time_ms, equity: the last point of each UTC month, numbered anew. Months without a point aren't filled."""
    last = curve.groupBy("key", month(F.col("time_ms")).alias("month")).agg(F.max_by("equity", "idx").alias("equity"), F.max_by("time_ms", "idx").alias("time_ms"))
    return last.withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("month")) - 1).select("key", "idx", "time_ms", "equity", "month")


def monthly_returns(curve: DataFrame) -> DataFrame:
    return bar_returns(monthly_points(curve))


def _moments(returns: DataFrame) -> DataFrame:
    """key, n, skipped, bad, mean, s2, s3, s4 (sums of powers about the mean)."""
    first = returns.groupBy("key").agg(
        F.count("r").alias("n"), F.sum(F.col("skipped").cast("long")).alias("skipped"), F.avg("r").alias("mean"), F.max((F.col("r").isNotNull() & ~finite(F.col("r"))).cast("int")).alias("bad")
    )
    d = F.col("r") - F.col("mean")
    powers = returns.where("r is not null").join(first.select("key", "mean"), "key").groupBy("key").agg(F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3"), F.sum(d * d * d * d).alias("s4"))
    return first.join(powers, "key", "left")


def periods_per_year(curve: DataFrame) -> DataFrame:
    """key, periods: (points - 1) / span in years, null below 3 points or without a span."""
    span = (F.max("time_ms") - F.min("time_ms")) / F.lit(YEAR_MS)
    g = curve.groupBy("key").agg(F.count("*").alias("points"), span.alias("span"), F.max((~finite(F.col("equity"))).cast("int")).alias("bad_equity"))
    return g.select("key", "points", "bad_equity", F.when((F.col("points") >= 3) & (F.col("span") > 0), (F.col("points") - 1) / F.col("span")).alias("periods"))


def return_stats(curve: DataFrame, monthly: bool = False, utc: bool = True) -> DataFrame:
    """One row per key with MOMENTS.

    status, the first that holds: 4 non-finite equity, 7 months of a chart that isn't
    in UTC, 8 non-finite return, 6 period not to be had, 1 too few returns, 2 no
    spread, 0 all fields are there.
    """
    returns = monthly_returns(curve) if monthly else bar_returns(curve)
    periods = periods_per_year(curve)
    if monthly:
        periods = periods.withColumn("periods", F.lit(12.0))
    j = periods.join(_moments(returns), "key", "left")
    n = F.coalesce("n", F.lit(0))
    std = F.when(n >= 2, F.sqrt(F.col("s2") / (n - 1)))
    excess = F.col("mean") - F.lit(RISK_FREE) / F.col("periods")
    usable = (F.col("bad_equity") == 0) & F.lit(utc or not monthly) & (F.coalesce("bad", F.lit(0)) == 0)

    def only(c: Column) -> Column:
        return F.when(usable, c)

    spread = F.col("s2") > 0
    fields = {
        "count": n,
        "skipped": F.coalesce("skipped", F.lit(0)),
        "periods_per_year": F.col("periods"),
        "mean": only(F.when(n >= 1, F.col("mean"))),
        "std": only(std),
        "sharpe_per_period": only(F.when(std > 0, excess / std)),
        "skew": only(F.when((n >= 3) & spread, (F.col("s3") / n) / F.pow(F.col("s2") / n, F.lit(1.5)))),
        "kurt_raw": only(F.when((n >= 4) & spread, (F.col("s4") / n) / F.pow(F.col("s2") / n, F.lit(2.0)))),
    }
    status = (
        F.when(F.col("bad_equity") == 1, 4)
        .when(F.lit(monthly and not utc), 7)
        .when(F.coalesce("bad", F.lit(0)) == 1, 8)
        .when(F.col("periods").isNull(), 6)
        .when(n < 4, 1)
        .when(~spread, 2)
        .otherwise(0)
    )
    return j.select("key", *(c.alias(k) for k, c in fields.items()), status.alias("status"))


def block_layout(curve: DataFrame, blocks: int) -> DataFrame:
    """key, block, first_interval, n: `blocks` even shares of a curve's K intervals. Interval k is in block floor(k blocks / K)."""
    sizes = curve.groupBy("key").agg((F.count("*") - 1).alias("k")).where((F.col("k") >= blocks) & (F.floor(F.col("k") / blocks) * (blocks // 2) >= 2))
    b = sizes.select("key", "k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    opens = F.ceil(F.col("block") * F.col("k") / F.lit(blocks))
    return b.select("key", "block", opens.alias("first_interval"), (F.ceil((F.col("block") + 1) * F.col("k") / F.lit(blocks)) - opens).alias("n"))


def block_moments(curve: DataFrame, blocks: int) -> DataFrame:
    """key, block, n, s, m2: count, sum and centred second moment of each block's returns."""
    if blocks < 2 or blocks % 2:
        raise ValueError("blocks must be even and at least 2")
    returns = bar_returns(curve)
    sizes = curve.groupBy("key").agg((F.count("*") - 1).alias("k")).where((F.col("k") >= blocks) & (F.floor(F.col("k") / blocks) * (blocks // 2) >= 2))
    placed = returns.join(sizes, "key").withColumn("block", F.expr(f"cast(((idx - 1) * {blocks}) div k as int)"))
    first = placed.groupBy("key", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.max(F.col("skipped").cast("int")).alias("skips"))
    d = F.col("r") - F.col("s") / F.col("n")
    second = placed.join(first, ["key", "block"]).groupBy("key", "block").agg(F.sum(d * d).alias("m2"))
    return first.join(second, ["key", "block"]).select("key", "block", "n", "s", F.when(F.col("n") == 1, 0.0).otherwise(F.col("m2")).alias("m2"), (F.col("skips") == 1).alias("non_positive"))


def layout_disagreements(layouts: DataFrame) -> DataFrame:
    """key, of rows (key, block, first_interval, n) of a key whose layout isn't that of the lowest key."""
    whole = layouts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "first_interval", "n"))).alias("layout"))  # one element per block
    owner = whole.agg(F.min_by("layout", "key").alias("own"))
    return whole.join(F.broadcast(owner)).where(F.col("layout") != F.col("own")).select("key")
