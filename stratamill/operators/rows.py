"""Trial rows: validation, context, eligibility, exclusions, best rows, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.types import STATUSES, Refusal


def row_defects(trials: DataFrame) -> DataFrame:
    """Rows that break an invariant of a trial row, with the first reason."""
    finite = F.col("objective").isNotNull() & ~F.isnan("objective") & (F.abs("objective") != F.lit(float("inf")))
    reason = (
        F.when(F.col("trial_id").isNull() | (F.col("trial_id") < 0), "trial_id")
        .when(F.col("status").isNull() | ~F.col("status").isin(*STATUSES), "status")
        .when(F.col("feasible").isNull() | (F.col("feasible") != (F.col("status") == "ok")), "feasible")
        .when(F.col("status").isin("ok", "constraint_violation") & ~finite, "objective")
    )
    return trials.withColumn("reason", reason).where("reason is not null")


def repeated_ids(trials: DataFrame, by: tuple[str, ...] = ("source_index", "trial_id")) -> DataFrame:
    return trials.groupBy(*by).agg(F.count("*").alias("times")).where("times > 1")


def admit(trials: DataFrame) -> None:
    """One job for all checks; the first that fails in this order is refused."""
    bad = row_defects(trials).groupBy("reason").agg(F.count("*").alias("n"), F.min("trial_id").alias("id")).collect()
    found = {r["reason"]: r for r in bad}
    for reason in ("trial_id", "status", "feasible", "objective"):
        if reason in found:
            raise Refusal(f"row_{reason}", f"{found[reason]['n']} rows, first {found[reason]['id']}")
    if twice := repeated_ids(trials).limit(1).collect():
        raise Refusal("row_repeated", str(twice[0]["trial_id"]))


def context_mismatches(trials: DataFrame, facts: list[str]) -> DataFrame:
    """`ok` rows whose recorded facts differ from those of the source's first `ok` row."""
    ok = trials.where("status = 'ok'")
    first = ok.groupBy("source_index").agg(F.min_by(F.struct(*facts), "trial_id").alias("_first"))
    differs = ~F.struct(*facts).eqNullSafe(F.col("_first"))
    return ok.join(first, "source_index").where(differs).drop("_first")


def exclusion(metrics: list[str], statuses: tuple[str, ...] = ("ok",), of: str = "metrics") -> Column:
    """The first reason why a row can't be used, or null: its status, a metric that isn't recorded, one that has no value."""
    out = F.when(~F.col("status").isin(*statuses), F.concat(F.lit("status_"), F.col("status")))
    for m in metrics:
        out = out.when(~F.coalesce(F.map_contains_key(of, F.lit(m)), F.lit(False)), "metric_not_recorded")
    for m in metrics:
        v = F.col(of)[m]
        out = out.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), "metric_unavailable")
    return out


def exclusions(trials: DataFrame, reason: Column) -> DataFrame:
    """reason, n, smallest and largest id of the excluded rows."""
    return trials.select("trial_id", reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min("trial_id").alias("first_id"), F.max("trial_id").alias("last_id"))


def best(trials: DataFrame, k: int = 1, minimize: bool = False) -> DataFrame:
    """The k best `ok` rows by objective, ties to the lower id: a top-k, no full sort."""
    ok = trials.where("status = 'ok' and objective is not null and not isnan(objective)")
    return ok.orderBy(F.col("objective").asc() if minimize else F.col("objective").desc(), "trial_id").limit(k)


def coverage(trials: DataFrame, vector: list[str]) -> DataFrame:
    """One row: counts by status, and distinct vectors tried."""
    counts = [F.sum((F.col("status") == s).cast("long")).alias(s) for s in STATUSES]
    return trials.agg(F.count("*").alias("trials"), F.count_distinct(*vector).alias("vectors"), F.min("trial_id").alias("first_id"), F.max("trial_id").alias("last_id"), *counts)
