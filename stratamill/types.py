"""Schemas, statuses and refusals shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

#: Terminal statuses of a trial (fixed values).
STATUSES = (
    "ok",
    "constraint_violation",
    "objective_error",
    "constraint_error",
    "engine_error",
    "trial_error",
    "trial_timeout",
    "pruned",
    "partial",
)

BAR = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")),
    ]
)

TRIAL = T.StructType(
    [
        T.StructField("trial_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("feasible", T.BooleanType()),
        T.StructField("objective", T.DoubleType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("backtest", T.MapType(T.StringType(), T.LongType())),
        T.StructField("space_hash", T.StringType()),
    ]
)


class Refusal(ValueError):
    """An input that an operator won't work on. code is one of a closed list per operator."""

    def __init__(self, code: str, detail: str = "", **context):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail, self.context = code, detail, context
