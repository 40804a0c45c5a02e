"""Studies: one job where proposals don't depend on results, batches where they do."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.functions.expr import Expression, Policy, columns, status
from stratamill.operators.evaluate import evaluate
from stratamill.operators.ordered import islands
from stratamill.plans.space import Space
from stratamill.types import Refusal


#: What a run that was begun gives back: a best trial exists, input or output failed, no trial is feasible, a trial took too long, the history was refused, the space has no more (fixed values).
EXITS = {"best": 0, "failed": 1, "infeasible": 2, "timeout": 3, "history_refused": 4, "exhausted": 5}


def exit_code(statuses: set[str], best: bool) -> int:
    """A timeout tells even where an earlier trial was feasible."""
    return EXITS["timeout"] if "trial_timeout" in statuses else EXITS["best"] if best else EXITS["infeasible"]


class Stop(IntEnum):
    """Why a study ended."""

    COMPLETE = 0
    NO_FEASIBLE = 3
    PATIENCE = 4
    WALL_LIMIT = 5


@dataclass
class Patience:
    """Stops after `limit` trials in id order without a strict improvement; counting begins with the first feasible one."""

    limit: int
    minimize: bool = False
    best: float | None = None
    idle: int = 0

    def observe(self, feasible: bool, objective: float | None) -> bool:
        better = feasible and objective is not None and (self.best is None or (objective < self.best if self.minimize else objective > self.best))
        if better:
            self.best, self.idle = objective, 0
        elif self.best is not None:
            self.idle += 1
        return self.idle >= self.limit


#: Objectives by name: functions of metric(name) -> column that give a column.
OBJECTIVES: dict[str, Callable[[Callable[[str], Column]], Column]] = {}


def objective(name: str):
    """Register a function as an objective; a study names it as `custom:name`."""

    def keep(f):
        if name in OBJECTIVES:
            raise Refusal("objective_repeated", name)
        OBJECTIVES[name] = f
        return f

    return keep


def goal(text: str, metric: Callable[[str], Column | None], policy: Policy) -> tuple[Column, Column]:
    """(value, error) of an expression or a registered objective, whose value has to be finite."""
    if not text.startswith("custom:"):
        return Expression(text).compile(metric, policy)
    name = text.removeprefix("custom:")
    if name not in OBJECTIVES:
        raise Refusal("objective_unknown", name)

    def named(m: str) -> Column:
        found = metric(m)
        return F.lit(None).cast("double") if found is None else found

    value = OBJECTIVES[name](named)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, value), F.when(~finite, "not_finite")


@dataclass
class Study:
    """An objective (an expression, or `custom:` and a registered name) and constraints over metrics of an evaluator."""

    space: Space
    objective: str
    metrics: tuple[str, ...]
    constraints: tuple[str, ...] = ()
    minimize: bool = False
    policy: Policy = field(default_factory=Policy)

    def scored(self, evaluated: DataFrame) -> DataFrame:
        """evaluated with objective, status and feasible."""
        plain = columns(list(self.metrics))

        def metric(name: str) -> Column | None:
            return None if plain(name) is None else F.col("metrics")[name if name in self.metrics else name.removeprefix("report.")]

        aim = goal(self.objective, metric, self.policy)
        limits = [Expression(c).compile(metric, Policy()) for c in self.constraints]
        state = F.when(F.col("error").isNotNull(), "trial_error").otherwise(status(aim, limits))
        return evaluated.withColumns({"objective": aim[0], "status": state}).withColumn("feasible", F.col("status") == "ok")

    def run(self, candidates: DataFrame, bars: dict, evaluator) -> DataFrame:
        """All candidates in one job: grid, random, Sobol and listed candidates need no feedback."""
        return self.scored(evaluate(candidates, bars, evaluator, self.metrics))

    def run_adaptive(self, spark: SparkSession, sampler, bars: dict, evaluator, trials: int, batch: int | None = 8, patience: int | None = None, seconds: float | None = None, out: str | None = None) -> tuple[list[dict], Stop]:
        """Batches of proposals, each one job; results go back to the sampler in trial order.

        batch: as many as the cluster runs at once, if None. out: a folder to which every
        batch's rows are appended; then none is held here, and the list is empty.
        """
        kept: list[dict] = []
        asked_for, any_good = 0, False
        batch = batch or max(8, spark.sparkContext.defaultParallelism)
        waiting = Patience(patience, self.minimize) if patience else None
        began = time.monotonic()
        while asked_for < trials:
            if seconds is not None and time.monotonic() - began >= seconds:
                return kept, Stop.WALL_LIMIT
            asked = [c for c in (sampler.ask() for _ in range(min(batch, trials - asked_for))) if c is not None]
            if not asked:
                break
            rows = [{"trial_id": asked_for + i} | c for i, c in enumerate(asked)]
            frame = spark.createDataFrame(rows).select("trial_id", *self.space.names)
            result = self.run(frame, bars, evaluator)
            found = sorted(result.collect(), key=lambda r: r["trial_id"])  # a batch
            if out is not None:
                spark.createDataFrame(found, result.schema).write.mode("append").parquet(out)
            else:
                kept += [r.asDict() for r in found]
            asked_for += len(found)
            stop = False
            for c, r in zip(asked, found, strict=True):
                any_good = any_good or r["feasible"]
                good = r["feasible"] and r["objective"] is not None and math.isfinite(r["objective"])
                sampler.tell(c, r["objective"]) if good else sampler.abandon(c)
                stop = stop or bool(waiting and waiting.observe(r["feasible"], r["objective"]))
            if stop:
                return kept, Stop.PATIENCE
        return kept, Stop.COMPLETE if any_good else Stop.NO_FEASIBLE

    def document(self, trials: DataFrame, sampler: str, ancestors: DataFrame | None = None) -> dict:
        """The study's result without its trials, which are written as a table.

        coverage: what the ids and vectors of the trials cover; ancestors: the same of the
        rows that the study went on from, and how many of its own vectors they had tried.
        """
        counts = {r["status"]: r["n"] for r in trials.groupBy("status").agg(F.count("*").alias("n")).collect()}
        ok = trials.where("status = 'ok' and objective is not null")
        order = F.col("objective").asc() if self.minimize else F.col("objective").desc()
        top = ok.orderBy(order, "trial_id").limit(1).collect()
        n = self.space.cardinality()
        tried = self.space.encode(trials).agg(F.count_distinct("ordinal")).first()[0] if n else None
        return {
            "contract": "stratamill-study-1", "sampler": sampler, "objective": self.objective, "constraints": list(self.constraints), "space": json.loads(self.space.canonical()), "space_hash": self.space.hash(),
            "cardinality": n, "tried": tried, "statuses": counts, "exhaustive": n is not None and tried == n and set(counts) <= {"ok", "constraint_violation"},
            "best": None if not top else {"trial_id": top[0]["trial_id"], "objective": top[0]["objective"], "parameters": {d: top[0][d] for d in self.space.names}},
            "coverage": self._coverage(trials), "ancestors": None if ancestors is None else self._coverage(ancestors) | {"repeated_vectors": trials.select(*self.space.names).distinct().join(ancestors, self.space.names, "left_semi").count()},
        }

    def _coverage(self, trials: DataFrame) -> dict:
        """Trials, the ids they span and miss, distinct vectors, and those that are scored."""
        scored = F.col("status").isin("ok", "constraint_violation") & F.col("objective").isNotNull()
        a = trials.agg(F.count("*").alias("trials"), F.min("trial_id").alias("first_id"), F.max("trial_id").alias("last_id"), F.count_distinct("trial_id").alias("ids"), F.sum(scored.cast("long")).alias("scored")).first().asDict()
        ids, a["scored"] = a.pop("ids"), a["scored"] or 0
        missing = 0 if a["last_id"] is None else a["last_id"] - a["first_id"] + 1 - ids
        return a | {"missing_ids": missing, "vectors": trials.select(*self.space.names).distinct().count()}


def data_context(paths: list[tuple]) -> str:
    """A name for the input that a study saw: a digest of its files' listing."""
    return hashlib.sha256(json.dumps(sorted(map(list, paths))).encode()).hexdigest()


def retained(trials: DataFrame, mode: str, k: int = 0, minimize: bool = False) -> DataFrame:
    """Rows that a result keeps: all, best-k, none."""
    if mode == "all":
        return trials
    ok = trials.where("status = 'ok' and objective is not null")
    return ok.orderBy(F.col("objective").asc() if minimize else F.col("objective").desc(), "trial_id").limit(k if mode == "best-k" else 0)


def with_space(trials: DataFrame, space: Space, mode: str = "hash") -> DataFrame:
    """trials with what each row says of its space: `full` (its canonical JSON, too), `hash`, `none`."""
    if mode not in ("full", "hash", "none"):
        raise ValueError(mode)
    named = {"space_hash_version": F.lit(1), "space_hash": F.lit(space.hash())} if mode != "none" else {}
    return trials.withColumns(named | ({"space": F.lit(space.canonical())} if mode == "full" else {}))


def write_trials(trials: DataFrame, path: str) -> None:
    """JSON lines; files and lines in them follow the trial ids, without one task that writes all."""
    trials.repartitionByRange("trial_id").sortWithinPartitions("trial_id").write.mode("errorifexists").json(path)


def list_coverage(trials: DataFrame, listed: DataFrame) -> DataFrame:
    """first, last: ranges of listed candidates that have no row."""
    gap = listed.select("trial_id").join(trials.select("trial_id"), "trial_id", "left_anti")
    return islands(gap.withColumn("_k", F.lit(0)), ["_k"], "trial_id").groupBy("_island").agg(F.min("trial_id").alias("first"), F.max("trial_id").alias("last")).drop("_island")
