"""Evaluating candidates on bars, prefixes and pruning.

An evaluator is `f(bars, parameters) -> dict of metrics`, with bars as numpy arrays
by column. Candidates are rows dealt over the cluster; the bars, whose number is
checked against MOST_BARS first, are sent once to every executor. More bars than that
go by blocks through evaluate_long(), for evaluators that carry a state from one block
to the next.

The built-in evaluator `threshold` is our own definition: after a bar that closes at
or above `entry` one unit is held, after one at or below `exit` none, else as before;
a held unit earns the change of the next close. Capital at the start is 1000.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamill.operators.ranks import below
from stratamill.storage import cut_lineage
from stratamill.types import Refusal

#: 48 bytes each.
MOST_BARS = 4_000_000
#: Trial ids that are counted together when the newest are looked for.
BLOCK = 1 << 16
#: Fractions that lie no further apart ask for one prefix: rounding alone may part them.
CLOSE = 1e-9
THRESHOLD_METRICS = ("net_profit", "num_trades", "max_equity_drawdown", "time_in_market_pct")


class Stepwise:
    """An evaluator that can be given its bars in parts. States are dicts of numbers."""

    def start(self, p: dict) -> dict:
        raise NotImplementedError

    def step(self, state: dict, bars: dict, p: dict) -> dict:
        raise NotImplementedError

    def finish(self, state: dict) -> dict:
        raise NotImplementedError

    def __call__(self, bars: dict, p: dict) -> dict:
        return self.finish(self.step(self.start(p), bars, p))


class Threshold(Stepwise):
    def start(self, p):
        if p["exit"] >= p["entry"]:
            raise ValueError("exit must lie below entry")
        return {"held": 0.0, "last": math.nan, "gain": 0.0, "top": 1000.0, "down": 0.0, "trades": 0.0, "bars": 0.0, "inside": 0.0}

    def step(self, state, bars, p):
        import numpy as np

        close = bars["close"]
        if not len(close):
            return state
        signal = np.where(close >= p["entry"], 1, np.where(close <= p["exit"], 0, -1))
        at = np.maximum.accumulate(np.where(signal >= 0, np.arange(len(close)), -1))
        held = np.where(at >= 0, signal[np.maximum(at, 0)], state["held"])
        before = np.append(state["held"], held[:-1])
        change = np.diff(close, prepend=close[0] if math.isnan(state["last"]) else state["last"])
        equity = 1000 + (state["gain"] + np.cumsum(before * change))
        top = np.maximum(np.maximum.accumulate(equity), state["top"])
        return {
            "held": float(held[-1]), "last": float(close[-1]), "gain": float(equity[-1] - 1000), "top": float(top[-1]), "down": max(state["down"], float((top - equity).max())),
            "trades": state["trades"] + float(np.count_nonzero(held - before == 1)), "bars": state["bars"] + len(close), "inside": state["inside"] + float(held.sum()),
        }

    def finish(self, state):
        return {"net_profit": state["gain"], "num_trades": state["trades"], "max_equity_drawdown": state["down"], "time_in_market_pct": 100 * state["inside"] / state["bars"] if state["bars"] else 0.0}


threshold = Threshold()


def bars_of(bars: DataFrame, columns: tuple[str, ...] = ("timestamp", "open", "high", "low", "close", "volume")) -> dict:
    """Bars in time order as arrays; only the columns that are asked for."""
    if (n := bars.count()) > MOST_BARS:
        raise Refusal("bars", f"{n} bars, {MOST_BARS} admitted in one evaluation")
    found = bars.select("timestamp", *(c for c in columns if c != "timestamp")).toArrow().sort_by("timestamp")
    return {c: found.column(c).to_numpy() for c in found.column_names}


def evaluate(candidates: DataFrame, bars: dict, evaluator: Callable[[dict, dict], dict], metrics: tuple[str, ...], fraction: float = 1.0) -> DataFrame:
    """candidates with metrics MAP and error: an evaluator's exception is that trial's error and nobody else's."""
    shared = candidates.sparkSession.sparkContext.broadcast(bars)
    names = [c for c in candidates.columns if c != "trial_id"]

    def run(batches):
        n = len(next(iter(shared.value.values())))
        part = {k: v[: max(1, math.ceil(fraction * n))] for k, v in shared.value.items()}
        for batch in batches:
            rows, errors = [], []
            for p in batch[names].to_dict("records"):
                try:
                    found = evaluator(part, p)
                    rows.append({m: float(found[m]) if math.isfinite(found[m]) else None for m in metrics})
                    errors.append(None)
                except Exception as e:
                    rows.append({})
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield batch.assign(metrics=rows, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return candidates.mapInPandas(run, f"{fields}, metrics map<string,double>, error string")


def settings(timezone: str | None = None, overrides: dict | None = None, inputs: dict | None = None, syminfo: dict | None = None, feeds: dict | None = None) -> list[tuple[str, str, object]]:
    """(kind, name, value) in the order in which a trial is set up; a trial gets a list of its own, so no state passes from one to the next."""
    out = [("timezone", "timezone", timezone)] if timezone is not None else []
    for kind, held in (("override", overrides), ("input", inputs), ("syminfo", syminfo), ("feed", feeds)):
        out += [(kind, k, v) for k, v in (held or {}).items()]
    return out


def evaluate_long(candidates: DataFrame, bars: DataFrame, evaluator: Stepwise, metrics: tuple[str, ...], columns: tuple[str, ...] = ("close",), block: int = MOST_BARS) -> DataFrame:
    """evaluate() over any number of bars (timestamp, which is unique, and columns): a block of them at a time, with every candidate's state written between."""
    names = [c for c in candidates.columns if c != "trial_id"]
    placed = bars.select("timestamp", *columns).join(below(bars, "timestamp").select("timestamp", "before"), "timestamp")
    placed = cut_lineage(placed.withColumn("_block", F.floor(F.col("before") / block)))
    blocks = placed.agg(F.coalesce(F.max("_block") + 1, F.lit(0))).first()[0]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    rows = candidates.withColumns({"_state": F.lit(None).cast("map<string,double>"), "error": F.lit(None).cast("string")})

    def told(e: Exception) -> str:
        return f"{type(e).__name__}: {e}"[:500]

    def one(shared):
        def run(batches):
            for batch in batches:
                states, errors = [], []
                for p, state, error in zip(batch[names].to_dict("records"), batch["_state"], batch["error"], strict=True):
                    try:
                        state = evaluator.start(p) if state is None and error is None else dict(state or {})
                        states.append(evaluator.step(state, shared.value, p) if error is None else None)
                        errors.append(error)
                    except Exception as e:
                        states.append(None)
                        errors.append(told(e))
                yield batch.assign(_state=states, error=errors)

        return run

    for b in range(max(1, blocks)):
        part = placed.where(F.col("_block") == b).drop("_block", "before").toArrow().sort_by("timestamp")  # a block at most
        shared = candidates.sparkSession.sparkContext.broadcast({c: part.column(c).to_numpy() for c in part.column_names})
        rows = cut_lineage(rows.mapInPandas(one(shared), f"{fields}, _state map<string,double>, error string"))
        shared.unpersist()

    def last(batches):
        for batch in batches:
            found = [{} if s is None else {m: float(v) if math.isfinite(v) else None for m, v in evaluator.finish(dict(s)).items() if m in metrics} for s in batch["_state"]]
            yield batch.drop(columns=["_state", "error"]).assign(metrics=found, error=batch["error"])

    return rows.mapInPandas(last, f"{fields}, metrics map<string,double>, error string")


# ---- Pruning -----------------------------------------------------------------


def rungs(fractions: list[float], bars: int) -> list[int]:
    """Bars of each prefix: rising, distinct, the whole last. Of fractions within CLOSE of the one before the lower counts."""
    out: list[int] = []
    last = -math.inf
    for f in sorted(fractions):
        k = max(1, math.ceil(f * bars))
        if k < bars and f - last > CLOSE and (not out or k > out[-1]):
            out.append(k)
            last = f
    return [*out, bars]


def cut(history: DataFrame, eta: int, median: bool = False, minimize: bool = False, recent: int = 1024) -> DataFrame:
    """rung, cut: the score that a trial has to reach, from the last `recent` scores (rung, trial_id, score) of each rung; none below eta scores."""
    # the last blocks of ids that hold `recent` scores: what is then sorted by rung is bounded
    h = history.where("score is not null").withColumn("_b", F.floor(F.col("trial_id") / BLOCK))
    counts = h.groupBy("rung", "_b").agg(F.count("*").alias("_k"))
    later = F.coalesce(F.sum("_k").over(Window.partitionBy("rung").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("_later", later).where(F.col("_later") < recent).select("rung", "_b")
    newest = Window.partitionBy("rung").orderBy(F.col("trial_id").desc())
    h = h.join(last, ["rung", "_b"]).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= recent)
    best_first = F.col("score").asc() if minimize else F.col("score").desc()
    placed = h.withColumn("place", F.row_number().over(Window.partitionBy("rung").orderBy(best_first, "trial_id"))).withColumn("n", F.count("*").over(Window.partitionBy("rung")))
    placed = placed.where(F.col("n") >= eta)
    if median or eta == 2:
        low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
        return placed.where((F.col("place") == low) | (F.col("place") == high)).groupBy("rung").agg((F.min("score") / 2 + F.max("score") / 2).alias("cut"))
    return placed.where(F.col("place") == F.ceil(F.col("n") / eta)).select("rung", F.col("score").alias("cut"))


def survivors(scores: DataFrame, cuts: DataFrame, minimize: bool = False) -> DataFrame:
    """scores that aren't strictly worse than their rung's cut; ties stay, and so does everything where there's no cut."""
    worse = F.col("score") > F.col("cut") if minimize else F.col("score") < F.col("cut")
    return scores.join(cuts, "rung", "left").where(F.col("cut").isNull() | ~worse)


def halving(candidates: DataFrame, bars: dict, evaluator, metrics: tuple[str, ...], objective: Callable[[DataFrame], Column], fractions: list[float], eta: int, minimize: bool = False) -> DataFrame:
    """Successive halving: every rung evaluates what the one before let through. Returns all trials with rung, bars_processed, objective, pruned."""
    n = len(next(iter(bars.values())))
    steps, left, out = rungs(fractions, n), candidates, None
    for i, k in enumerate(steps):
        scored = evaluate(left, bars, evaluator, metrics, k / n)
        scored = scored.withColumns({"score": objective(scored), "rung": F.lit(i), "bars_processed": F.lit(k)})
        scored = cut_lineage(scored)
        last = i == len(steps) - 1
        kept = scored if last else survivors(scored, cut(scored.select("rung", "trial_id", "score"), eta, minimize=minimize), minimize)
        gone = scored.join(kept.select("trial_id"), "trial_id", "left_anti")
        part = (scored if last else gone).select(*candidates.columns, "metrics", "error", F.col("score").alias("objective"), "rung", "bars_processed", F.lit(not last).alias("pruned"))
        out = part if out is None else out.unionByName(part)
        left = kept.select(*candidates.columns)
    return out


def routed(trials: DataFrame, bindings: DataFrame, choice: str) -> DataFrame:
    """trials with dataset_id: a categorical choice names the data that a trial runs on. A choice without data gives null."""
    return trials.join(bindings.select(F.col("choice").alias(choice), "dataset_id"), choice, "left")
