"""A rolling schedule: each finished trial lets the next one be proposed."""

from __future__ import annotations

import time
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import SparkSession

from stratamill.plans.study import Study


def run(spark: SparkSession, study: Study, sampler, bars: dict, evaluator, trials: int, workers: int = 2, seconds: float | None = None) -> tuple[list[dict], list[tuple[int, int, int]]]:
    """(rows in trial order, log of (completion_order, trial_id, completed_before)).

    `workers` small jobs run side by side. A trial that takes longer than `seconds`,
    counted from its own start, is cancelled with its job group and recorded as
    trial_timeout; the others go on.
    """
    sc = spark.sparkContext

    def one(trial_id: int, c: dict) -> dict:
        sc.setJobGroup(f"trial-{trial_id}", "rolling trial", interruptOnCancel=True)
        frame = spark.createDataFrame([{"trial_id": trial_id} | c]).select("trial_id", *study.space.names)
        return study.run(frame, bars, evaluator).first().asDict()

    rows, log, running, issued, until = {}, [], {}, 0, {}
    with ThreadPoolExecutor(workers) as pool:
        while issued < trials or running:
            while issued < trials and len(running) < workers:
                c = sampler.ask()
                if c is None:
                    trials = issued
                    break
                f = pool.submit(one, issued, c)
                running[f], until[f] = (issued, c, len(log)), None if seconds is None else time.monotonic() + seconds
                issued += 1
            left = None if seconds is None else max(0.0, min(until[f] for f in running) - time.monotonic())
            done, _ = wait(running, timeout=left, return_when=FIRST_COMPLETED)
            late = () if seconds is None else [f for f in running if f not in done and until[f] <= time.monotonic()]
            for f in (*done, *late):
                i, c, before = running.pop(f)
                if f in done:
                    row = f.result()
                else:
                    sc.cancelJobGroup(f"trial-{i}")
                    row = {"trial_id": i, "status": "trial_timeout", "feasible": False, "objective": None} | c
                log.append((len(log), i, before))
                rows[i] = row
                sampler.tell(c, row["objective"]) if row["feasible"] else sampler.abandon(c)
    return [rows[i] for i in sorted(rows)], log
