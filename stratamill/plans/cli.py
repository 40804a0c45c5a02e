"""Command line: check a specification, run it on a CSV, tell what's left of a space."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from stratamill.types import Refusal


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stratamill")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("check", "run", "space-info"):
        s = sub.add_parser(name)
        s.add_argument("spec")
        if name == "run":
            s.add_argument("--out", required=True)
            s.add_argument("--candidates")
        if name == "space-info":
            s.add_argument("--trials")
    args = p.parse_args(argv)
    from stratamill.plans.spec import parse

    try:
        spec = parse(Path(args.spec).read_text())
        if args.what == "check":
            print(json.dumps({"space_hash": spec.space_hash(), "cardinality": spec.space.cardinality()}))
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("stratamill").getOrCreate()
        if args.what == "space-info":
            tried = spark.read.parquet(args.trials) if args.trials else spec.space.grid(spark, 0)
            print(json.dumps(spec.space.info(tried).first().asDict()))
            return 0
        return _run(spark, spec, args)
    except Refusal as e:
        print(e, file=sys.stderr)
        return 2


def _run(spark, spec, args) -> int:
    from stratamill.operators.evaluate import THRESHOLD_METRICS, bars_of, threshold
    from stratamill.plans.samplers import random_indexed, sobol
    from stratamill.plans.study import Study, write_trials
    from stratamill.plans.tpe import Tpe
    from stratamill.sources.bars import read_csv
    from stratamill.sources.trials import read_candidates

    minimize = spec.objective["direction"] == "minimize"
    metrics = tuple(f"metrics.equity.{m}" if m.startswith(("max_", "time_")) else f"metrics.all.{m}" for m in THRESHOLD_METRICS)
    study = Study(spec.space, spec.objective["expression"], metrics, tuple(spec.objective.get("constraints", [])), minimize)
    names = spec.space.names

    def evaluator(bars, p):
        found = threshold(bars, {"entry": p[names[0]], "exit": p[names[1]]})
        return {full: found[full.rsplit(".", 1)[1]] for full in metrics}

    here = Path(args.spec).parent
    bars = bars_of(read_csv(spark, str(here / spec.dataset["ohlcv"])), ("timestamp", "close"))
    kind, n, seed = spec.sampler["kind"], spec.sampler.get("trials", 100), spec.sampler.get("seed", 0)
    if kind == "tpe":
        rows, _ = study.run_adaptive(spark, Tpe(spec.space, seed, minimize), bars, evaluator, n, spec.execution.get("batch_size", 8), spec.execution.get("patience"), spec.execution.get("wall_seconds"))
        trials = spark.createDataFrame([{k: r[k] for k in ("trial_id", *names, "status", "feasible", "objective")} for r in rows], "trial_id long, " + ", ".join(f"`{c}` {type_of(rows[0][c])}" for c in names) + ", status string, feasible boolean, objective double")
    else:
        asked = {"grid": lambda: spec.space.grid(spark, n), "random": lambda: random_indexed(spark, spec.space, seed, n), "sobol": lambda: sobol(spark, spec.space, n, seed if spec.sampler.get("scramble") else None), "candidates": lambda: read_candidates(spark, args.candidates, spec.space)}
        trials = study.run(asked[kind](), bars, evaluator).select("trial_id", *names, "status", "feasible", "objective")
    write_trials(trials, f"{args.out}/trials")
    done = spark.read.json(f"{args.out}/trials")
    document = study.document(done, kind) | {"space_hash": spec.space_hash()}
    Path(f"{args.out}/study.json").write_text(json.dumps(document, indent=1))
    return 0 if document["best"] else 3


def type_of(v) -> str:
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(v), "string")


if __name__ == "__main__":
    sys.exit(main())
