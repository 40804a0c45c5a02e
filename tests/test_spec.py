import json

import pytest
from pyspark.sql import functions as F

from stratamill.operators import pareto, pbo
from stratamill.plans import continuation, rolling
from stratamill.plans.cli import main
from stratamill.plans.samplers import random_serial
from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space
from stratamill.plans.spec import injective, parse
from stratamill.plans.study import Study
from stratamill.plans.tpe import Tpe
from stratamill.types import Refusal
from tests.test_search import BARS, EVAL

# A space and a goal whose published identity is IDENTITY.
PUBLISHED_SPACE = {"Entry Level": {"kind": "real", "low": 101, "high": 103, "step": 1}, "Exit Level": {"kind": "real", "low": 98, "high": 100, "step": 1}}
PUBLISHED_GOAL = {"expression": "metrics.all.net_profit - 0.5 * metrics.equity.max_equity_drawdown", "direction": "maximize", "constraints": ["metrics.all.num_trades >= 1"]}
IDENTITY = "1188c07588652f2b365a1fc233815d5c51d350e92106051309d9e84ad586071a"

DOC = {
    "schema_version": 1,
    "mode": "single_strategy",
    "strategies": [{"id": "levels", "source": "levels.txt", "datasets": ["hourly"], "search_space": PUBLISHED_SPACE}],
    "datasets": [{"id": "hourly", "ohlcv": "bars.csv", "input_tf": "60", "script_tf": "240"}],
    "objective": {"kind": "expression", **PUBLISHED_GOAL},
    "sampler": {"kind": "grid", "trials": 30},
    "execution": {"batch_size": 4},
}


def test_spec_and_its_identity():
    spec = parse(json.dumps(DOC))
    assert spec.space.cardinality() == 9
    assert spec.space_hash() == IDENTITY
    other = json.loads(json.dumps(DOC)) | {"sampler": {"kind": "random", "trials": 2}}
    other["objective"]["constraints"] = []
    assert parse(json.dumps(DOC | {"sampler": other["sampler"]})).space_hash() == IDENTITY != parse(json.dumps(other)).space_hash()


def test_all_faults_are_told():
    bad = json.loads(json.dumps(DOC))
    bad["schema_version"] = 2
    bad["extra"] = 1
    bad["objective"]["expression"] = "1 +"
    bad["sampler"]["kind"] = "guess"
    bad["strategies"][0]["search_space"]["n"] = {"kind": "integer", "low": 3, "high": 1}
    with pytest.raises(Refusal) as e:
        parse(json.dumps(bad))
    text = str(e.value)
    assert all(x in text for x in ("schema_version", "unknown ['extra']", "objective: expected", "'guess'", "search_space.n"))


def test_parts_are_dealt_before_python_reads_them(spark):
    """The parts' file is one task's; what Python makes of each row isn't."""
    from stratamill import queries_detail

    for name in ("src17_study_spec", "src8_strict_json", "spc1_dimension_refusals", "spc8_serialised", "smp5_digital_shift", "smp22_continuation_seed"):
        assert getattr(queries_detail, name)(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 3


def test_grids_that_collapse():
    assert injective(Real("a", 0.0, 1.0, 0.1)) and not injective(Real("a", 1e16, 1e16 + 64, 0.5)) and injective(Real("a", 0.0, 1e7, 0.5))


def test_continuation(spark):
    space = Space((Integer("n", 1, 5), Boolean("b")))
    tried = space.grid(spark).where("trial_id in (0, 1, 4)").withColumns({"status": F.lit("ok"), "feasible": F.lit(True), "objective": F.lit(1.0)})
    continuation.admit_history(tried, space)
    assert continuation.next_id(tried) == 5 and continuation.lowest_untried(spark, space, tried, 2) == [2, 3]
    assert [tuple(r) for r in continuation.continued_grid(spark, space, tried, 2).orderBy("trial_id").collect()] == [(5, 2, False), (6, 2, True)]
    new = continuation.continued_random(spark, space, tried, 3, 40)
    assert new.join(tried.select("n", "b"), ["n", "b"]).count() == 0 and new.where("trial_id < 5").count() == 0
    # what is rejected is replaced: all seven that are left, then as many as were asked of a larger space
    assert new.count() == 7 and sorted(r["trial_id"] for r in new.collect()) == list(range(5, 12))
    wide = Space((Integer("n", 1, 100),))
    old = wide.grid(spark, 10)
    more = [r["n"] for r in continuation.continued_random(spark, wide, old, 3, 50).collect()]
    assert len(more) == len(set(more)) == 50 and min(more) > 10
    assert len([*continuation.continued_random(spark, wide, old, 3, 500).collect()]) == 90
    with pytest.raises(Refusal):
        continuation.admit_history(tried.union(tried), space)
    with pytest.raises(Refusal):
        continuation.admit_history(tried.withColumn("n", F.lit(9)), space)
    distinct = continuation.Distinct(continuation.Random(space, 1), space)
    seen = [distinct.ask() for _ in range(11)]
    assert seen[10] is None and len({(c["n"], c["b"]) for c in seen[:10]}) == 10
    tpe = continuation.warmed(Tpe(space, 1), tried)
    again = continuation.load_state(space, continuation.save_state(tpe))
    assert [again.ask() for _ in range(3)] == [tpe.ask() for _ in range(3)]
    broken = json.loads(continuation.save_state(tpe)) | {"sha256": "0"}
    with pytest.raises(Refusal):
        continuation.load_state(space, json.dumps(broken))


def test_bounded_history():
    space = Space((Real("x", 0.0, 1.0),))
    tpe = continuation.BoundedTpe(space, 2, minimize=True)
    for i in range(700):
        tpe.tell({"x": i / 700}, abs(i / 700 - 0.3))
    assert len(tpe.seen) == 537 and min(s for _, s in tpe.seen) == pytest.approx(0, abs=1e-9) and 0 <= tpe.ask()["x"] <= 1


def test_bounded_estimation_learns():
    """A mixed space of which one corner is best; the models are made anew each 32 observations."""
    space = Space((Real("x", 0.0, 1.0), Integer("n", 1, 40), Categorical("c", ("p", "q", "r")), Boolean("b")))

    def loss(c):
        return (c["x"] - 0.7) ** 2 + ((c["n"] - 9) / 40) ** 2 + (0 if c["c"] == "q" else 0.3) + (0 if c["b"] else 0.2)

    wins = 0
    for seed in range(4):
        t, times = continuation.BoundedTpe(space, seed, minimize=True), []
        t._fit = lambda fit=t._fit, times=times: (times.append(1), fit())
        for _ in range(300):
            c = t.ask()
            assert space.names == list(c) and 1 <= c["n"] <= 40
            t.tell(c, loss(c))
        assert 5 <= len(times) <= 300 // 32 + 1
        wins += min(s for _, _, s in t.kept) <= min(loss(c) for c in random_serial(space, seed + 50, 300))
    assert wins >= 3


def test_rolling_schedule(spark):
    study = Study(EVAL, "net_profit", ("net_profit", "num_trades"))
    from stratamill.operators.evaluate import threshold

    found, log = rolling.run(spark, study, continuation.Random(EVAL, 4), BARS, threshold, 5)
    assert [r["trial_id"] for r in found] == list(range(5)) and sorted(i for _, i, _ in log) == list(range(5)) and all(before <= at for at, _, before in log)


def test_failure_codes_are_closed():
    from stratamill.failures import CODES, Failure

    made = Failure("hpo_walkforward_timeframe_unsupported", capability="x")
    assert len(CODES) == 2 and not made.retryable and str(made) == "hpo_walkforward_timeframe_unsupported: capability=x"
    for code, args in (("hpo_walkforward_timeframe_unsupported", {}), ("hpo_walkforward_timeframe_unsupported", {"x": 1}), ("hpo_other", {})):
        with pytest.raises(ValueError):
            Failure(code, **args)


def test_command_line(spark, tmp_path, capsys):
    spec = json.loads(json.dumps(DOC))
    (tmp_path / "bars.csv").write_text("timestamp,open,high,low,close,volume\n" + "".join(f"{i},1,1,1,{c},1\n" for i, c in enumerate([100, 103, 102, 98, 101, 104])))
    (tmp_path / "s.json").write_text(json.dumps(spec))
    assert main(["check", str(tmp_path / "s.json")]) == 0 and '"cardinality": 9' in capsys.readouterr().out
    assert main(["run", str(tmp_path / "s.json"), "--out", str(tmp_path / "out")]) == 0
    document = json.loads((tmp_path / "out" / "study.json").read_text())
    assert document["tried"] == 9 and document["best"]["parameters"].keys() == {"Entry Level", "Exit Level"}
    spec["sampler"] = {"kind": "tpe", "seed": 1, "trials": 12}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    assert main(["run", str(tmp_path / "s.json"), "--out", str(tmp_path / "out2")]) == 0
    spec["mode"] = "?"
    (tmp_path / "s.json").write_text(json.dumps(spec))
    assert main(["check", str(tmp_path / "s.json")]) == 2


def test_rosters_and_digests(spark):
    rows = spark.createDataFrame([(1, "ok", 4), (2, "pruned", 4), (3, "ok", 3), (4, "engine_error", 4)], "key int, status string, n_blocks int")
    roster = spark.createDataFrame([(1,), (2,), (3,), (4,)], "key int")
    defects = pbo.roster_defects(rows, roster, 4)
    assert pbo.first_defect(defects) == "pbo_status_error" and defects.count() == 3
    assert pbo.first_defect(pbo.roster_defects(rows, roster.where("key < 4"), 4)) == "pbo_roster_mismatch"
    a = pareto.input_digest(rows, ["key", "status"]).first()
    assert a == pareto.input_digest(rows.repartition(3), ["key", "status"]).first() and a["rows"] == 4
    assert a["digest"] != pareto.input_digest(rows.where("key > 1"), ["key", "status"]).first()["digest"]


def test_order_and_partitions_dont_matter(spark):
    import random

    from stratamill.operators import curves

    rng = random.Random(3)
    rows = [(k, i, i * 86_400_000 * 20, 100.0 + rng.random()) for k in range(4) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, idx int, time_ms bigint, equity double")

    def rounded(d):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())

    for f in (curves.return_stats, lambda d: curves.return_stats(d, monthly=True), lambda d: curves.block_moments(d, 4)):
        assert rounded(f(df.repartition(1))) == rounded(f(df.repartition(7)))
