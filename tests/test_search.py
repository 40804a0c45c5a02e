import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamill.operators import evaluate, rows
from stratamill.plans import samplers
from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space, serialised
from stratamill.plans.study import Patience, Stop, Study, data_context, retained, write_trials
from stratamill.plans.tpe import Parzen, Tpe, split, weighted, weights
from stratamill.sources import bars, trials
from stratamill.streaming import emission
from stratamill.types import Refusal

SPACE = Space((Integer("n", -4, 4, 2), Real("x", 0.0, 0.3, 0.1), Boolean("b"), Categorical("c", ("p", "q", "r"))))


def test_grid_round_trip(spark):
    assert SPACE.cardinality() == 5 * 4 * 2 * 3
    got = SPACE.encode(SPACE.grid(spark)).orderBy("trial_id").collect()
    assert [r["ordinal"] for r in got] == list(range(120))
    assert tuple(got[0])[1:5] == (-4, 0.0, False, "p") and tuple(got[119])[1:5] == (4, 0.3, True, "r")
    assert Space(()).cardinality() == 1 and Space((Real("y", 0.0, 1.0),)).cardinality() is None


def test_dimension_refusals():
    for bad in (lambda: Integer("a", 2, 1), lambda: Real("a", 0.0, 1.0, log=True), lambda: Categorical("a", ()), lambda: Space((Boolean("a"), Boolean("a"))), lambda: Real("a", 0.0, 1.0, -1.0)):
        with pytest.raises(Refusal):
            bad()


def test_identity():
    assert SPACE.vector_key({"n": 2, "x": -0.0, "b": True, "c": "p"}) == SPACE.vector_key({"n": 2, "x": 0.0, "b": True, "c": "p"})
    assert serialised(0.1) == "0.10000000000000001" and serialised(True) == "true" and serialised(3) == "3"
    assert len(SPACE.hash()) == 64


def test_continuation_and_issues(spark):
    tried = SPACE.grid(spark).where("trial_id % 2 = 0")
    assert [r["ordinal"] for r in SPACE.continued(spark, tried, 3).orderBy("ordinal").collect()] == [1, 3, 5]
    assert SPACE.info(tried).first().asDict() == {"cardinality": 120, "tried": 60, "remaining": 60, "next_id": 119}
    bad = spark.createDataFrame([(3, 0.1, True, "p"), (2, 0.15, True, "p"), (2, 0.1, None, "p"), (2, 0.1, True, "p")], "n int, x double, b boolean, c string")
    assert sorted(r["issue"] for r in SPACE.issues(bad).collect()) == ["b: missing", "n: off grid", "x: off grid"]


def test_sobol_first_points(spark):
    space = Space(tuple(Real(f"x{i}", 0.0, 1.0) for i in range(3)))
    got = [tuple(r)[1:] for r in samplers.sobol(spark, space, 8).orderBy("trial_id").collect()]
    # the points that are published with the direction numbers
    assert got == [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (0.75, 0.25, 0.25), (0.25, 0.75, 0.75), (0.375, 0.375, 0.625), (0.875, 0.875, 0.125), (0.625, 0.125, 0.875), (0.125, 0.625, 0.375)]
    assert [x >> 49 for x in samplers.direction_words(1)[:15]] == [m << 15 - k for k, m in enumerate([1, 3, 5, 15, 17, 51, 85, 255, 257, 771, 1285, 3855, 4369, 13107, 21845], 1)]
    assert samplers.split_mix(0) == 0xE220A8397B1DCDAF and samplers.split_mix(0x9E3779B97F4A7C15) == 0x6E789E6AA1B965F4
    assert sorted(x for x, *_ in got) == [i / 8 for i in range(8)]
    later = samplers.sobol(spark, space, 4, seed=9, first=4)
    assert sorted(map(tuple, later.collect())) == sorted(tuple(r) for r in samplers.sobol(spark, space, 8, seed=9).where("trial_id >= 4").collect())
    assert samplers.admit_sobol(spark, space, later, seed=9).count() == 0


def test_high_word_is_exact(spark):
    words = [0, 1, (1 << 64) - 1, 1 << 63, 0x123456789ABCDEF0]
    df = spark.createDataFrame([(i, samplers.signed(w)) for i, w in enumerate(words)], "i int, w bigint")
    for count in (1, 3, 1000, (1 << 31) - 1):
        got = [r[0] for r in df.orderBy("i").select(samplers.high_index(F.col("w"), count)).collect()]
        assert got == [w * count >> 64 for w in words]


def test_twister_reference_values():
    rng = samplers.Twister(5489)
    assert [rng.word() for _ in range(3)] == [14514284786278117030, 4620546740167642908, 13109570281517897720]


def test_random_in_parallel_doesnt_depend_on_partitions(spark):
    a = samplers.random_indexed(spark, SPACE, 3, 50)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, a.repartition(7).collect()))
    assert all(d.low <= r["n"] <= d.high for d in SPACE.dimensions[:1] for r in a.collect())
    assert samplers.random_serial(SPACE, 3, 5) == samplers.random_serial(SPACE, 3, 5)


def test_tpe_pieces():
    assert list(weights(24)) == [1.0] * 24 and weights(26)[0] == pytest.approx(1 / 26)
    assert split([(1.0, 0), (3.0, 1), (3.0, 2), (0.0, 3)]) == ([1], [0, 2, 3])
    p = Parzen(np.array([0.2, 0.8]), np.ones(2))
    x = np.linspace(0, 1, 2001)
    assert np.trapezoid([math.exp(p.log_density(v)) for v in x], x) == pytest.approx(1, abs=1e-3)
    assert math.exp(p.log_mass(0.0, 1.0)) == pytest.approx(1)


def test_tpe_beats_random():
    space = Space((Real("x", -5.0, 10.0), Real("y", 0.0, 15.0)))

    def branin(p):
        x, y = p["x"], p["y"]
        return (y - 5.1 / (4 * math.pi**2) * x * x + 5 / math.pi * x - 6) ** 2 + 10 * (1 - 1 / (8 * math.pi)) * math.cos(x) + 10

    wins = 0
    for seed in range(5):
        tpe = Tpe(space, seed, minimize=True)
        for _ in range(80):
            c = tpe.ask()
            tpe.tell(c, branin(c))
        wins += min(s for _, s in tpe.seen) <= min(map(branin, samplers.random_serial(space, seed + 100, 80)))
    assert wins >= 3


BARS = {"timestamp": np.arange(8), "close": np.array([10.0, 13, 12, 15, 7, 6, 12, 14])}
EVAL = Space((Integer("entry", 11, 15, 2), Integer("exit", 6, 8)))


def test_threshold_by_hand():
    m = evaluate.threshold(BARS, {"entry": 13, "exit": 7})
    assert m["net_profit"] == -6.0 and m["num_trades"] == 2.0 and m["max_equity_drawdown"] == 8.0


def test_study(spark):
    study = Study(EVAL, "net_profit / num_trades", evaluate.THRESHOLD_METRICS, ("num_trades >= 1",))
    out = study.run(EVAL.grid(spark), BARS, evaluate.threshold)
    doc = study.document(out, "grid")
    assert doc["tried"] == 9 and doc["statuses"] == {"ok": 9} and doc["exhaustive"]
    best = rows.best(out, 1).first()
    assert doc["best"]["trial_id"] == best["trial_id"]
    assert retained(out, "best-k", 2).count() == 2 and retained(out, "none").count() == 0
    failing = study.run(spark.createDataFrame([(0, 5, 9)], "trial_id long, entry long, exit long"), BARS, evaluate.threshold).first()
    assert failing["status"] == "trial_error" and not failing["feasible"]


def test_registered_objective(spark):
    from stratamill.plans.study import OBJECTIVES, objective

    @objective("per_root_trade")
    def per_root_trade(metric):
        return F.try_divide(metric("net_profit"), F.sqrt(metric("num_trades") - 1))

    try:
        rows_ = {r["trial_id"]: r for r in Study(EVAL, "custom:per_root_trade", evaluate.THRESHOLD_METRICS).run(EVAL.grid(spark), BARS, evaluate.threshold).collect()}
        for r in rows_.values():
            n, m = r["metrics"]["num_trades"], r["metrics"]["net_profit"]
            assert (r["status"], r["objective"]) == (("ok", pytest.approx(m / math.sqrt(n - 1))) if n > 1 else ("objective_error", None))
        with pytest.raises(Refusal):
            objective("per_root_trade")(per_root_trade)
        with pytest.raises(Refusal):
            Study(EVAL, "custom:other", ("net_profit",)).run(EVAL.grid(spark), BARS, evaluate.threshold)
    finally:
        OBJECTIVES.pop("per_root_trade")


def test_adaptive_study(spark):
    study = Study(EVAL, "net_profit", evaluate.THRESHOLD_METRICS)
    done, why = study.run_adaptive(spark, Tpe(EVAL, 1), BARS, evaluate.threshold, 16, batch=8)
    assert len(done) == 16 and why == Stop.COMPLETE and [r["trial_id"] for r in done] == list(range(16))
    p = Patience(2)
    assert [p.observe(*x) for x in ((False, None), (True, 1.0), (True, 1.0), (True, 0.5))] == [False, False, False, True]


def test_adaptive_study_of_continuous_dimensions(spark):
    space = Space((Real("entry", 9.0, 15.0), Real("exit", 4.0, 8.9)))
    done, why = Study(space, "net_profit", ("net_profit",)).run_adaptive(spark, Tpe(space, 2), BARS, evaluate.threshold, 24, batch=12)
    assert len(done) == 24 and why == Stop.COMPLETE and all(type(r["entry"]) is float and 9 <= r["entry"] <= 15 for r in done)


def test_adaptive_rows_go_to_a_table(spark, tmp_path):
    study = Study(EVAL, "net_profit", ("net_profit", "num_trades"))
    out = str(tmp_path / "trials")
    held, why = study.run_adaptive(spark, Tpe(EVAL, 3), BARS, evaluate.threshold, 20, batch=None, out=out)
    kept, same = study.run_adaptive(spark, Tpe(EVAL, 3), BARS, evaluate.threshold, 20, batch=max(8, spark.sparkContext.defaultParallelism))
    rows = spark.read.parquet(out).orderBy("trial_id").collect()
    assert held == [] and why == same and [(r["trial_id"], r["entry"], r["objective"]) for r in rows] == [(r["trial_id"], r["entry"], r["objective"]) for r in kept]


@pytest.mark.parametrize("block", [1, 3, 50])
def test_bars_by_blocks(spark, block):
    rng = np.random.default_rng(block)
    bars_ = spark.createDataFrame([(i * 60, float(c)) for i, c in enumerate(10 + np.cumsum(rng.integers(-2, 3, 40)))], "timestamp bigint, close double").repartition(3)
    asked = Space((Integer("entry", 8, 16, 2), Integer("exit", 4, 9))).grid(spark)
    whole = {r["trial_id"]: r for r in evaluate.evaluate(asked, evaluate.bars_of(bars_, ("timestamp", "close")), evaluate.threshold, evaluate.THRESHOLD_METRICS).collect()}
    parts = evaluate.evaluate_long(asked, bars_, evaluate.threshold, evaluate.THRESHOLD_METRICS, block=block if block > 1 else 20).collect()
    assert len(parts) == len(whole) == 30 and any(r["error"] for r in parts)
    for r in parts:
        assert r["error"] == whole[r["trial_id"]]["error"] and r["metrics"] == pytest.approx(whole[r["trial_id"]]["metrics"])


def test_pruning(spark):
    assert evaluate.rungs([0.1, 0.25, 0.25, 1.0], 20) == [2, 5, 20]
    h = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate([1, 5, 3, 4, 2, 6])], "rung int, trial_id int, score double")
    assert evaluate.cut(h, 3).first()["cut"] == 5.0 and evaluate.cut(h, 3, median=True).first()["cut"] == 3.5 and evaluate.cut(h, 7).count() == 0
    assert sorted(r["trial_id"] for r in evaluate.survivors(h, evaluate.cut(h, 3)).collect()) == [1, 5]
    out = evaluate.halving(EVAL.grid(spark), BARS, evaluate.threshold, ("net_profit",), lambda d: F.col("metrics")["net_profit"], [0.5], 3)
    assert out.count() == 9 and out.where("not pruned").count() >= 3


def test_cut_of_the_newest_scores(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows_ = [(r, int(i), float(s)) for r in range(3) for i, s in zip(rng.permutation(90)[: 20 + 20 * r], rng.random(60), strict=False)]
    got = {x["rung"]: x["cut"] for x in evaluate.cut(spark.createDataFrame(rows_, "rung int, trial_id bigint, score double"), 3, recent=25).collect()}
    for r in range(3):
        newest = sorted((x for x in rows_ if x[0] == r), key=lambda x: -x[1])[:25]
        best = sorted(newest, key=lambda x: (-x[2], x[1]))
        assert got[r] == best[math.ceil(len(best) / 3) - 1][2]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Timestamp,OPEN,high,low,close,volume,extra\n1,1,2,0.5,1.5,10,x\n\n2,1,2,0.5,1.5,10,y\n")
    got = bars.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, 2.0, 0.5, 1.5, 10.0), (2, 1.0, 2.0, 0.5, 1.5, 10.0)]
    for bad in ("timestamp,open,high,low,close\n1,1,1,1,1\n", "timestamp,open,open,high,low,close,volume\n", "timestamp,open,high,low,close,volume\n1,2,x,1,1,1\n", "timestamp,open,high,low,close,volume\n1,2\n", ""):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(Refusal):
            bars.read_csv(spark, str(tmp_path / "b.csv"))


def test_order_in_the_file(spark, tmp_path):
    path = tmp_path / "b.csv"
    times = [3, 1, 2, 4, 4, 5]
    path.write_text("timestamp,open,high,low,close,volume\n" + "".join(f"{t},1,1,1,1,1\n" for t in times))
    got = bars.read_csv(spark, str(path), placed=True).withColumn("s", F.lit(1))
    bad = bars.violations(got, ["s"], "place")
    assert sorted(r["timestamp"] for r in bad.collect()) == [1, 4] and {r["reason"] for r in bad.collect()} == {"order"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        many = [i for i in range(400)]
        many[100], many[101] = many[101], many[100]
        path.write_text("timestamp,open,high,low,close,volume\n" + "".join(f"{t},1,1,1,1,1\n" for t in many))
        split = bars.read_csv(spark, str(path), placed=True).withColumn("s", F.lit(1))
        assert split.select("place.start").distinct().count() > 10
        assert [r["timestamp"] for r in bars.violations(split, ["s"], "place").collect()] == [100]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_binary(spark, tmp_path):
    content = b"".join(struct.pack("<5dq", 1.0, 2.0, 0.5, 1.5, 3.0, ts) for ts in (10, 20, 20))
    (tmp_path / "a.bin").write_bytes(content)
    got = bars.read_binary(spark, str(tmp_path / "a.bin"), bars.sidecar_of(content, "S", "1"))
    assert got.count() == 3
    assert [r["reason"] for r in bars.violations(got.withColumn("s", F.lit(1)), ["s"], "record", binary=True).collect()] == ["order"]
    with pytest.raises(Refusal):
        bars.read_binary(spark, str(tmp_path / "a.bin"), {"record_size": 48, "count": 2})


def test_months_close_within_the_month(spark):
    df = spark.sql("select unix_millis(timestamp'2024-01-31 05:00:00') as ts")
    assert df.select(F.timestamp_millis(bars.bar_close(F.col("ts"), "1M")).cast("string")).first()[0] == "2024-02-29 05:00:00"
    assert [bars.timeframe(x) for x in ("15", "4D", "1M")] == [(15, "m"), (4, "D"), (1, "M")]
    with pytest.raises(Refusal):
        bars.timeframe("0D")


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', "{"])
def test_strict_json(text):
    with pytest.raises(Refusal):
        trials.loads_strict(text)


def test_trial_sources(spark, tmp_path):
    row = {"trial_id": 1, "status": "ok", "feasible": True, "objective": 2, "metrics": {"m": 1.5, "z": None}, "parameters": {"n": 2}}
    (tmp_path / "r.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"trial_id": 2}) + "\n")
    got = trials.read_lines(spark, str(tmp_path / "r.jsonl")).orderBy("trial_id").collect()
    assert [r["trial_id"] for r in got] == [1, 2] and got[0]["metrics"] == {"m": 1.5, "z": None}
    both = trials.read_result(spark, json.dumps({"warm_start_trials": [row], "trials": [row | {"trial_id": 3}], "trials_out": "all"}))
    rows.admit(both)
    with pytest.raises(Refusal):
        trials.read_result(spark, json.dumps({"trials": [], "trials_out": "best-k"}))
    with pytest.raises(Refusal):
        rows.admit(both.union(both))
    with pytest.raises(Refusal):
        trials.as_row(row | {"trial_id": True})


def test_candidate_lists(spark, tmp_path):
    path = str(tmp_path / "c.jsonl")
    good = {"n": 2, "x": 0.1, "b": True, "c": "p"}
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(g) for g in (good, good)))
    assert [r["trial_id"] for r in trials.read_candidates(spark, path, SPACE).orderBy("trial_id").collect()] == [0, 1]
    for bad in ({"n": 3} | {k: good[k] for k in "xbc"}, {"n": 2}, good | {"x": 1}, good | {"b": 1}):
        (tmp_path / "c.jsonl").write_text(json.dumps(bad))
        with pytest.raises(Refusal):
            trials.read_candidates(spark, path, SPACE)


def test_prefixes_of_close_fractions():
    """A fraction that lies a rounding error above another doesn't add a prefix of one bar more where the first ends on a bar."""
    assert evaluate.rungs([0.1, 0.1 + 1e-12, 0.5], 720) == [72, 360, 720]
    assert evaluate.rungs([0.1, 0.1014, 0.5], 720) == [72, 74, 360, 720]


def test_several_candidate_lists(spark, tmp_path):
    """Lists follow each other, limits are each one's, and a bad line in one refuses all."""
    vectors = spark.range(120_001).select("id", (F.col("id") % 9).alias("n"))
    space = Space((Integer("n", 0, 8),))
    trials.write_candidates(vectors, "id", str(tmp_path / "lists"))
    found = trials.read_candidates(spark, str(tmp_path / "lists" / "*.json"), space)
    assert found.where("n = trial_id % 9").agg(F.count("*"), F.count_distinct("trial_id"), F.max("trial_id")).first() == (120_001, 120_001, 120_000)
    (tmp_path / "lists" / "z.json").write_text('{"n": 1}\n\n{"n": 2}')
    with pytest.raises(Refusal, match="json_syntax: 120002"):
        trials.read_candidates(spark, str(tmp_path / "lists" / "*.json"), space)
    (tmp_path / "lists" / "z.json").write_text('{"n": 1}\n' * 50_001)
    with pytest.raises(Refusal, match="candidates_lines"):
        trials.read_candidates(spark, str(tmp_path / "lists" / "z.json"), space)


def test_ordered_emission(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n, ids in enumerate(([2, 0], [1, 0, 5], [3, 4])):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"study": "s", "trial_id": i, "status": "ok"}) for i in ids))
    stream = spark.readStream.schema("study string, trial_id bigint, status string").option("maxFilesPerTrigger", 1).json(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", emission.ROCKS)
    q = emission.emit(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted(r["trial_id"] for r in got.where("outcome = 'emitted'").collect()) == [0, 1, 2, 3, 4, 5]
    assert [r["trial_id"] for r in got.where("outcome = 'rejected'").collect()] == [0]


def test_a_late_first_id_holds_the_source_back(spark, tmp_path):
    """State never has more than `bound` rows, nothing is lost, and what waits for an id that never comes stays held."""
    rows = [("a", i, "ok") for i in range(1, 40)] + [("b", 0, "ok"), ("b", 30, "ok"), ("b", 0, "again")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "study string, trial_id bigint, status string").coalesce(1).write.parquet(source)
    spark.createDataFrame([("a", 0, "late")], "study string, trial_id bigint, status string").coalesce(1).write.mode("append").parquet(source)
    got = emission.drained(spark, source, str(tmp_path / "work"), bound=20, files=1).collect()
    assert sorted(r["trial_id"] for r in got if r["study"] == "a" and r["outcome"] == "emitted") == list(range(40))
    assert sorted((r["trial_id"], r["outcome"]) for r in got if r["study"] == "b") == [(0, "emitted"), (0, "rejected"), (30, "held")]


def test_audit_and_provenance(spark, tmp_path):
    log = spark.createDataFrame([("s", 0, 1, 0), ("s", 1, 0, 0), ("s", 2, 2, 2), ("s", 3, 3, 1)], "study string, trial_id int, completion_order int, completed_before int")
    assert [r["trial_id"] for r in emission.audit(log).collect()] == [3]
    assert data_context([("a", 1, 2)]) == data_context([["a", 1, 2]])
    write_trials(spark.range(5).withColumnRenamed("id", "trial_id"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 5


@pytest.mark.parametrize("n", [0, 1, 24, 25, 26, 27, 1000])
def test_weights_of_a_whole_table(spark, n):
    found = weighted(spark.range(n).select((F.col("id") * 7).alias("trial_id"))).orderBy("trial_id").collect()
    assert [x["trial_id"] for x in found] == [7 * i for i in range(n)]
    assert [x["weight"] for x in found] == pytest.approx(list(weights(n)) if n else [])


def test_places_are_found_from_one_read_of_the_rows(spark):
    """The plan after the places reads what was written and no row again, and neighbours cross the edges of ranges."""
    from stratamill.plans import parzen

    rows = spark.range(1000).select("id", (F.col("id") % 100 / 100).alias("x"), F.lit(1.0).alias("weight"))
    found = parzen.places(rows)
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {round(r["x"], 2): (r["n"], round(r["low"], 9), round(r["high"], 9)) for r in found.collect()}
    assert len(got) == 100 and got[0.0] == (10, 0.0, 0.01) and got[0.5] == (10, 0.01, 0.01) and got[0.99] == (10, 0.01, 0.0)
