"""Contracts that are calls of the library and not queries of a table."""

import contextlib
import io
import json
import math
import time

import numpy as np
import pytest

from stratamill.operators import evaluate, pareto
from stratamill.plans import continuation, parzen, rolling, samplers
from stratamill.plans.cli import main
from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space
from stratamill.plans.study import Study, data_context, exit_code
from stratamill.plans.tpe import Parzen, Tpe, choice_mass, log_interval, split, weights
from stratamill.queries_detail import SPEC
from stratamill.sources import inventory
from stratamill.types import Refusal


def refusal(make):
    try:
        make()
        return "ok"
    except Refusal as e:
        return e.code


def test_request_feeds():
    a, b = "a" * 64, "b" * 64
    good = {"schema": "1", "source_sha256": a, "artifact_sha256": b, "primary_chart_timeframe": "15", "entries": [{"kind": "token", "timeframe": "240"}, {"kind": "input", "key": "tf", "default": "D"}, {"kind": "input", "key": "fixed", "default": "5"}]}
    space = Space((Categorical("tf", ("D", "60")), Integer("n", 1, 3)))

    def entry(**e):
        return good | {"entries": [e]}

    cases = {
        "15,1D,240,60": good, "missing": None, "unbound": good | {"artifact_sha256": None}, "artifact_mismatch": good | {"source_sha256": b}, "chart_mismatch": good | {"primary_chart_timeframe": "30"},
        "unknown": entry(kind="unknown"), "input_unresolved": entry(kind="input", key="n", default="5"), "selected_window_request_feed_timeframe": entry(kind="token", timeframe="7"),
    }
    more = {"invalid": [good | {"more": 1}, entry(kind="token", timeframe="D")], "input_unresolved": [entry(kind="input", key="x", default="often")]}

    def outcome(case):
        try:
            return ",".join(inventory.admit(case, a, b, "15", {"15", "60", "240", "1D"}, {"fixed": "15"}, space))
        except Refusal as e:
            return e.context.get("reason", e.context["capability"])

    for want, case in [*cases.items(), *((k, c) for k, cs in more.items() for c in cs)]:
        assert outcome(case) == want


def test_published_normal_intervals():
    """Published values of the normal distribution."""
    for low, high, ln in ((-1e9, -1.0, -1.841022), (-1e9, -5.0, -15.064998), (-1e9, -10.0, -53.231285), (-1e9, -20.0, -203.917155), (-1.0, 1.0, -0.381715), (10.0, 1e9, -53.231285), (0.0, 1e9, -0.693147)):
        assert float(log_interval(low, high)) == pytest.approx(ln, abs=1e-6)


def test_masses_sum_to_one():
    stepped = Real("x", 0.0, 0.9, 0.1)
    t, p = Tpe(Space((Integer("n", 1, 9),)), 1), Parzen(np.array([0.1, 0.4, 0.45, 0.9]), np.ones(4))
    for d, values in ((Integer("n", 3, 40), range(3, 41)), (Integer("n", 1, 60, log=True), range(1, 61)), (stepped, stepped.values())):
        assert sum(math.exp(p.log_mass(*t._bin(d, v))) for v in values) == pytest.approx(1, abs=1e-6)
    x = (np.arange(20_000) + 0.5) / 20_000
    assert np.mean([math.exp(p.log_density(float(v))) for v in x]) == pytest.approx(1, abs=1e-5)


def test_pending_vectors_count_as_bad():
    held = []

    class Watched(Tpe):
        def _dimension(self, d, good, bad):
            held.append((len(good), len(bad)))
            return super()._dimension(d, good, bad)

    t = Watched(Space((Real("x", 0.0, 1.0),)), 5)
    t.seen = [({"x": i / 20}, float(i)) for i in range(20)]
    for i in range(3):
        t.ask()
        assert held[-1] == (2, 18 + i)


def test_published_words_of_the_serial_stream():
    """The first outputs of the 64-bit Mersenne Twister seeded with 5489 (fixed values)."""
    words = (14514284786278117030, 4620546740167642908, 13109570281517897720, 17462938647148434322, 355488278567739596, 7469126240319926998, 4635995468481642529, 418970542659199878, 9604170989252516556)
    space = Space((Integer("a", 0, 999), Boolean("b"), Categorical("c", tuple(range(7)))))
    drawn = samplers.random_serial(space, 5489, 3)
    assert [(x["a"], x["b"], x["c"]) for x in drawn] == [(words[3 * i] % 1000, words[3 * i + 1] % 2 == 1, words[3 * i + 2] % 7) for i in range(3)]


def test_setting_order():
    made = evaluate.settings("UTC", {"slippage": 2}, {"length": 5, "mult": 2.0}, {"mintick": 0.1}, {"240": "x.csv"})
    assert [(k, n) for k, n, _ in made] == [("timezone", "timezone"), ("override", "slippage"), ("input", "length"), ("input", "mult"), ("syminfo", "mintick"), ("feed", "240")]


def test_exit_codes():
    for statuses, best, code in (("ok", True, 0), ("ok,trial_error", True, 0), ("constraint_violation", False, 2), ("ok,trial_timeout", True, 3)):
        assert exit_code(set(statuses.split(",")), best) == code


def test_each_trial_has_its_own_deadline(spark):
    """The first trial sleeps past its own deadline while short ones come and go."""

    def evaluator(bars, p):
        time.sleep(60 if p["n"] == 0 else 0.2)
        return {"m": 1.0}

    class Numbers:
        n = -1

        def ask(self):
            self.n += 1
            return {"n": self.n}

        def tell(self, c, objective):
            """Nothing is learnt."""

        abandon = lambda self, c: None

    spark.range(10).mapInPandas(lambda b: b, "id long").count()  # workers have started
    rows, _ = rolling.run(spark, Study(Space((Integer("n", 0, 9),)), "m", ("m",)), Numbers(), {"close": np.ones(3)}, evaluator, 4, workers=2, seconds=25.0)
    assert [x["status"] for x in sorted(rows, key=lambda x: x["trial_id"])] == ["trial_timeout", "ok", "ok", "ok"]


def test_identities():
    a, files = Space((Integer("n", 1, 9), Boolean("b"))), [("x", 5, 1), ("y", 6, 2)]
    assert a.hash() == Space((Integer("n", 1, 9), Boolean("b"))).hash() != Space((Integer("n", 1, 8), Boolean("b"))).hash()
    assert data_context(files) == data_context(files[::-1]) != data_context([("x", 5, 1), ("y", 7, 2)])


@pytest.mark.parametrize("command, text, code, fields", [("check", SPEC, 0, "cardinality,space_hash"), ("space-info", SPEC, 0, "cardinality,next_id,remaining,tried"), ("check", {}, 2, "")])
def test_command_line(tmp_path, command, text, code, fields):
    (tmp_path / "spec.json").write_text(json.dumps(text))
    out = io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
        assert main([command, str(tmp_path / "spec.json")]) == code
    assert (",".join(sorted(json.loads(out.getvalue()))) if out.getvalue() else "") == fields


def test_axes():
    made = {"ok": [("a", "maximize"), ("b", "minimize")], "axes": [("a", "maximize")], "axis_repeated": [("a", "maximize"), ("a", "minimize")], "axis_direction": [("a", "maximize"), ("b", "")]}
    for want, axes in made.items():
        assert refusal(lambda axes=axes: pareto.admit(axes)) == want


# ---- Bounded histories ---------------------------------------------------------


def test_every_old_row_is_as_likely_to_be_kept(spark):
    """20,000 observations: the sample's ids are uniform over all that were offered, whatever the seed."""
    space = Space((Real("x", 0.0, 1.0),))
    tenths = np.zeros(10)
    for seed in range(12):
        t = continuation.BoundedTpe(space, seed)
        for i in range(20_000):
            t.observe(i, {"x": 0.5}, float(i * 7919 % 20_011))
        assert len(t.kept) == 537 and t.offered == 20_000 - 89
        tenths += np.bincount([x[1] // 2000 for x in t.sample], minlength=10)
    expected = 12 * 448 / 10
    assert ((tenths - expected) ** 2 / expected).sum() < 27.9  # chi-square of 9 degrees beyond 0.001


def test_history_of_a_table_is_that_of_single_rows(spark):
    space = Space((Integer("n", 0, 99),))
    rows = [(i, float(i * 37 % 1009), i % 100) for i in range(3000)]
    df = spark.createDataFrame(rows, "trial_id bigint, objective double, n bigint")
    for minimize in (False, True):
        one = continuation.BoundedTpe(space, 4, minimize)
        for i, v, n in rows:
            one.observe(i, {"n": n}, v)
        kept = {r["trial_id"]: r["role"] for r in continuation.bounded_history(df.repartition(5), 4, minimize).collect()}
        assert kept == one.roles()
        many = continuation.warmed(continuation.BoundedTpe(space, 4, minimize), df.selectExpr("*", "true as feasible"), most=10)
        assert many.roles() == kept and (many.count, many.offered, many.kept) == (one.count, one.offered, one.kept)


def test_a_bounded_sampler_comes_back(spark):
    space = Space((Real("x", 0.0, 1.0), Integer("n", 1, 40), Categorical("c", ("p", "q")), Boolean("b")))
    t = continuation.BoundedTpe(space, 9, minimize=True)
    for i in range(700):
        c = t.ask()
        t.tell(c, (c["x"] - 0.7) ** 2 + c["n"] / 40)
    pending = t.ask()
    again = continuation.load_state(space, continuation.save_state(t))
    assert type(again) is continuation.BoundedTpe and again.roles() == t.roles() and again.pending == [pending]
    for _ in range(40):  # over a refit
        a, b = t.ask(), again.ask()
        assert a == b
        t.tell(a, a["x"])
        again.tell(b, b["x"])
    outer = json.loads(continuation.save_state(t))
    outer["body"] = outer["body"].replace('"version":2', '"version":1')
    assert refusal(lambda: continuation.load_state(space, json.dumps(outer))) == "state_checksum"


def test_sobol_blocks_are_the_expressions(spark, monkeypatch):
    space = Space((*(Real(f"x{i}", 0.0, 1.0) for i in range(5)), Integer("n", 0, 999), Categorical("c", ("a", "b", "q")), Integer("one", 3, 3)))
    ids = spark.createDataFrame([(i,) for i in (0, 1, 2, 7, 8, 9, 500, 4, 1 << 33)], "trial_id bigint")
    want = sorted(map(tuple, samplers.sobol_at(ids, space, 5).collect()))
    monkeypatch.setattr(samplers, "WIDE", 2)
    assert sorted(map(tuple, samplers.sobol_at(ids, space, 5).collect())) == want


def test_a_thousand_columns(spark):
    """Every column of a net takes each of the first 64 intervals once, with any odd numbers to start from."""
    table = tuple((1 + k % 7, 0, tuple(1 + 2 * ((k * 7 + j) % (1 << j)) for j in range(1 + k % 7))) for k in range(1023))
    points = samplers.sobol(spark, Space(tuple(Real(f"x{i:04d}", 0.0, 1.0) for i in range(1024))), 64, seed=3, table=table).collect()
    x = np.array([[r[f"x{i:04d}"] for i in range(1024)] for r in points])
    assert (np.sort((x * 64).astype(int), 0) == np.arange(64)[:, None]).all()


def test_parts_of_a_stream(spark):
    ids = [(0, i) for i in range(5)] + [(1, i) for i in range(5, 8)] + [(2, 8), (2, 8)] + [(3, i) for i in (9, 11)] + [(4, 12)]
    got = {r["part"]: tuple(r)[1:] for r in samplers.parts(spark.createDataFrame(ids, "part int, trial_id bigint")).collect()}
    assert got == {0: (0, 5, 5, True), 1: (5, 8, 3, True), 2: (8, 9, 2, False), 3: (9, 12, 2, False), 4: (12, 13, 1, False)}


def test_models_of_a_table_are_those_of_a_list(spark):
    """Places that many share, ends of the line, single rows; densities and masses at every point."""
    rng = np.random.default_rng(3)
    space = Space((Real("x", 0.0, 10.0), Integer("n", 1, 40, log=True), Real("s", 0.0, 0.9, 0.1), Categorical("c", ("p", "q", "r")), Boolean("b")))
    steps = space.dimensions[2].values()
    for size in (12, 40, 300):
        rows = [(i, float(rng.standard_normal()), float(rng.choice([rng.uniform(0, 10), 3.0, 0.0, 10.0])), int(rng.integers(1, 41)), steps[int(rng.integers(10))], str(rng.choice(["p", "q"])), bool(rng.random() < 0.2)) for i in range(size)]
        df = spark.createDataFrame(rows, "trial_id bigint, objective double, x double, n bigint, s double, c string, b boolean")
        t = Tpe(space, 1)
        bad = split([(o, i) for i, (_, o, *_) in enumerate(rows)])[1]
        w = weights(len(bad))
        points = {"x": np.linspace(0, 1, 21), "n": np.array([t._bin(space.dimensions[1], v) for v in range(1, 41)]), "s": np.array([t._bin(space.dimensions[2], v) for v in steps])}
        got = parzen.log_densities(parzen.bad_normals(df, space), points)
        for k, name in enumerate("xns"):
            model = Parzen(np.array([t._encode(space.dimensions[k], rows[i][2 + k]) for i in bad]), w)
            want = [model.log_mass(*p) for p in points[name]] if points[name].ndim == 2 else [model.log_density(float(p)) for p in points[name]]
            assert got[name] == pytest.approx(want, abs=1e-12)
        assert parzen.bad_choices(df, space.dimensions[3]) == pytest.approx(choice_mass(np.array(["pqr".index(rows[i][5]) for i in bad]), w, 3))
        asked = parzen.proposals(space, df, 3, 7)
        assert len(asked) == 3 and all(list(c) == space.names and 1 <= c["n"] <= 40 and c["s"] in steps for c in asked)


def test_first_proposals_of_a_large_batch_learn(spark):
    space = Space((Real("x", 0.0, 1.0),))
    rows = [(i, -abs(i / 3000 - 0.3), i / 3000) for i in range(3000)]
    df = spark.createDataFrame(rows, "trial_id bigint, objective double, x double")
    assert all(abs(c["x"] - 0.3) < 0.1 for c in parzen.proposals(space, df, 8, 2))
