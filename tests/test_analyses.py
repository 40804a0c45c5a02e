import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fractions import Fraction

from stratamill.operators import curves, dsr, exact, holdout, neighbourhood, pareto, pbo
from stratamill.operators.ordered import lag_within, numbered, running
from stratamill.operators.ranks import twice_mid_rank
from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space
from stratamill.types import Refusal


def test_ordered_blocks_equal_one_window(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(-5, 9)) for k in range(3) for i in sorted(rng.sample(range(100), 40))]
    df = spark.createDataFrame(rows, "key int, at int, v int").withColumn("b", F.floor(F.col("at") / 7))
    df = numbered(running(lag_within(df, ["key"], "b", ["at"], "v", "prior"), ["key"], "b", ["at"], F.col("v"), "total"), ["key"], "b", ["at"], "n")
    got = {(r["key"], r["at"]): (r["prior"], r["total"], r["n"]) for r in df.collect()}
    for key in range(3):
        total, before = 0, None
        for n, (_, at, v) in enumerate(r for r in rows if r[0] == key):
            total += v
            assert got[key, at] == (before, total, n)
            before = v


def test_mid_ranks(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 4, 4, 1, 4])], "i int, v double")
    got = {r["i"]: r["rank2"] for r in twice_mid_rank(df, "v", descending=True).collect()}
    assert got == {0: 2, 1: 6, 2: 6, 4: 6, 3: 10}


def test_front_of_the_hand_worked_trials(spark):
    rows = [(0, 10.0, 5.0), (1, 12.0, 8.0), (2, 8.0, 3.0), (3, 9.0, 6.0), (4, 12.0, 8.0), (5, 7.0, 3.0), (9, 6.0, 2.0)]
    df = spark.createDataFrame(rows, "trial_id int, profit double, drawdown double")
    front = pareto.front(df, {"profit": "maximize", "drawdown": "minimize"})
    assert sorted(r["trial_id"] for r in front.collect()) == [0, 1, 2, 4, 9]
    with pytest.raises(Refusal):
        pareto.front(df, {"profit": "maximize"})


@pytest.mark.parametrize("axes", [2, 3])
def test_front_and_counts_by_brute_force(spark, axes):
    rng = random.Random(axes)
    rows = [(i, *(rng.randint(0, 9) for _ in range(axes))) for i in range(150)]
    names = [f"a{j}" for j in range(axes)]
    df = spark.createDataFrame(rows, "trial_id int, " + ", ".join(f"{n} int" for n in names)).repartition(7)
    beats = {r[0]: sum(all(y >= x for x, y in zip(r[1:], s[1:])) and r[1:] != s[1:] for s in rows) for r in rows}
    spec = dict.fromkeys(names, "maximize")
    assert sorted(r["trial_id"] for r in pareto.front(df, spec).collect()) == sorted(i for i, n in beats.items() if not n)
    assert {r["trial_id"]: r["dominated_by"] for r in pareto.domination_counts(df, spec).collect()} == beats
    with pytest.raises(Refusal):
        pareto.domination_counts(df, spec, max_work=10)


def test_domination_counts_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(pareto, "IN_RANGE", 40)
    rng = random.Random(12)
    rows = [(i, float(rng.choice([1, 2, 2, 3, rng.randint(0, 60)])), float(rng.choice([5, 5, rng.randint(0, 60), rng.random()]))) for i in range(700)]
    got = {r["i"]: r["dominated_by"] for r in pareto.domination_counts(spark.createDataFrame(rows, "i int, a double, b double"), {"a": "maximize", "b": "minimize"}).collect()}
    assert got == {i: sum(x >= a and y <= b and (x > a or y < b) for _, x, y in rows) for i, a, b in rows}
    for axes in (1, 2, 3, 4):
        of = np.array([[float(rng.randrange(5)), float(rng.randrange(700)), rng.random(), float(rng.randrange(40))][:axes] for _ in range(2500)])
        n = np.array(rng.choices([1, 2, 5], k=len(of)))
        over = (of >= of[:, None]).all(2)
        assert (pareto.dominating(of, n, of) == over @ n).all()
        assert (pareto.dominating(of[:1000], n[:1000], of[1000:] + 1) == (of[:1000] >= of[1000:, None] + 1).all(2) @ n[:1000]).all()


def test_hot_values_and_three_axes(spark, monkeypatch):
    """One value of the second axis holds half of the vectors; ranges and slices are small."""
    monkeypatch.setattr(pareto, "IN_RANGE", 40)
    rng = random.Random(13)
    rows = [(i, float(rng.randint(0, 60)), float(rng.choice([7, rng.randint(0, 20)])), float(rng.randint(0, 9))) for i in range(500)]
    axes = {"a": "maximize", "b": "minimize", "c": "maximize"}
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    want = {i: sum(x >= a and y <= b and z >= c and (x, y, z) != (a, b, c) for _, x, y, z in rows) for i, a, b, c in rows}
    assert {r["i"]: r["dominated_by"] for r in pareto.domination_counts(df, axes).collect()} == want
    found = pareto.front(df, axes)
    assert {r["i"] for r in found.collect()} == {i for i, n in want.items() if not n}
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_split_results_against_brute_force(spark):
    rng = random.Random(8)
    returns = {k: [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)] for k in range(11)}
    returns[11] = returns[3]  # winners may tie
    rows = [(k, b, len(x), sum(x), sum((v - sum(x) / len(x)) ** 2 for v in x)) for k, xs in returns.items() for b, x in enumerate(xs)]
    found = pbo.split_results(spark.createDataFrame(rows, "key int, block int, n int, s double, m2 double"), 4)
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert windows and all("_range" in x for x in windows)  # by split and range, or over one row for each range

    def sharpe(xs):
        flat = [v for x in xs for v in x]
        return statistics.mean(flat) / statistics.stdev(flat)

    want = set()
    for i, half in enumerate(pbo.ordered_splits(4)):
        inside = {k: sharpe([xs[b] for b in half]) for k, xs in returns.items()}
        out = {k: sharpe([xs[b] for b in range(4) if b not in half]) for k, xs in returns.items()}
        best = [k for k, v in inside.items() if v == max(inside.values())]
        for k in best:
            rank2 = 2 * sum(v < out[k] for v in out.values()) + sum(v == out[k] for v in out.values()) + 1
            want.add((i, k, len(best), rank2, 12, (rank2 > 13) - (rank2 < 13)))
    assert {tuple(x) for x in found.select("split", "winner", "ties", "rank2", "trials", "side").collect()} == want


def test_tied_trials_give_a_row_each(spark):
    rows = [(k, b, 5, float(b), 2.0) for k in range(30) for b in range(4)]
    found = pbo.split_results(spark.createDataFrame(rows, "key int, block int, n int, s double, m2 double"), 4).collect()
    assert len(found) == 6 * 30 and {(x["ties"], x["rank2"], x["trials"], x["side"]) for x in found} == {(30, 31, 30, 0)}


def test_overfitting_queries_hold_every_user(spark):
    from stratamill import queries

    sf = "/root/testdata/sf0.001"
    users = queries.events(spark, sf).select("user_id").distinct().count()
    assert {x["trials"] for x in queries.pbo5_split_results(spark, sf).collect()} == {users}


def test_overfitting_of_the_hand_worked_returns(spark):
    returns = [(6, 2, 7, 3), (4, 9, 3, 11), (8, 5, 1, 9), (2, 4, 10, 7)]
    rows = [(k, b, 1, float(x), 0.0) for k, xs in enumerate(returns) for b, x in enumerate(xs)]
    found = pbo.pbo(spark.createDataFrame(rows, "key int, block int, n int, s double, m2 double"), 4)
    assert (found["n_splits"], found["n_lt0"], found["n_eq0"], found["n_gt0"], found["pbo"], found["work"]) == (6, 3.0, 0.0, 3.0, 0.5, 72)


def test_splits_order(spark):
    assert pbo.ordered_splits(4) == [(0, 1), (0, 2), (0, 3), (2, 3), (1, 3), (1, 2)]
    for blocks in (2, 4, 8):
        made = {}
        for x in pbo.splits_table(spark, blocks).where("train").collect():
            made.setdefault(x["split"], set()).add(x["block"])
        assert [made[i] for i in range(len(made))] == [set(c) for c in pbo.ordered_splits(blocks)]


def test_merging_keeps_its_order_of_operations(spark):
    rng = random.Random(5)
    rows = [(k, b, float(rng.randint(2, 9)), rng.gauss(0, 3), abs(rng.gauss(0, 1))) for k in range(40) for b in range(6)]
    found = {x["key"]: x["m"] for x in pbo.folded(spark.createDataFrame(rows, "key int, block int, n double, s double, m2 double"), "key").collect()}
    for k in range(40):
        n, s, m = next((n, s, m) for key, b, n, s, m in rows if key == k and b == 0)
        for _, _, n2, s2, m2 in rows[6 * k + 1 : 6 * k + 6]:
            d = s2 / n2 - s / n
            term = d * d
            term = term * n
            term = term * n2
            n, s, m = n + n2, s + s2, (m + m2) + term / (n + n2)
        assert (found[k]["n"], found[k]["s"], found[k]["m2"]) == (n, s, m)


def test_flat_trials_are_refused(spark):
    rows = [(k, b, 3, float(k + b), 0.0 if k == 2 else 1.0 + k) for k in range(4) for b in range(4)]
    flat = [(2, b, 3, 6.0, 0.0) if k == 2 else (k, b, n, s, m) for k, b, n, s, m in rows]
    with pytest.raises(Refusal, match="pbo_zero_variance"):
        pbo.pbo(spark.createDataFrame(flat, "key int, block int, n int, s double, m2 double"), 4)
    one = spark.createDataFrame([x for x in rows if x[0] == 0], "key int, block int, n int, s double, m2 double")
    with pytest.raises(Refusal, match="pbo_too_few_trials"):
        pbo.pbo(one, 4)


def test_moves_of_logarithmic_values(spark):
    space = Space((Integer("n", 2, 100, log=True), Real("x", 0.5, 8.0, log=True), Real("y", 0.0, 10.0)))
    c = spark.createDataFrame([(1, 5, 1.0, 5.0), (2, 3, 8.0, 0.2), (3, 60, 0.5, 9.9), (4, 2, 2.0, 10.0)], "centre int, n bigint, x double, y double")
    got = {}
    for r in neighbourhood.neighbours(c, space, fraction=0.1, ratio=2.0).collect():
        got.setdefault((r["centre"], r["dimension"]), []).append(r[r["dimension"]])
    assert [sorted(got.get((k, "n"), [])) for k in (1, 2, 3, 4)] == [[3, 10], [2, 6], [30], [4]]
    assert [sorted(got.get((k, "x"), [])) for k in (1, 2, 3, 4)] == [[0.5, 2.0], [4.0], [1.0], [1.0, 4.0]]
    assert [sorted(got.get((k, "y"), [])) for k in (1, 2, 3, 4)] == [[4.0, 6.0], [1.2], [8.9], [9.0]]
    dropped = {(r["centre"], r["dimension"]): (r["bounds"], r["same_as_centre"]) for r in neighbourhood.dropped(c, space, fraction=0.1, ratio=2.0).collect()}
    assert dropped[3, "n"] == (1, 0) and dropped[4, "n"] == (1, 0) and dropped[1, "n"] == (0, 0) and dropped[2, "x"] == (1, 0) and dropped[2, "y"] == (1, 0)
    # a small ratio rounds back to the value itself
    same = {r["centre"]: (r["bounds"], r["same_as_centre"]) for r in neighbourhood.dropped(c, space, ratio=1.05).where("dimension = 'n'").collect()}
    assert same[1] == (0, 2) and same[3] == (0, 0)


def test_deflated_sharpe_of_the_hand_worked_case(spark):
    stats = spark.createDataFrame([(i, s, 10, 0.0, 3.0, 0) for i, s in enumerate([1.0, 1.5, 0.5])], "key int, sharpe_per_period double, count int, skew double, kurt_raw double, status int")
    found = dsr.dsr(stats, 0)
    assert found["variance"] == pytest.approx(0.25) and found["den"] == pytest.approx(1.5)
    assert found["sr0"] == pytest.approx(0.4264022, abs=1e-6) and found["z"] == pytest.approx(1.4050218, abs=1e-6) and found["dsr"] == pytest.approx(0.9199926, abs=1e-6)


def test_return_statistics_and_blocks(spark):
    equity = [100.0, 110.0, 99.0, 108.9, 98.01, 107.811, 97.0299, 106.73289, 96.059601]
    df = spark.createDataFrame([(1, i, i * 86_400_000, e) for i, e in enumerate(equity)], "key int, idx int, time_ms bigint, equity double")
    s = curves.return_stats(df).first()
    assert s["count"] == 8 and s["status"] == 0 and s["mean"] == pytest.approx(0.0, abs=1e-12) and s["std"] == pytest.approx(0.1 * (8 / 7) ** 0.5) and s["kurt_raw"] == pytest.approx(1.0)
    b = sorted(map(tuple, curves.block_moments(df, 4).select("block", "n", "m2").collect()))
    assert [(x, n) for x, n, _ in b] == [(0, 2), (1, 2), (2, 2), (3, 2)] and b[0][2] == pytest.approx(0.02)
    assert sorted((r["block"], r["first_interval"], r["n"]) for r in curves.block_layout(df, 4).collect()) == [(0, 0, 2), (1, 2, 2), (2, 4, 2), (3, 6, 2)]


def test_statuses_of_curves(spark):
    rows = [(1, 0, 0, 1.0), (1, 1, 1, 2.0), (2, 0, 0, 1.0), (2, 1, 1, float("nan")), (3, 0, 0, -1.0), (3, 1, 5, 2.0), (3, 2, 9, 2.0)]
    got = {r["key"]: (r["status"], r["count"], r["skipped"]) for r in curves.return_stats(spark.createDataFrame(rows, "key int, idx int, time_ms bigint, equity double")).collect()}
    assert got[1] == (6, 1, 0) and got[2][0] == 4 and got[3] == (1, 1, 1)


def test_holdout_and_walk_forward(spark):
    schema = "window int, trial_id int, vector string, value int, reason string"
    rows = [(1, 0, "a", 5, None), (1, 1, "b", 4, None), (1, 2, "c", 9, "status_pruned"), (2, 0, "a", 1, None), (2, 5, "b", 3, None), (2, 7, "d", 8, None), (4, 1, "b", 2, None)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    s, h = df.where("window = 1"), df.where("window = 2")
    got = [tuple(r) for r in holdout.compare(s, h, 2).select("place", "vector", "holdout_value", "rank2", "better_half", "reason").orderBy("place").collect()]
    assert got == [(1, "a", 1, 4, False, None), (2, "b", 3, 2, True, None)]
    assert holdout.spearman(s, h) == {"n": 2, "rho": None, "reason": "too_few"}
    assert [tuple(r) for r in holdout.holdout_only(s, h).collect()] == [("d", 7, 8)]
    assert [tuple(r) for r in holdout.carried(df).collect()] == [(1, 2, 0, "a", 1, 6, None)]
    assert [tuple(r) for r in holdout.breaks(df).collect()] == [(2, 4)]


def test_neighbourhood(spark):
    space = Space((Integer("fast", 2, 10, 2), Boolean("flag"), Categorical("mode", ("ema", "sma", "wma"))))
    rows = [(0, 4, True, "sma", "ok", 10.0), (1, 6, True, "sma", "ok", 10.3), (2, 2, True, "sma", "constraint_violation", 7.0), (3, 4, False, "sma", "engine_error", None), (4, 4, True, "wma", "ok", 3.0)]
    df = spark.createDataFrame(rows, "trial_id int, fast int, flag boolean, mode string, status string, objective double")
    centre = df.where("trial_id = 0").select(F.lit(1).alias("centre"), "fast", "flag", "mode")
    p = neighbourhood.profile(df, space, centre, 1.0).first().asDict()
    assert (p["geometric"], p["ok"], p["infeasible"], p["unscorable"], p["never"], p["near"], p["best"]) == (5, 2, 1, 1, 1, 1, 10.3)
    assert p["share"] == pytest.approx(1 / 3) and p["coverage"] == pytest.approx(0.8)
    assert [tuple(r) for r in neighbourhood.missing(df, space, centre).collect()] == [(4, True, "ema")]
    assert neighbourhood.pair_map(df, space, centre, "fast", "mode").count() == 9


def test_exact_sums_under_any_partitioning(spark):
    rng = random.Random(31)
    values = [rng.choice([rng.gauss(0, 1), rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300), 2.0 ** rng.randint(-1074, 1023), float(rng.randint(-9, 9)), -0.0, 5e-324, 1.7976931348623157e308]) for _ in range(3000)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v double, k int")
    odd = spark.createDataFrame([(None, 0), (float("nan"), 1), (float("inf"), 2)], "v double, k int")
    total, squares = sum(map(Fraction, values)), sum(Fraction(v) ** 2 for v in values)
    for parts in (1, 7):
        found = exact.collected(exact.sums(df.repartition(parts).union(odd), "v"))
        assert (found.n, found.total, found.squares) == (3000, total, squares)
    half = exact.merged([exact.sums(df.where("k = 0"), "v"), exact.sums(df.where("k > 0"), "v")])
    assert exact.collected(half).total == total
    small = df.where("abs(v) < 1e100")
    by = {r["k"]: r for r in exact.figures(exact.sums(small, "v", ["k"]), ["k"]).collect()}
    for k in range(3):
        xs = [Fraction(v) for i, v in enumerate(values) if i % 3 == k and abs(v) < 1e100]
        mean = sum(xs) / len(xs)
        assert (by[k]["n"], by[k]["mean"], by[k]["variance"]) == (len(xs), float(mean), float(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)))
    none = exact.collected(exact.sums(df.limit(0), "v"))
    assert (none.n, none.mean(), none.variance()) == (0, None, None)
