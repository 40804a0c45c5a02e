import hashlib
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from stratamill.llm import clustering, conversations, toxicity
from tests.llm.conftest import frame, words
from tests.llm.test_operators import against_sql

# ---- 11 conversations --------------------------------------------------------


def every_repair(symbols, most=3):
    """The smallest (cost, labels) of all edit sequences with at most `most` insertions together, by trying them."""
    best = [(10**9, "")]

    def legal(written):
        s = written.removeprefix("s")
        return not written or (s and s == "ua" * (len(s) // 2))

    def go(i, cost, labels, written, inserted):
        if cost > best[0][0]:
            return
        if i == len(symbols) // 2:
            if legal(written):
                best[0] = min(best[0], (cost, labels))
        else:
            initial, fault = symbols[2 * i], int(symbols[2 * i + 1])
            go(i + 1, cost + 4, labels + "D", written, 0)
            if fault in (0, 3):
                more = 3 * (fault == 3)
                go(i + 1, cost + more, labels + "K", written + initial, 0)
                for role in "ua":
                    go(i + 1, cost + more + 3, labels + "R", written + role, 0)
        if inserted < most:
            for role in "ua":
                go(i, cost + 3, labels + "I", written + role, inserted + 1)

    go(0, 0, "", "", 0)
    return best[0]


def test_cheapest_edits_against_all():
    rng = random.Random(3)
    cases = ["", "s0", "u0", "a0", "-0", "s0s0", "a0u0", "u0u0a0", "s0u0a0u3", "u1a2", "s3"]
    cases += ["".join(rng.choice("sua-") + rng.choice("00123") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    for symbols in cases:
        assert conversations.cheapest(symbols) == every_repair(symbols, 2), symbols


def test_long_chain():
    """Work and memory are linear: 40,000 rows, of which every 100th is of another role."""
    symbols = "".join(("s0" if i % 100 == 99 else "u0" if i % 2 == 0 else "a0") for i in range(40_000))
    cost, audit = conversations.cheapest(symbols)
    assert len(audit.replace("I", "")) == 40_000 and cost == sum({"K": 0, "R": 3, "D": 4, "I": 3}[c] for c in audit)
    assert cost <= 4 * 400


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place int, digest string, audit string")


def chat_rows():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
            text = rng.choice(["Yes.", "Why?", " \n\t", "", None, "cut off", "end. \n", "é ß!", "Yes.", "x" * 5000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text, 1, "d", "a"))
    return rows + rows[:5]


def test_conversations_against_sql(spark, monkeypatch):
    rows = chat_rows()
    df = chats(spark, rows)
    monkeypatch.setattr(conversations, "table", lambda s, d, n: df)
    pdf = pd.DataFrame(rows, columns=df.columns).astype({"conv_id": "Int64", "turn": "Int64"})
    got = against_sql(conversations.op11_conversation_repair(spark, ""), conversations.ORACLE_OP11, conversations=pdf)
    assert len(got) == len({r[0] for r in rows})
    assert any(r[-2] == "" for r in got) and {c for r in got for c in r[-2]} == set("KRDI")


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind.", 0, "", ""), (1, 1, "assistant", "Hello.", 0, "", ""), (1, 2, "user", "so", 0, "", ""), (1, 2, "user", "so", 0, "", "")]
    df = chats(spark, rows)
    found = conversations.audits(df)
    r = found.collect()[0]
    assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == (0, 0, 1, 1, 2)
    assert (r["cost"], r["audit"]) == every_repair("s0a0u3u2")
    fixed = conversations.repaired(df, found).collect()
    assert [x["role"] for x in fixed] == ["system", "user", "assistant"] and [x["place"] for x in fixed] == [0, 1, 2]
    assert [x["text"] for x in fixed if x["edit"] == "I"] == [""] * r["audit"].count("I")


def test_no_conversations(spark):
    df = chats(spark, [])
    assert conversations.audits(df).count() == 0
    assert conversations.repaired(df, conversations.audits(df)).count() == 0


def test_damage_is_crc32(spark):
    rows = [(c, t, "user", "a. b! c?", 0, "", "") for c in range(30) for t in (0, 1, None)]
    got = sorted((r["conv_id"], r["turn"] is None, r["turn"], r["role"], r["text"]) for r in conversations.damaged(chats(spark, rows)).collect())
    want = []
    for c, t, role, text, *_ in rows:
        hit = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: "a b c"}.get(hit, text)
        want += [(c, t is None, t, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    assert got == sorted(want)


# ---- 12 clustering -----------------------------------------------------------


def plain_kmeans(x, first, rounds):
    c = [list(map(int, v)) for v in first]
    for r in range(rounds + 1):
        a = [min(range(len(c)), key=lambda j: (sum((p - q) ** 2 for p, q in zip(v, c[j], strict=True)), j)) for v in x]
        if r < rounds:
            for j in range(len(c)):
                own = [v for v, k in zip(x, a, strict=True) if k == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return a, c


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "s") for i, v in rows], "vec_id bigint, embedding array<float>, label int, cluster int, vector string")


def test_bounds_skip_and_stay_exact():
    """Against all distances, on a lattice with many ties; most distances aren't taken."""
    rng = np.random.default_rng(4)
    for spread, k in ((2, 7), (300, 12)):
        centres = rng.integers(-spread, spread, (k, 5)) * 4
        x = (centres[rng.integers(0, k, 3000)] + rng.integers(-2, 3, (3000, 5))).astype(np.int64)
        now, before = x[:k].copy(), None
        cluster, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf, np.float32), np.zeros((len(x), k), np.float32)
        taken = []
        for _ in range(5):
            taken.append(clustering.assign(x, cluster, upper, lower, clustering.Centres(now, before)))
            every = np.array([clustering.squares(x, c) for c in now]).T
            assert (cluster == every.argmin(1)).all()
            assert (upper.astype(float) ** 2 >= every[np.arange(len(x)), cluster]).all() and (lower.astype(float) ** 2 <= every).all()
            before, now = now, np.array([x[cluster == j].sum(0) // (cluster == j).sum() if (cluster == j).any() else now[j] for j in range(k)])
        if spread > 2:
            assert taken[-1] < taken[0] / 4


def test_centroids_against_sql(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-3, 4, 64) / 256).tolist()) for i in range(90)]
    rows += [(5, rows[5][1]), (6, rows[7][1]), (None, rows[8][1]), (200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 63 + [None]), (204, [float("nan")] * 64), (205, [float("-inf")] * 64)]
    df = vectors(spark, rows)
    monkeypatch.setattr(clustering, "table", lambda s, d, n, b: df)
    pdf = pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "embedding": [r[1] for r in rows]})
    got = against_sql(clustering.op12_centroid_clustering(spark, ""), clustering.ORACLE_OP12, embeddings=pdf)
    assert len(got) == 93

    kept = [(i, tuple(int(np.floor(256 * np.float32(c))) for c in v)) for i, v in rows[:93]]
    seeds = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept)[:40]
    a, c = plain_kmeans([v for _, v in kept], [s[2] for s in seeds], 5)
    want = sorted((str(i), k, sum((p - q) ** 2 for p, q in zip(v, c[k], strict=True))) for (i, v), k in zip(kept, a, strict=True))
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want


def test_few_and_no_vectors(spark):
    few, centroids = clustering.cluster(vectors(spark, [(1, [0.5] * 64), (2, [0.25] * 64)]))
    assert len(centroids) == 2 and {r["distance"] for r in few.collect()} == {0}
    out, centroids = clustering.cluster(vectors(spark, [(1, None)]))
    assert out.collect() == [] and len(centroids) == 0
    with pytest.raises(Exception, match="a component of"):
        clustering.cluster(vectors(spark, [(1, [1e30] * 64)]))[0].collect()


# ---- 13 toxicity -------------------------------------------------------------


def test_windows_cover_all_words():
    row = np.repeat([1, 2, 4], [1, 32, 75])
    text, start, size = toxicity.windows(row, 6)
    assert text.tolist() == [0, 1, 2, 3, 4, 4, 4, 4, 5] and size.tolist() == [0, 1, 32, 0, 32, 32, 32, 32, 0]
    assert (start[4:8] - 33).tolist() == [0, 16, 32, 43]


def test_gradients():
    """Backpropagation against differences of the loss."""
    rng = np.random.default_rng(1)
    net = toxicity.Network.new(np.arange(3, dtype=np.uint64), np.arange(4, dtype=np.uint64))
    net.w = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in net.w.items()}
    g = rng.standard_normal((5, 3, 6 * toxicity.STATE))
    mask = np.arange(5)[:, None] < np.array([5, 3, 1])
    _, tape = net.forward(g, mask, keep=True)
    weight = np.array([0.3, -1.0, 0.7])
    grads, d_g = net.backward(mask, tape, weight)

    def loss():
        return float(net.forward(g, mask) @ weight)

    for name, grad in [*grads.items(), ("g", d_g)]:
        x = g if name == "g" else net.w[name]
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in x.shape)
            old, step = x[at], 1e-5
            x[at] = old + step
            up = loss()
            x[at] = old - step
            down = loss()
            x[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-3 * max(1, abs(grad[at])), name


def toxic_rows(n, seed, kinds=("scum", "zortig", "zorten")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = words(rng, rng.randint(5, 120), "abcde").split()
        label = int(i % 4 == 0)
        if label:
            t[rng.randrange(len(t))] = rng.choice(kinds)
        out.append((seed * 10_000 + i, " ".join(t), label))
    return out


def test_toxicity_learns_words_and_stems(spark, odd_rows, none):
    seen = toxic_rows(600, 1)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in seen] + [(1, None, 1), (None, 1, 1)], "doc_id bigint, label int, score int")
    model = toxicity.fit(frame(spark, [(i, t, None, None) for i, t, _ in seen]), labels)
    unseen = toxic_rows(200, 2, ("scum", "SCUM!", "zortig", "zortabel"))  # the last one is new and shares a stem
    got = {r["doc_id"]: r for r in toxicity.scored(model, frame(spark, [(i, t, None, None) for i, t, _ in unseen])).collect()}
    right = sum(got[i]["predicted"] == y for i, _, y in unseen)
    assert right >= 190
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())

    out = toxicity.scored(model, frame(spark, odd_rows)).collect()
    assert len(out) == len(odd_rows) and out[0]["n_chars"] is None
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[1] == by[2] == by[3] and all(0 <= s <= 1 for s in by.values())
    assert toxicity.scored(model, none).count() == 0

    # By hand, one text at a time, with every window.
    scorer = toxicity.Scorer(model)
    import pyarrow as pa

    for i, t, _ in unseen[:20]:
        corpus = toxicity.Corpus([t])
        x = model.net.inputs(toxicity.places(model.net.word, corpus.hashes), corpus.gram_row, toxicity.places(model.net.gram, corpus.gram_hash))
        g = model.net.gates(x)[corpus.word]
        n, best = len(g), -1e9
        for start in sorted({*range(0, max(n - 32, 0) + 1, 16), max(n - 32, 0)}):
            w = g[start : start + 32][:, None]
            best = max(best, model.net.forward(w, np.ones(w.shape[:2], bool))[0])
        assert abs(1 / (1 + np.exp(-best - model.shift)) - got[i]["score"]) < 1e-5
        assert abs(scorer.score(pa.array([t]))[0] - got[i]["score"]) < 1e-5


def test_toxicity_without_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r["score"] for r in toxicity.scored(toxicity.fit(odd, empty), odd).collect()} == {0.0}
    one = spark.createDataFrame([(4, 1)], "doc_id bigint, label int")
    assert {r["predicted"] for r in toxicity.scored(toxicity.fit(odd, one), odd).collect()} == {1}
    both = spark.createDataFrame([(4, 1), (5, 0)], "doc_id bigint, label int")
    assert toxicity.scored(toxicity.fit(none, both), odd).count() == len(list(itertools.islice(odd.collect(), 100)))
