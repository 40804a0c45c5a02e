"""The pipeline's stages against a brute-force version, on a small set of documents."""

import hashlib
import random
import re

import corpus_pipeline
from tests.llm.conftest import frame, words
from tests.llm.test_operators import classes, token_rows

KINDS = {"aa": "abcde", "bb": "vwxyz"}


def rows_and_items():
    rng = random.Random(21)
    items = [(i, words(rng, 25, KINDS["aa"])) for i in range(3)]
    rows = []
    for i in range(240):
        lang = list(KINDS)[i % 2]
        rows.append((i, words(rng, rng.randint(20, 90), KINDS[lang]), lang, rng.choice(["s1", "s1", "s1", "s2", "s3"])))
    rows += [(1000 + i, rows[i][1], rows[i][2], "s1") for i in range(0, 60, 3)]  # exact copies
    rows += [(1100 + i, rows[i][1].upper() + " " + words(rng, 1), rows[i][2], "s2") for i in range(1, 60, 7)]  # near copies
    rows += [(1200 + i, f"{words(rng, 30, KINDS['aa'])} {t} {words(rng, 30, KINDS['aa'])}", "aa", "s3") for i, t in items]
    rows += [(1300, None, "aa", "s1"), (1301, "12 34", None, None), (1302, "", "bb", "s2")]
    return rows, items


def mixed(rows):
    """doc_id and text as often as the mix takes them, with thresholds found by sorting."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for i, r in enumerate(rows)}
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    own = {s: sum(size[i] for i, r in enumerate(rows) if r[3] == s) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    target, free, budget = {}, list(sources), 1.5 * sum(own.values())
    while True:
        level = budget / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * own[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * own[s]
            budget -= target[s]
            free.remove(s)
    target |= {s: level * weight[s] for s in free}

    def h(r):
        text = hashlib.md5((r[1] or "").encode()).hexdigest()
        return int(hashlib.md5("|".join([*([str(r[0])] if r[0] is not None else []), text]).encode()).hexdigest()[:15], 16)

    out = []
    for s in sources:
        once = target[s] > own[s]
        left = target[s] - (own[s] if once else 0)
        for i in sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: h(rows[i])):
            again = size[i] <= left or size[i] - left < left
            out += [rows[i]] * (once + again)
            left = left - size[i] if size[i] <= left else 0
    return out


def brute(rows, items):
    rows = [r for r in rows if re.search("[^\\W\\d_]", r[1] or "")]
    firsts = {c for (d, c) in classes(rows)}
    rows = [r for r in rows if r[0] in firsts]

    def plain(t):
        return " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "

    rows = [r for r in rows if not any(plain(t) in plain(r[1]) for _, t in items)]
    return mixed(rows)


def test_run(spark, tmp_path):
    rows, items = rows_and_items()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = token_rows(brute(rows, items))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_ids"]
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = frame(spark, rows_and_items()[0])
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == frame(spark, []).columns, name


def test_sure_languages_only(spark, monkeypatch):
    """A text without letters goes; so do all if no language can be sure enough, and none of the others if any is."""
    rng = random.Random(19)
    rows = [(i, words(rng, 30, kind), lang, "a") for i, (kind, lang) in enumerate([("abc", "xa"), ("xyz", "xb")] * 12)]
    rows += [(100, "12 34", "xa", "a"), (101, None, "xb", "a"), (102, "abc cab xyz zyx", None, "a")]
    docs = frame(spark, rows)
    left = {}
    for sure in (0.0, 0.5, 1.1):
        monkeypatch.setattr(corpus_pipeline, "SURE", sure)
        left[sure] = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert left[0.0] == set(range(24)) | {102} and left[0.5] >= set(range(24)) and left[1.1] == set()
