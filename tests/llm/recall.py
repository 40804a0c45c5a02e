"""python tests/llm/recall.py FOLDER: recall of benchmark decontamination and of near-duplicate links over a folder of tables, against exhaustive search."""

import os
import random
import sys
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from stratamill.llm import decontam, neardup  # noqa: E402
from stratamill.llm.words import MARKS, lowered, words  # noqa: E402


def common_length(item: np.ndarray, span: np.ndarray) -> int:
    """Longest common subsequence, a bit for each word of the item."""
    at = defaultdict(int)
    for i, x in enumerate(item.tolist()):
        at[x] |= 1 << i
    every, row = (1 << len(item)) - 1, (1 << len(item)) - 1
    for y in span.tolist():
        u = row & at.get(y, 0)
        row = ((row + u) | (row - u)) & every
    return len(item) - row.bit_count()


def exact_leaks(docs: list, items: decontam.Items) -> set[tuple[int, int]]:
    """(number of the document, number of the item) of every span of twice an item's length that holds it."""
    row, h, *_ = words(lowered(pa.array([d["text"] for d in docs], pa.large_string())), MARKS)
    _, code = np.unique(np.concatenate([h, *items.words]), return_inverse=True)
    tokens, ends = code[: len(h)], np.cumsum(np.bincount(row, minlength=len(docs)))
    starts, at, found = np.append(0, ends[:-1]), len(h), set()
    kinds = code.max() + 1
    by_hash = dict(zip(np.concatenate([h, *items.words]).tolist(), code.tolist(), strict=True))
    for i, own in enumerate(items.words):
        item, n = code[at : at + len(own)], len(own)
        at += n
        answer = np.array([by_hash[x] for x in items.answers[i].tolist()])
        if n < decontam.SHORT:
            near = np.flatnonzero(np.all([np.roll(tokens, -k) == x for k, x in enumerate(item)], 0))
            found |= {(int(row[p]), i) for p in near if p + n <= ends[row[p]]}
            continue
        known = np.zeros(kinds, bool)
        known[item] = True
        total = np.append(0, np.cumsum(known[tokens]))
        low, high = np.maximum(np.arange(len(tokens)) - n // 2, starts[row]), np.minimum(np.arange(len(tokens)) + n + n // 2, ends[row])
        many = total[high] - total[low]
        there = np.flatnonzero(np.all([np.roll(tokens, -k) == x for k, x in enumerate(answer)], 0))
        there = there[there + len(answer) <= ends[row[np.minimum(there, len(row) - 1)]]]
        around = np.zeros(len(tokens), bool)
        for p in there.tolist():
            around[max(0, p - 2 * n) : p + 2 * n] = True
        asked = np.flatnonzero((many >= decontam.NEAR * n) | (around & (many >= decontam.LOOSE * n)))
        for p in asked.tolist():
            d = int(row[p])
            if (d, i) in found:
                continue
            span = tokens[low[p] : high[p]]
            k = common_length(item, span)
            if k >= decontam.NEAR * n or (k >= decontam.LOOSE * n and any((span[j : j + len(answer)] == answer).all() for j in range(len(span) - len(answer) + 1))):
                found.add((d, i))
    return found


def bags(docs: list) -> list[Counter]:
    out = []
    for d in docs:
        h = words(pa.array([d["text"] or ""], pa.large_string()), MARKS)[1].tolist()
        out.append(Counter(zip(*(h[k:] for k in range(5)), strict=False)) if len(h) >= 5 else Counter([tuple(h)]))
    return out


def exact_links(docs: list) -> set[tuple[int, int]]:
    """Pairs of different texts of similarity 0.8 or more: of each bag the rarest fifth and a little more is looked up, as similar bags share one of those."""
    held, names = [], {}
    for d, b in zip(docs, bags(docs), strict=True):
        if d["text"] and d["text"] not in names and sum(b.values()) > 0:
            names[d["text"]] = len(held)
            held.append(b)
    df = Counter(x for b in held for x in b)
    index, found = defaultdict(list), set()
    for i, b in enumerate(held):
        size = sum(b.values())
        order, taken, seen = sorted(b, key=lambda x: (df[x], x)), 0, set()
        for x in order:
            if taken > 0.2 * size + 1:
                break
            taken += b[x]
            for j in index[x]:
                if j not in seen:
                    seen.add(j)
                    other = held[j]
                    both = sum(min(n, other[y]) for y, n in b.items() if y in other)
                    if both >= 0.8 * (size + sum(other.values()) - both):
                        found.add((j, i))
            index[x].append(i)
    texts = list(names)
    return {(texts[a], texts[b]) for a, b in found}


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs_, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs_.select("doc_id", "text", "lang", "source").collect()
    space = decontam.fit(docs_)
    listed = bench.select("item_id", "text").collect()
    items = decontam.Items([r["item_id"] for r in listed], [r["text"] for r in listed], space)
    want = {(docs[d]["doc_id"], items.ids[i]) for d, i in exact_leaks(docs, items)}
    found = decontam.search(docs_.select("doc_id", "text"), bench, space).select("doc_id", "leaks").where("size(leaks) > 0").collect()
    got = {(r["doc_id"], x["item_id"]) for r in found for x in r["leaks"]}
    print(f"decontamination: {len(want & got)} of {len(want)}, {len(got - want)} besides")
    by, size = {d["doc_id"]: d for d in docs}, dict(zip(items.ids, items.sizes.tolist(), strict=True))
    for name, of in (("words of the item", lambda d, i: size[i] // 8 * 8), ("lang", lambda d, i: str(by[d]["lang"])), ("source", lambda d, i: str(by[d]["source"]))):
        all_, hit = Counter(of(*x) for x in want), Counter(of(*x) for x in want & got)
        print(name, ", ".join(f"{k}: {hit[k]}/{n}" for k, n in sorted(all_.items())))
    links = exact_links(docs)
    of = {r["doc_id"]: r["class_id"] for r in neardup.assign(docs_.select("doc_id", "text")).collect()}
    first = {}
    for d in docs:
        first.setdefault(d["text"], d["doc_id"])
    kept = sum(of[first[a]] == of[first[b]] for a, b in links)
    print(f"near duplicates: {kept} of {len(links)} links between different texts")
    some = random.Random(1).sample(sorted(of), min(3, len(of)))
    print("classes of some:", {d: of[d] for d in some})


if __name__ == "__main__":
    main(sys.argv[1])
