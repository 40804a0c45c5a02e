"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus are TF-IDF vectors over hashed terms. One distributed pass
multiplies the passages' matrix A, transposed and plain, with a random matrix W: each
task sums A'(A W) over its passages, the sums of all tasks are added up in steps, and
the driver gets one terms x rank matrix, from which the randomised (Nystrom) form of
the decomposition gives the leading right singular vectors of A. Document frequencies
come from all passages, too.

In the search an inverted index of the items' rarest words says which windows of a
text are to be compared with which item: a window is as long as its item, whatever
that length, and lies so that the rare word stands where the item has it. Windows
whose cosine with the item in the space of the singular vectors reaches the bound are
candidates. Their longest common subsequence with the item, in a span of twice the
item's length, decides: NEAR of the item's words, or LOOSE of them if the item's answer
(its last sentence) stands there word for word. A candidate whose bag of words can't
reach that is passed over first. A document goes by its own words: no shuffle, no pair
tables.

The index loses nothing that the last step would keep. NEAR leaves out a fifth of an
item's words at most, so that of its rarest words, as many as fill a little more than a
fifth of it, one is there; LOOSE asks for the whole answer, so its rarest word is there.

Items go to the executors in blocks of ITEM_WORDS words (about 60 bytes each); a
benchmark beyond one block is searched for in further passes.

Defined results: null or empty text matches nothing; items without words match
nothing, items of fewer than SHORT words only as a whole; a window ends where its text
ends; repeated rows and items each count; empty tables give empty results; texts are
read whole; input columns pass through, whatever their names, and none is looked at
but text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.llm.store import free_name, table
from stratamill.llm.words import MARKS, kept, lowered, pieces, words

#: Hashed terms; leading singular vectors passed over (what all passages of a language have in common), vectors kept, columns drawn beyond them.
TERMS, COMMON, RANK, EXTRA = 1 << 15, 4, 40, 4
#: Words of a passage when frequencies and singular vectors are learnt.
PASSAGE = 32
COSINE = 0.2
NEAR, LOOSE = 0.8, 0.5
SHORT = 8
#: Words of the items that are searched for at once.
ITEM_WORDS = 1 << 20
#: Windows of an item that start within an eighth of its length of each other are one.
GRID = 8
#: Words that are looked at together.
TOGETHER = 1 << 17
#: Terms summed together, and partial sums added in the first step.
PART, FIRST = 512, 64

_U = np.uint64


def term(h: np.ndarray, terms: int) -> np.ndarray:
    """terms: 2**16 at most."""
    return (h >> _U(20)).astype(np.int64) % terms


def _passages(row: np.ndarray, size: int) -> np.ndarray:
    """Number of the passage of each word: every text is cut each `size` words."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    length = np.diff(np.append(first, len(row)))
    rank = np.arange(len(row)) - np.repeat(first, length)
    return np.cumsum((rank % size == 0)) - 1


def _frequencies(terms: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("decontam", None, lambda: None)
        df, total = np.zeros(terms, np.int64), 0
        for batch in pieces(batches):
            row, h, *_ = words(lowered(batch.column("text")), MARKS)
            if len(row):
                p = _passages(row, size)
                total += int(p[-1]) + 1
                t = term(h, terms)
                order = np.argsort(t.astype(np.uint16), kind="stable")
                t, p = t[order], p[order]
                df += np.bincount(t[(np.diff(t, prepend=-1) != 0) | (np.diff(p, prepend=-1) != 0)], minlength=terms)
        at = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(np.append(at, -1)), "n": pa.array(np.append(df[at], total))})

    return run


def row_sums(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of the table's rows at[i] for each i, column by column, which is much faster than reduceat."""
    out = table[at[:, 0]]
    for j in range(1, at.shape[1]):
        out += table[at[:, j]]
    return out


def add_by_term(total: np.ndarray, t: np.ndarray, y: np.ndarray, p: np.ndarray) -> None:
    """total[t] += y[p] for words with term t in passage p: frequent terms one by one, all others an occurrence a round."""
    order = np.argsort(t.astype(np.uint16), kind="stable")
    ts, p = t[order], p[order]
    begin = np.flatnonzero(np.diff(ts, prepend=-1))
    count = np.diff(np.append(begin, len(ts)))
    often = count > 16
    for k, a, n in zip(ts[begin[often]].tolist(), begin[often].tolist(), count[often].tolist(), strict=True):
        total[k] += y[p[a : a + n]].sum(0)
    begin, count = begin[~often], count[~often]
    while len(begin):
        total[ts[begin]] += y[p[begin]]
        more = count > 1
        begin, count = begin[more] + 1, count[more] - 1


def _products(shared, terms: int, size: int):
    """A'(A W) over a task's passages, in parts of PART terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf, drawn = shared.value
        drawn = np.vstack([drawn * idf[:, None], np.zeros((1, drawn.shape[1]), np.float32)])
        squares = np.append(idf**2, np.float32(0))[:, None]
        total = np.zeros((terms, drawn.shape[1]), np.float32)
        for batch in pieces(batches, 1 << 20):
            row, h, *_ = words(lowered(batch.column("text")), MARKS)
            if not len(row):
                continue
            p, t = _passages(row, size), term(h, terms)
            first = np.flatnonzero(np.diff(p, prepend=-1))
            padded = np.full((len(first), size), terms)
            padded[p, np.arange(len(t)) - first[p]] = t
            # passages are scaled to the length that they'd have without repeated words
            y = row_sums(drawn, padded) / np.maximum(row_sums(squares, padded), 1e-12)
            add_by_term(total, t, y, p)
        total *= idf[:, None]
        task = TaskContext.get().partitionId()
        for i in range(0, terms, PART):
            yield pa.record_batch({"part": pa.array([i // PART], pa.int32()), "task": pa.array([task], pa.int32()), "z": pa.array([total[i : i + PART].tobytes()], pa.binary())})

    return run


def _add(group: pa.Table) -> pa.Table:
    z = np.zeros(len(group["z"][0].as_py()) // 4, np.float32)
    for chunk in group["z"].chunks:
        for x in chunk:
            z += np.frombuffer(x.as_buffer(), np.float32)
    return pa.table({"part": group["part"].slice(0, 1), "task": pa.array([group["task"][0].as_py() // FIRST], pa.int32()), "z": pa.array([z.tobytes()], pa.binary())})


@dataclass
class Space:
    """idf by term; basis: terms x rank right singular vectors; singular: their values."""

    idf: np.ndarray
    basis: np.ndarray
    singular: np.ndarray

    def table(self) -> np.ndarray:
        """What one occurrence of each term adds to a passage's coordinates (those of U in A = U S V'), and a row of zeros."""
        rows = self.idf[:, None] * self.basis / np.maximum(self.singular, 1e-9)
        return np.vstack([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)


def decompose(z: np.ndarray, drawn: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors of C and square roots of its eigenvalues, from z = C @ drawn."""
    shift = 1e-6 * max(float(np.linalg.norm(z)), 1e-30)
    z = z + shift * drawn
    inner = drawn.T @ z
    inner = (inner + inner.T) / 2
    values, vectors = np.linalg.eigh(inner)
    good = values > values.max() * 1e-10
    half = z @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, :rank], np.sqrt(np.maximum(s[:rank] ** 2 - shift, 0))


def fit(docs: DataFrame, terms: int = TERMS, rank: int = RANK, size: int = PASSAGE, skip: int = COMMON) -> Space:
    """Frequencies over all passages of docs (text), and singular vectors number skip to skip + rank over them, too."""
    width = skip + rank + EXTRA
    spark = docs.sparkSession
    text = docs.select("text")
    counts = text.mapInArrow(_frequencies(terms, size), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # terms + 1 rows at most
    df, n = np.zeros(terms), 0
    for t, k in zip(counts["term"], counts["n"], strict=True):
        if t < 0:
            n = int(k)
        else:
            df[int(t)] = k
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    drawn = np.random.default_rng(7).standard_normal((terms, width))
    shared = spark.sparkContext.broadcast((idf.astype(np.float32), drawn.astype(np.float32)))
    schema = "part int, task int, z binary"
    sums = text.mapInArrow(_products(shared, terms, size), schema)
    tasks = text.rdd.getNumPartitions()
    while tasks > 1:  # FIRST sums at a time, so that no group grows with the number of tasks
        sums = sums.groupBy("part", F.floor(F.col("task") / FIRST).cast("int").alias("_t")).applyInArrow(_add, schema)
        tasks = -(-tasks // FIRST)
    sums = sums.toPandas()  # terms x width numbers
    z = np.zeros((terms, width))
    for i, x in zip(sums["part"], sums["z"], strict=True):
        z[i * PART : (i + 1) * PART] = np.frombuffer(x, np.float32).reshape(-1, width)
    if not z.any():
        return Space(idf, np.zeros((terms, rank)), np.zeros(rank))
    basis, singular = decompose(z, drawn, skip + rank)
    return Space(idf, basis[:, skip:], singular[skip:])


# ---- Items -------------------------------------------------------------------


class Items:
    """A block of items, with an index of their rarest words and all that verification needs."""

    def __init__(self, ids: list, texts: list[str], space: Space):
        self.ids, self.words, self.answers = [], [], []
        for i, t in zip(ids, texts, strict=True):
            t = (t or "").lower()
            h = words(pa.array([t]), MARKS)[1]
            if len(h):
                sentences = [s for s in (words(pa.array([s]), MARKS)[1] for s in _sentences(t)) if len(s)]
                self.ids.append(i)
                self.words.append(h)
                self.answers.append(sentences[-1] if len(sentences) > 1 and len(sentences[-1]) >= 3 else h[-min(5, len(h)) :])
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, _U)
        table, kinds = space.table(), len(self.vocabulary)
        self.vectors = np.array([table[term(w, len(space.idf))].sum(0) for w in self.words]).reshape(len(self.words), table.shape[1])
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)
        codes = [np.searchsorted(self.vocabulary, w) for w in self.words]
        answers = [np.unique(np.searchsorted(self.vocabulary, a)) for a in self.answers]
        distinct = [np.unique(c) for c in codes]
        #: item x kinds + word, sorted, for all words of each item and for those of its answer
        self.holds, self.holds_answer = (np.concatenate([np.zeros(0, np.int64), *(k * kinds + c for k, c in enumerate(x))]) for x in (distinct, answers))
        self.distinct, self.distinct_answer = (np.array([len(c) for c in x], np.int64) for x in (distinct, answers))
        rarity = space.idf[term(self.vocabulary, len(space.idf))]
        entries = [_anchors(c, a, rarity, k) for k, (c, a) in enumerate(zip(codes, answers, strict=True))]
        word, item, place = np.concatenate([np.zeros((3, 0), np.int64), *entries], axis=1)
        order = np.lexsort((place, item, word))
        word, self.item, self.place = word[order], item[order], place[order]
        at = np.flatnonzero(np.diff(word, prepend=-1))
        #: the rare words' hashes, and where the entries of each begin
        self.anchors, self.begin = self.vocabulary[word[at]], np.append(at, len(word))


def _anchors(codes: np.ndarray, answer: np.ndarray, rarity: np.ndarray, item: int) -> np.ndarray:
    """(word, item, place) of the item's rarest words: without all of them no text can hold it."""
    kinds, times = np.unique(codes, return_counts=True)
    order = np.lexsort((kinds, -rarity[kinds]))
    missing = len(codes) - int(np.ceil(NEAR * len(codes) - 1e-9)) if len(codes) >= SHORT else 0
    enough = int(np.searchsorted(np.cumsum(times[order]), missing, "right")) + 1
    chosen = kinds[order[:enough]]
    if len(codes) >= SHORT:
        chosen = np.append(chosen, answer[np.argmax(rarity[answer])])
    place = np.flatnonzero(np.isin(codes, chosen))
    return np.stack([codes[place], np.full(len(place), item), place])


def _sentences(text: str) -> list[str]:
    for c in ".!?\n":
        text = text.replace(c, "\x00")
    return text.split("\x00")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = row & where.get(x, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _stands(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a stands word for word in b."""
    at = np.flatnonzero(b[: len(b) - len(a) + 1] == a[0]) if len(b) >= len(a) else ()
    return any((b[i : i + len(a)] == a).all() for i in at)


def verify(item: np.ndarray, answer: np.ndarray, span: np.ndarray) -> tuple[int, bool] | None:
    """(common words, answer stands) if the span holds the item."""
    if len(item) < SHORT:
        return (len(item), True) if _stands(item, span) else None
    n = common(item, span)
    if n < LOOSE * len(item):
        return None
    there = _stands(answer, span)
    return (n, there) if n >= NEAR * len(item) or there else None


def _flat(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): the places start, start + 1, ... of each stretch."""
    owner = np.repeat(np.arange(len(start)), length)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + start[owner]


def _chunks(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes add up to about `most`, or that hold one."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _windows(items: Items, h: np.ndarray, row: np.ndarray, first: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, start) of the windows in which a rare word of the item stands at its place; `text` is an index of first and stop."""
    at = np.minimum(np.searchsorted(items.anchors, h), len(items.anchors) - 1)
    hit = np.flatnonzero(items.anchors[at] == h)
    which = at[hit]
    count = items.begin[which + 1] - items.begin[which]
    text_of = np.searchsorted(first, hit, "right") - 1
    for part in _chunks(count, TOGETHER * 4):
        own, entry = _flat(items.begin[which[part]], count[part])
        k, text, place = items.item[entry], text_of[part][own], hit[part][own]
        size = items.sizes[k]
        long = stop[text] - first[text] >= np.where(size < SHORT, size, LOOSE * size)
        k, text, size = k[long], text[long], size[long]
        grid = np.maximum(1, size // GRID)
        cell = (place[long] - items.place[entry[long]] - first[text] + size) // grid
        if len(cell):
            key = (k * len(first) + text) * (int(cell.max()) + 1) + cell
            _, one = np.unique(key, return_index=True)
            yield text[one], k[one], cell[one] * grid[one] - size[one] + first[text[one]]


def cosines(table: np.ndarray, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of each stretch of terms with its vector. table has a last row of zeros."""
    out, size = np.zeros(len(lo)), hi - lo
    order = np.argsort(size, kind="stable")
    for part in _chunks(size[order], TOGETHER):
        at = order[part]
        if size[at].max() > 512:
            y = np.array([table[terms[a:b]].sum(0) for a, b in zip(lo[at], hi[at], strict=True)])
        else:
            place = lo[at][:, None] + np.arange(max(1, int(size[at].max())))
            y = row_sums(table, np.where(place < hi[at][:, None], terms[np.minimum(place, len(terms) - 1)], len(table) - 1))
        out[at] = (y * vectors[at]).sum(1) / np.maximum(np.linalg.norm(y, axis=1), 1e-12)
    return out


def _held(pairs: np.ndarray, asked: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """How many different ones of `asked`, by owner, are among the sorted pairs."""
    if not len(pairs):
        return np.zeros(count, np.int64)
    at = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
    ok = pairs[at] == asked
    return np.bincount(np.unique(owner[ok] * len(pairs) + at[ok]) // len(pairs), minlength=count)


def _possible(items: Items, h: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether the words of each span, in whatever order, are enough for its item."""
    out, kinds = np.zeros(len(k), bool), len(items.vocabulary)
    for part in _chunks(hi - lo, TOGETHER * 4):
        kp = k[part]
        own, place = _flat(lo[part], (hi - lo)[part])
        at = np.minimum(np.searchsorted(items.vocabulary, h[place]), kinds - 1)
        known = items.vocabulary[at] == h[place]
        asked, own = kp[own[known]] * kinds + at[known], own[known]
        size = items.sizes[kp]
        most = _held(items.holds, asked, own, len(kp)) + size - items.distinct[kp]
        answered = _held(items.holds_answer, asked, own, len(kp)) == items.distinct_answer[kp]
        out[part] = (most >= NEAR * size) | answered & (most >= LOOSE * size)
    return out


def find(table: np.ndarray, items: Items, terms: int, cosine: float, count: int, row: np.ndarray, h: np.ndarray) -> list[dict[int, tuple]]:
    """For each of `count` texts the items it holds: item -> (common words, answer stands, cosine)."""
    found: list[dict[int, tuple]] = [{} for _ in range(count)]
    if not len(row) or not len(items.words):
        return found
    first = np.flatnonzero(np.diff(row, prepend=-1))
    stop = np.append(first[1:], len(row))
    t = term(h, terms)
    for text, k, start in _windows(items, h, row, first, stop):
        size = items.sizes[k]
        lo, hi = np.clip(start, first[text], stop[text]), np.clip(start + size, first[text], stop[text])
        like = cosines(table, t, lo, hi, items.vectors[k])
        near = np.flatnonzero(like >= cosine)
        text, k, start, size, like = text[near], k[near], start[near], size[near], like[near]
        lo, hi = np.maximum(start - size // 2, first[text]), np.minimum(start + size + size // 2, stop[text])
        for j in np.flatnonzero(_possible(items, h, k, lo, hi)).tolist():
            i, held = int(k[j]), found[row[first[text[j]]]]
            if held.get(i, (0,))[0] == size[j]:
                continue
            got = verify(items.words[i], items.answers[i], h[lo[j] : hi[j]])
            if got and got[0] > held.get(i, (0,))[0]:
                held[i] = (*got, float(like[j]))
    return found


def _search(shared, terms: int, cosine: float, named: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, items = shared.value
        kind = pa.list_(pa.struct({"item_id": pa.int64(), "item_words": pa.int64(), "common": pa.int64(), "answer": pa.bool_(), "cosine": pa.float64()}))
        for batch in pieces(batches):
            row, h, *_ = words(lowered(batch.column("text")), MARKS)
            found = find(table, items, terms, cosine, batch.num_rows, row, h)
            lists = [[{"item_id": items.ids[i], "item_words": len(items.words[i]), "common": n, "answer": a, "cosine": c} for i, (n, a, c) in sorted(f.items())] for f in found]
            yield pa.record_batch([*batch.columns, pa.array(lists, kind)], names=[*batch.schema.names, named])

    return run


LEAKS = "array<struct<item_id:bigint,item_words:bigint,common:bigint,answer:boolean,cosine:double>>"


def search(docs: DataFrame, benchmark: DataFrame, space: Space, cosine: float = COSINE, block: int = ITEM_WORDS, out: str = "leaks") -> DataFrame:
    """docs (with a column text) and `out`: the items of benchmark (item_id, text) that each text holds. `out` replaces a column of its name."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() == out.lower()))
    spark, table_, held = docs.sparkSession, space.table(), []
    found = docs

    def one_block(ids, texts):
        nonlocal found
        shared = spark.sparkContext.broadcast((table_, Items(ids, texts, space)))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
        held.append(free_name(f"_leaks_{len(held)}", found.columns))
        found = found.mapInArrow(_search(shared, len(space.idf), cosine, held[-1]), f"{fields}, `{held[-1]}` {LEAKS}")

    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len((r["text"] or "").split())
        if size >= block:
            one_block(ids, texts)
            ids, texts, size = [], [], 0
    if ids or not held:
        one_block(ids, texts)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), F.concat(*(F.col(f"`{c}`") for c in held)).alias(out))


def op9_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = search(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), fit(docs))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item."""
    leaks = free_name("_leaks", docs.columns)
    found = search(docs, benchmark, fit(docs), out=leaks)
    return found.where(F.size(leaks) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
