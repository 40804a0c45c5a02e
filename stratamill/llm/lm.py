"""Language-model scores from a hierarchical Pitman-Yor model.

Three kinds of restaurants are stacked. A context restaurant holds the tokens that
follow one word, or one of the rarer words that end in the same two bytes, so that every
token has a context; a new table there is a customer of the word restaurant, which all
contexts share as their parent. A new table there draws its word from a spelling model, in which every
context of up to two bytes is a restaurant of its own: contexts that end alike share
the parent that is one byte shorter, and the root draws from all bytes equally.

A word has a context restaurant of its own if it makes up CONTEXT of all training
tokens. Every pair of a context and a word has a seat there, which `least` may raise to
pairs that occur more often; what a context loses by that goes to its parent, as new
tables do.

Seating is sampled by Gibbs sweeps. A step takes all customers of one dish out of a
restaurant and seats them again given all others: the number of their tables is drawn
from its conditional distribution, by generalised Stirling numbers for up to EXACT
customers and by their saddle-point ratios beyond that.
What the other dishes hold in sum is taken from the pass before, so that words are
sampled in parallel; a word's own tables in its parent move at once. A pass holds INNER
sweeps; after BURN_IN passes the seatings of SAMPLES passes are averaged. A dish with one
customer has one table in every seating: pairs and words that occur once are counted in
the totals of every pass, but only what occurs again is in the table that passes rewrite.

The model is a distributed table, a row for each word with the contexts it was seen
in. What the driver holds is bounded: 1 / CONTEXT contexts and ENDINGS, counts of three-byte
strings, totals, and of the words and pairs only the most frequent, at most FREQUENT
and PAIRS of them, which every executor keeps so that frequent tokens needn't be
joined. All other tokens are joined with the table by hash.

The probability of a word that was never learnt is that of a new table times that of
its spelling, so that the probabilities of all words there can be sum to one.

Tokens are words (runs without ASCII white space, A-Z as a-z) and one end per text;
the first word of a text stands after an end.

Defined results: null text is empty and consists of the end alone; a null doc_id
isn't held out; repeated rows each get a row; with nothing to learn from all scores
are 0; an empty table gives an empty result; texts are read whole; other input columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm.store import drop_stage, release, stage, table
from stratamill.llm.words import SPACES, buffers, give_back, mix64, pieces, words

#: Discount and strength of the context restaurants, the word restaurant and the spelling restaurants.
PAIR_D, PAIR_S = 0.75, 2.0
WORD_D, WORD_S = 0.6, 10.0
BYTE_D, BYTE_S = 0.5, 5.0
#: Passes, and sweeps in each.
BURN_IN, SAMPLES, INNER = 1, 3, 3
#: Share of all tokens that makes a word a context of its own, and how often a pair occurs that has a seat: all do.
CONTEXT, LEAST = 1 / 4096, 1
#: Words (24 bytes each) and pairs (16 bytes each) kept by every executor.
FREQUENT, PAIRS = 1 << 20, 1 << 20
#: Customers up to which Stirling numbers are exact, and tables up to which a longer queue's distribution isn't taken for a normal one.
EXACT, LISTED = 32, 128
#: Customers up to which weights are products of doubles: 16 factors of at most 1e18 fit.
PRODUCTS = 16
#: Even steps in which saddle-point ratios are looked up, and the ln x below which they are too steep for that.
EVEN, STEEP = 1 << 14, 0.02
#: Parts of all hashes, at least, tokens of a part on average, and pairs that a task puts together at once.
PARTS, PART_TOKENS, PAIRS_AT_ONCE = 1 << 10, 1 << 20, 1 << 18
#: Share of a queue that is seated in one step.
STEP = 1 / 16
#: The end of a text, as a word: no text holds white space inside a word.
END = b"\n"
#: Bytes that stand around a word in its spelling.
EDGE = 10
#: Endings of two bytes, and that of the end.
ENDINGS, END_ENDING = 1 << 16, EDGE << 8 | EDGE

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    return int(words(pa.array([word.decode("utf-8", "replace")]), np.zeros(256, bool))[1][0])


END_HASH = word_hash(END)


# ---- Seating -----------------------------------------------------------------


def seat(customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """Tables that `customers` of each dish take, seated one after another in blocks: where sampling begins.

    base: the parent's probability of the dish; others: tables of other dishes.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    seated = tables.copy()
    at = np.flatnonzero(customers > 1)
    while len(at):
        block = np.minimum(np.maximum(1, (seated[at] * STEP).astype(np.int64)), customers[at] - seated[at])
        new = (strength + discount * (others[at] + tables[at])) * base[at]
        chance = new / (new + seated[at] - discount * tables[at])
        tables[at] += rng.binomial(block, np.clip(chance, 0, 1))
        seated[at] += block
        at = at[seated[at] < customers[at]]
    return tables


def stirling(n: int, discount: float) -> np.ndarray:
    """ln of the generalised Stirling numbers S(c, t) for c, t up to n: the weight of all ways to seat c customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, n + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, n):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(c - discount * t, 0)) + out[c, 1:])
    return out


def saddle(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(ln x, ln f): S(c, t + 1) / S(c, t) is about f(c / t) / t.

    S(c, t) is c! / t! times the coefficient of z**c in f(z)**t, f(z) = (1 - (1 - z)**d) / d,
    and its saddle point z is where z f'(z) / f(z) = c / t.
    """
    z = np.concatenate([np.geomspace(1e-9, 0.5, 1000), 1 - np.geomspace(0.5, 1e-15, 3000)[1:]])
    f = -np.expm1(discount * np.log1p(-z)) / discount
    return np.log(z * (1 - z) ** (discount - 1) / f), np.log(f)


class Ways:
    """The generalised Stirling numbers of a discount: ln exact, and ratios by ln x."""

    def __init__(self, discount: float):
        self.exact = stirling(EXACT, discount)
        self.ln_x, self.ln_f = saddle(discount)
        self.per = EVEN / self.ln_x[-1]
        self.even = np.interp(np.arange(EVEN + 2) / self.per, self.ln_x, self.ln_f)

    def ratio(self, x: np.ndarray) -> np.ndarray:
        at = np.minimum(x * self.per, EVEN)
        k = at.astype(np.int32)
        low = self.even[k]
        out = low + (at - k) * (self.even[k + 1] - low)
        steep = np.flatnonzero(x < STEEP)
        if len(steep):
            out[steep] = np.interp(x[steep], self.ln_x, self.ln_f)
        return out


_ways: dict[float, Ways] = {}


def reseat(customers: np.ndarray, others: np.ndarray, parent, discount: float, strength: float, rng) -> np.ndarray:
    """Tables of each dish, drawn given all others.

    others: tables of other dishes; parent(i, at): for the dishes `at` the parent's
    probability of a table more when i (one number for each, or one for all) of
    theirs are there.
    """
    if discount not in _ways:
        _ways[discount] = Ways(discount)
    ways = _ways[discount]
    tables = np.minimum(customers, 1).astype(np.int64)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    if len(few):
        kind = customers[few].astype(np.uint8)
        few = few[np.argsort(kind, kind="stable")]
        size = np.bincount(kind)
        kinds = np.flatnonzero(size)
        for c, at in zip(kinds.tolist(), np.split(few, np.cumsum(size[kinds])[:-1]), strict=True):
            # weights of 1, 2, ... tables by that of one
            seated, w = others[at], np.ones((c, len(at)))
            exact = (ways.exact[c, 1 : c + 1] - ways.exact[c, 1])[:, None]
            for i in range(1, c):
                np.multiply(strength + discount * (seated + i), parent(i, at), out=w[i])
            if c <= PRODUCTS:
                tables[at] = 1 + _chosen(_running(np.multiply, w) * np.exp(exact), rng)
            else:
                tables[at] = 1 + _drawn(_running(np.add, np.log(w)) + exact, rng)
    many = np.flatnonzero(customers > EXACT)

    def rise(t, at):
        """ln of how much likelier t + 1 tables are than t."""
        x = np.maximum(np.log(customers[at] / (t + 0.5)), 0.0)
        return np.log((strength + discount * (others[at] + t)) * parent(t, at) / t) + ways.ratio(x)

    if len(many):
        # the most likely number, by halving: rise() falls with t
        low, high = np.ones(len(many)), customers[many].astype(float)
        while len(left := np.flatnonzero(high - low > 0.5)):
            t = (low[left] + high[left]) / 2
            up = rise(t, many[left]) > 0
            low[left[up]], high[left[~up]] = t[up], t[~up]
        wide = low > LISTED / 3
        at, t = many[wide], low[wide]
        if len(at):
            step = np.maximum(1.0, t / 20)
            slope = np.minimum((rise(t + step, at) - rise(t - step, at)) / (2 * step), -1e-12)
            tables[at] = np.clip(np.round(t + 0.5 + rng.standard_normal(len(at)) / np.sqrt(-slope)), 1, customers[at])
        by_mode = np.flatnonzero(~wide)
        by_mode = by_mode[np.argsort(low[by_mode], kind="stable")]
        for part in np.array_split(by_mode, max(1, len(by_mode) // 1024)):
            at = many[part]
            if len(at):
                # beyond three times the most likely number and some more, no weight is left that a double would hold
                longest = min(LISTED, int(3 * low[part[-1]]) + 32)
                steps = np.stack([np.zeros(len(at)), *(rise(float(t), at) for t in range(1, longest))])
                tables[at] = np.minimum(1 + _drawn(_running(np.add, steps), rng), customers[at])
    return tables


def _running(f, w: np.ndarray) -> np.ndarray:
    """f.accumulate(w), in place; by rows it is faster."""
    for i in range(1, len(w)):
        f(w[i], w[i - 1], out=w[i])
    return w


def _chosen(w: np.ndarray, rng) -> np.ndarray:
    """A row of each column, by their weights, which don't stay."""
    w = _running(np.add, w)
    return (rng.random(w.shape[1]) * w[-1] >= w[:-1]).sum(0)


def _drawn(w: np.ndarray, rng) -> np.ndarray:
    """A row of each column, by the logarithms of their weights."""
    return _chosen(np.exp(w - w.max(0)), rng)


class Spelling:
    """Restaurants of two-byte contexts, sharing one-byte parents, sharing the root: p[context row, byte]."""

    def __init__(self, counts: dict[int, int] | None = None, rng=None):
        self.root = np.full(256, 1 / 256)
        self.one = np.tile(self.root, (256, 1))
        self.rows, self.two = np.full(65536, -1, np.int32), np.zeros((0, 256))
        if counts:
            self._seat(counts, rng)

    def _seat(self, counts, rng):
        key = np.fromiter(counts, np.int64, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        two = self._level(key >> 8, key & 255, n, self.root[key & 255], 65536, rng)
        k1, n1 = self._up(key & 0xFFFF, two)
        one = self._level(k1 >> 8, k1 & 255, n1, self.root[k1 & 255], 256, rng)
        k0, n0 = self._up(k1 & 255, one)
        zero = self._level(np.zeros_like(k0), k0, n0, self.root[k0], 1, rng)
        self.root = self._predict(np.zeros_like(k0), k0, n0, zero, self.root[None], 1)[0]
        self.one = self._predict(k1 >> 8, k1 & 255, n1, one, np.tile(self.root, (256, 1)), 256)
        contexts = np.unique(key >> 8)
        self.rows[contexts] = np.arange(len(contexts))
        self.two = self._predict(self.rows[key >> 8], key & 255, n, two, self.one[contexts & 255], len(contexts))

    @staticmethod
    def _up(key, tables):
        """What a level's tables are to its parents: customers by key."""
        kinds, at = np.unique(key, return_inverse=True)
        return kinds, np.bincount(at, tables).astype(np.int64)

    @staticmethod
    def _level(context, byte, n, base, contexts, rng):
        """Seated one after another, then each again given the others."""
        tables = np.minimum(n, 1)
        tables = seat(n, base, np.bincount(context, tables, contexts)[context] - tables, BYTE_D, BYTE_S, rng)
        for _ in range(2):
            total = np.bincount(context, tables, contexts)
            tables = reseat(n, total[context] - tables, lambda i, at: base[at], BYTE_D, BYTE_S, rng)
        return tables

    @staticmethod
    def _predict(context, byte, n, tables, parent, contexts):
        customers, total = np.bincount(context, n, contexts), np.bincount(context, tables, contexts)
        p = (BYTE_S + BYTE_D * total)[:, None] * parent
        p[context, byte] += n - BYTE_D * tables
        return p / (BYTE_S + customers)[:, None]

    def log_p(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """ln probability of each word's spelling, its closing edge included."""
        context, byte, word = letters(data, start, end)
        row = self.rows[context]
        p = np.where(row >= 0, self.two[row, byte] if len(self.two) else 0.0, self.one[context & 255, byte])
        return np.bincount(word, np.log(p), len(start)).astype(float)


def letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, byte, word) of every letter of the words and of the edge after each."""
    n = end - start + 1
    word = np.repeat(np.arange(len(start)), n)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(start, n) + place
    safe = np.append(data, np.zeros(1, np.uint8))
    low = safe.copy()
    low[(safe >= 65) & (safe <= 90)] += 32
    byte = np.where(place == n[word] - 1, EDGE, low[np.minimum(at, len(data))]).astype(np.int64)
    last = np.where(place >= 1, low[at - 1], EDGE).astype(np.int64)
    before = np.where(place >= 2, low[at - 2], EDGE).astype(np.int64)
    return before << 8 | last, byte, word


# ---- Counting ----------------------------------------------------------------


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the first key, and where in it a row begins that differs from the one before in some key."""
    order = np.argsort(keys[0])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([(x := k[order])[1:] != x[:-1] for k in keys])
    return order, np.flatnonzero(new)


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each start to its end, A-Z as a-z."""
    at = np.append(0, np.cumsum(end - start))
    found = data[np.repeat(start - at[:-1], end - start) + np.arange(at[-1])]
    found = found + 32 * ((found >= 65) & (found <= 90)).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(found)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
    for batch in pieces(batches):
        row, h, start, end, data = words(batch.column("text"), SPACES)
        order, first = _runs(h)
        n, one = np.diff(np.append(first, len(order))), order[first]
        held.append((np.append(h[one], _U(END_HASH)), pa.concat_arrays([_cut(data, start[one], end[one]), pa.array([END], pa.binary())]), np.append(n, batch.num_rows)))
        if len(held) >= 32:
            yield _merged(held)
            held = []
    if held:
        yield _merged(held)


def _merged(held) -> pa.RecordBatch:
    key = np.concatenate([k for k, _, _ in held])
    n = np.concatenate([c for _, _, c in held])
    order, first = _runs(key)
    one = order[first]
    return pa.record_batch(
        {
            "h": pa.array(key[one].view(np.int64)),
            "word": pa.concat_arrays([ws for _, ws, _ in held]).take(pa.array(one)),
            "n": pa.array(np.add.reduceat(n[order], first).astype(np.int64)),
        }
    )


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of h as one row for each h."""
    left: list[pa.RecordBatch] = []
    for batch in _together(batches):
        batch = pa.Table.from_batches([*left, batch]).combine_chunks().to_batches()[0]
        h, n = batch.column("h").to_numpy(), batch.column("n").to_numpy()
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        made = pa.record_batch({"h": pa.array(h[first]), "word": batch.column("word").take(pa.array(first)), "n": pa.array(np.add.reduceat(n, first))})
        yield made.slice(0, len(first) - 1)
        left = [made.slice(len(first) - 1)]
    yield from left


def _seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of words (slot -1) and their pairs in the order of h, as one row for each word: SEATS."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, slot = batch.column("h").to_numpy(), batch.column("slot").to_numpy()
        if not ((h[1:] > h[:-1]) | ((h[1:] == h[:-1]) & (slot[1:] > slot[:-1]))).all():
            batch = batch.take(pa.array(np.lexsort((slot, h))))
        slot, n = batch.column("slot").to_numpy(), batch.column("n").to_numpy()
        of_word = slot < 0
        first, owner = np.flatnonzero(of_word), np.cumsum(of_word) - 1
        h, word = (batch.column(c).take(pa.array(first)) for c in ("h", "word"))

        def lists(there: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(owner[there], minlength=len(first)))).astype(np.int32))
            return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]

        again, once = ~of_word & (n > 1), ~of_word & (n == 1)
        k = int(again.sum())
        slots, ns, ts, a = lists(again, slot[again], n[again], np.ones(k, np.int64), np.zeros(k))
        tables, q = pa.array(np.ones(len(first), np.int64)), pa.array(np.zeros(len(first)))
        return pa.record_batch({"h": h, "word": word, "n": pa.array(n[first]), "tables": tables, "q": q, "slots": slots, "ns": ns, "ts": ts, "a": a, "once": lists(once, slot[once])[0]})

    left: list[pa.RecordBatch] = []
    for batch in _together(batches):
        batch = pa.Table.from_batches([*left, batch]).combine_chunks().to_batches()[0]
        h = batch.column("h").to_numpy()
        last = int(np.searchsorted(h, h[-1]))
        if last:
            yield made(batch.slice(0, last))
        left = [batch.slice(last)]
    for batch in left:
        yield made(batch)


def endings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last two bytes of each word, A-Z as a-z, as a number; a word of one byte has EDGE before it."""
    last = data[end - 1].astype(np.int64)
    before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], EDGE).astype(np.int64)
    last, before = (x + 32 * ((x >= 65) & (x <= 90)) for x in (last, before))
    return before << 8 | last


def in_order(row: np.ndarray, h: np.ndarray, ending: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, hash and ending of the token before, place of each word) of all tokens of `count` texts, their ends included."""
    token, kind = np.full(len(h) + count, _U(END_HASH)), np.full(len(h) + count, END_ENDING)
    place = np.arange(len(h)) + row
    token[place], kind[place] = h, ending
    rows = np.repeat(np.arange(count), np.bincount(row, minlength=count) + 1)
    return rows, token.view(np.int64), np.append(_U(END_HASH), token[:-1]).view(np.int64), np.append(END_ENDING, kind[:-1]), place


def _slots(contexts: np.ndarray, before: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """The number of each token's context: that of the word before, or else of its ending."""
    if not len(contexts):
        return ending
    at = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
    return np.where(contexts[at] == before, at, len(contexts) + ending)


def _summed(slot: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of each pair."""
    order, first = _runs(pair_key(h, slot), h, slot)
    one = order[first]
    return slot[one], h[one], np.add.reduceat(n[order], first)


def _count_pairs(shared, bits: int):
    """How often each word stands after each context: a row for each part of the hashes (their first bits) with all of a task's pairs there, so that Spark moves blocks and not pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def merged():
            slot, h, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            part = h >> (64 - bits)
            order = np.argsort((part + (1 << (bits - 1))).astype(np.uint16 if bits <= 16 else np.int64), kind="stable")
            part = part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            offsets = np.append(first, len(part))
            lists = {"hs": h[order], "slots": slot[order].astype(np.int32), "ns": n[order]}
            return pa.record_batch({"part": pa.array(part[first]), **{c: _bytes(offsets, x) for c, x in lists.items()}})

        for batch in pieces(batches):
            row, h, start, end, data = words(batch.column("text"), SPACES)
            _, token, before, ending, _ = in_order(row, h, endings(data, start, end), batch.num_rows)
            held.append(_summed(_slots(shared.value, before, ending), token, np.ones(len(token), np.int64)))
            if len(held) >= 32:
                yield merged()
        if held:
            yield merged()

    return run


def _in_parts(least: int):
    """Words (h, word, n) and blocks of pairs in the order of their parts, as rows in the order of h: words (slot -1), each before its pairs, which are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, blocks, size, folded, part = [], [], 0, 0, None

        def put_together() -> pa.RecordBatch:
            found = pa.Table.from_batches(kept).combine_chunks()
            found = found.take(pa.array(np.argsort(found.column("h").to_numpy())))
            own, data = found.column("h").to_numpy(), found.column("word").combine_chunks()
            slot, h, n = (np.concatenate(x) for x in zip(*blocks, strict=True))
            # a pair's key is its word's place and its slot: sorted, pairs follow their words
            shift = int(slot.max(initial=0) + 1).bit_length()
            key = np.append(np.arange(len(own)) << shift, Lookup(own)(h)[0].astype(np.int64) << shift | slot + 1)
            order, first = _runs(key)
            key, n = key[order[first]], np.add.reduceat(np.append(found.column("n").to_numpy(), n)[order], first)
            slot = (key & ((1 << shift) - 1)) - 1
            there = (slot < 0) | (n >= least)
            key, slot, n = key[there], slot[there], n[there]
            data, at = buffers(data)
            ends = np.append(0, np.cumsum(np.where(slot < 0, np.diff(at)[key >> shift], 0))).astype(np.int32)
            word = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(data[at[0] : at[-1]])])
            return pa.record_batch({"h": pa.array(own[key >> shift]), "word": word, "n": pa.array(n), "slot": pa.array(slot, pa.int32())})

        for batch in batches:
            parts = batch.column("part").to_numpy()
            bounds = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
            for first, last in zip(bounds, np.append(bounds[1:], len(parts)), strict=True):
                rows = batch.slice(first, last - first)
                if part != parts[first]:
                    if size >= PAIRS_AT_ONCE:
                        yield put_together()
                        kept, blocks, size, folded = [], [], 0, 0
                    part = parts[first]
                block = rows.column("hs").is_valid().to_numpy(zero_copy_only=False)
                if not block.all():
                    kept.append(rows.filter(pa.array(~block)).select(["h", "word", "n"]))
                if block.any():
                    blocks.append(tuple(_numbers(rows.column(c), kind) for c, kind in (("slots", np.int32), ("hs", np.int64), ("ns", np.int64))))
                    size += len(blocks[-1][0])
                if size >= max(4 * PAIRS_AT_ONCE, 2 * folded):  # a part has no more pairs than its words have contexts, but as many blocks as there are tasks
                    blocks = [_summed(*(np.concatenate(x) for x in zip(*blocks, strict=True)))]
                    size = folded = len(blocks[0][0])
        if kept:
            yield put_together()
        kept, blocks = [], []
        give_back()

    return run


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, at = buffers(col)
    return data, at[:-1], at[1:]


def _together(batches: Iterator[pa.RecordBatch], rows: int = 32_768) -> Iterator[pa.RecordBatch]:
    """The batches, some of them as one."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _numbers(col: pa.Array, kind: type) -> np.ndarray:
    """The numbers of lists, one list after another; lists may be packed as their bytes."""
    if pa.types.is_binary(col.type):
        data, at = buffers(col)
        return data[at[0] : at[-1]].copy().view(kind)
    return col.flatten().to_numpy().copy()


def _bytes(offsets: np.ndarray, x: np.ndarray) -> pa.Array:
    """Lists of numbers, packed as their bytes: Spark copies them whole."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


#: Lists of the words' table that are packed in its files, and what they hold.
PACKED = {"slots": np.int32, "ts": np.int64, "a": np.float64, "once": np.int32}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = {c: _bytes(Seats.spans(batch, c)[0], _numbers(batch.column(c), kind)) for c, kind in PACKED.items()}
        yield pa.record_batch([made.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)


class Seats:
    """A batch of the words' table as numpy arrays; `owner` says whose word each pair is."""

    def __init__(self, batch: pa.RecordBatch, means: bool = True):
        """Without means, q and a needn't be there."""
        self.h, self.n, self.tables = (batch.column(c).to_numpy().copy() for c in ("h", "n", "tables"))
        self.slots, self.ns, self.ts = (_numbers(batch.column(c), PACKED.get(c, np.int64)) for c in ("slots", "ns", "ts"))
        if means:
            self.q, self.a = batch.column("q").to_numpy().copy(), _numbers(batch.column("a"), np.float64)
        self.offsets, self.owner = self.spans(batch, "ns")

    @staticmethod
    def spans(batch: pa.RecordBatch, lists: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each row's list begins, and the row of each of their elements."""
        col = batch.column(lists)
        sizes = np.diff(buffers(col)[1]) // np.dtype(PACKED[lists]).itemsize if pa.types.is_binary(col.type) else col.value_lengths().to_numpy()
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return offsets, np.repeat(np.arange(batch.num_rows), np.diff(offsets))

    def of_pairs(self, x: np.ndarray) -> np.ndarray:
        """Sums over each word's pairs."""
        return np.bincount(self.owner, x, len(self.n))

    def customers(self) -> np.ndarray:
        """Customers of the word restaurant: tokens without a seat in a context, and the contexts' tables."""
        return (self.n - self.of_pairs(self.ns) + self.of_pairs(self.ts)).astype(np.int64)

    def list_of(self, x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets), pa.array(x))


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The three-byte strings in the words' spelling, and their sums by each of the weights of words."""
    context, byte, word = letters(data, start, end)
    used = np.flatnonzero(np.bincount(context, minlength=ENDINGS))
    row = np.zeros(ENDINGS, np.int64)
    row[used] = np.arange(len(used))
    at = row[context] << 8 | byte
    sums = [np.bincount(at, w[word], len(used) << 8) for w in weights]
    there = np.flatnonzero(np.add.reduce(sums))
    return used[there >> 8] << 8 | (there & 255), [x[there] for x in sums]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each three-byte string occurs in the spelling of the words at tables; tables (-1), customers (-2), and tables in each context (-3, -4, ...).

    uses: of what occurs more than once; fixed: of words that occur once, and of the pairs in `once`.
    """
    held = []
    for batch in _together(batches):
        x = Seats(batch, means=False)
        single = x.n == 1
        key, sums = _strings(*_flat(batch.column("word")), [np.where(single, 0, x.tables), np.where(single, x.tables, 0)])
        customers = x.customers()
        once = _numbers(batch.column("once"), np.int32) if "once" in batch.schema.names else np.zeros(0, np.int32)
        most = int(max(x.slots.max(initial=-1), once.max(initial=-1))) + 1
        inside = np.bincount(x.slots, x.ts, most), np.bincount(once, minlength=most)
        slot = np.flatnonzero(inside[0] + inside[1])
        of_words = ([x.tables[k].sum(), customers[k].sum()] for k in (~single, single))
        held.append([np.concatenate([key, [-1, -2], -3 - slot]), *(np.concatenate([s, w, i[slot]]) for s, w, i in zip(sums, of_words, inside, strict=True))])
    if held:
        key, uses, fixed = (np.concatenate(x) for x in zip(*held, strict=True))
        key, at = np.unique(key, return_inverse=True)
        yield pa.record_batch({"key": pa.array(key), **{c: pa.array(np.bincount(at, v).astype(np.int64)) for c, v in (("uses", uses), ("fixed", fixed))}})


def _pass(shared, number: int, weight: float):
    """INNER sweeps; each adds its discounted counts to q and a, if it's a sample (weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, tables, customers, in_context, context_n = shared.value
        for batch in _together(batches):
            x = Seats(batch)
            base = np.maximum(np.exp(spelling.log_p(*_flat(batch.column("word")))), 1e-300)
            # seeded by the words themselves, so that a lost task comes out the same
            rng = np.random.default_rng([number, int(np.bitwise_xor.reduce(x.h) & 0x7FFFFFFFFFFFFFFF)])
            old_ts, old_tables, old_own = x.ts.copy(), x.tables.copy(), x.customers()
            for _ in range(INNER):
                own = x.customers()
                # the parent of a word's pairs without the tables of the one that is taken out
                rest = own[x.owner] - x.ts
                kept = np.minimum(x.tables[x.owner], rest)
                top = rest - WORD_D * kept + (WORD_S + WORD_D * (tables - old_tables[x.owner] + kept)) * base[x.owner]
                low = WORD_S + customers - old_own[x.owner] + rest
                # the first customer of a dish that nobody else has opens a table in the parent
                opens = np.where(kept == 0, WORD_D * (1 - base[x.owner]), 0.0)
                x.ts = reseat(x.ns, in_context[x.slots] - old_ts, lambda i, at, top=top, low=low, opens=opens: (top[at] + i - opens[at] * np.minimum(i, 1)) / (low[at] + i), PAIR_D, PAIR_S, rng)
                x.tables = reseat(x.customers(), tables - old_tables, lambda i, at: base[at], WORD_D, WORD_S, rng)
                if weight:
                    own = x.customers()
                    x.q += weight / INNER * (own - WORD_D * x.tables) / (WORD_S + customers)
                    x.a += weight / INNER * (x.ns - PAIR_D * x.ts) / (PAIR_S + context_n[x.slots])
            made = {"q": pa.array(x.q), "tables": pa.array(x.tables), "ts": _bytes(x.offsets, x.ts), "a": _bytes(x.offsets, x.a)}
            yield pa.record_batch([made.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return run


def pair_key(h: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return mix64(h.view(_U) ^ mix64(slot.astype(_U) + _GOLD)).view(np.int64)


def _finished(shared):
    """p, the probability of each word in the word restaurant, and all its pairs, those that occur once among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, left, a_once = shared.value
        for batch in _together(batches):
            x = Seats(batch)
            p = np.maximum(x.q + left * np.exp(spelling.log_p(*_flat(batch.column("word")))), 1e-300)
            once = _numbers(batch.column("once"), np.int32)
            owner = np.append(x.owner, x.spans(batch, "once")[1])
            order = np.argsort(owner, kind="stable")
            lists = {"slots": np.append(x.slots, once), "ns": np.append(x.ns, np.ones(len(once), np.int64)), "a": np.append(x.a, a_once[once])}
            x.offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(x.n)))).astype(np.int32)
            yield pa.record_batch({"h": batch.column("h"), "n": batch.column("n"), "p": pa.array(p), **{c: x.list_of(v[order]) for c, v in lists.items()}})

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of words (h, slots, ns, a) by their keys."""
    for batch in batches:
        if batch.num_rows:
            slots, m, a = (batch.column(c).flatten() for c in ("slots", "ns", "a"))
            h = batch.column("h").to_numpy()[Seats.spans(batch, "slots")[1]]
            yield pa.record_batch({"key": pa.array(pair_key(h, slots.to_numpy())), "m": m, "a": a})


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each context gives its own words, as far as they occur again."""
    for batch in _together(batches):
        slot, a = _numbers(batch.column("slots"), np.int32), _numbers(batch.column("a"), np.float64)
        kinds, at = np.unique(slot, return_inverse=True)
        yield pa.record_batch({"slot": pa.array(kinds), "a": pa.array(np.bincount(at, a, len(kinds)))})


SEATS = "h bigint, word binary, n bigint, tables bigint, q double, slots binary, ns array<bigint>, ts binary, a binary, once binary"
WORDS = "h bigint, n bigint, p double, slots array<int>, ns array<bigint>, a array<double>"


class Model:
    """words: the table WORDS; contexts and what each leaves to its parent; new tables' share and spelling; unknown: probability of all words that aren't in the table; the totals N and V."""

    def __init__(self, words: DataFrame, contexts: np.ndarray, backed: np.ndarray, left: float, spelling: Spelling, unknown: float, tokens: int, types: int):
        self.words, self.contexts, self.backed, self.left, self.spelling = words, contexts, backed, left, spelling
        self.unknown, self.tokens, self.types = unknown, tokens, types


def fit(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, context: float = CONTEXT, least: int = LEAST) -> Model:
    """Learn from docs (text)."""
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_count, "h bigint, word binary, n bigint")
    held = stage(counted.repartition("h").sortWithinPartitions("h").mapInArrow(_distinct, "h bigint, word binary, n bigint"), "lm_words")
    tokens, types = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not tokens:
        return Model(spark.createDataFrame([], WORDS), np.zeros(0, np.int64), np.zeros(0), 1.0, Spelling(), 1.0, 0, 0)
    # 1 / context words at most
    often = held.where(F.col("n") >= F.lit(context * tokens)).select("h", "n").orderBy("h").toPandas()
    contexts, context_n = often["h"].to_numpy(np.int64), often["n"].to_numpy(np.int64)
    rare = held.where(F.col("n") < F.lit(context * tokens))
    tail = F.conv(F.hex(F.substring("word", -2, 2)), 16, 10).cast("int")
    ending = F.when(F.length("word") > 1, tail).otherwise(tail + (EDGE << 8))
    by_ending = np.zeros(ENDINGS, np.int64)
    for r in rare.groupBy(ending.alias("e")).agg(F.sum("n").alias("n")).toLocalIterator():  # ENDINGS at most
        by_ending[r["e"]] = r["n"]
    context_n = np.append(context_n, by_ending)
    bits = max(PARTS, tokens // PART_TOKENS).bit_length() - 1
    pairs = docs.select("text").mapInArrow(_count_pairs(spark.sparkContext.broadcast(contexts), bits), "part bigint, hs binary, slots binary, ns binary")
    rows = held.withColumn("part", F.shiftright("h", 64 - bits)).unionByName(pairs, allowMissingColumns=True)
    together = _in_parts(least)
    seats = stage(rows.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _packed(_seated(together(batches))), SEATS), "lm_seats")
    drop_stage(held)
    del held, counted, pairs, rare, rows
    release(spark)

    def sums(rows: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
        """The totals of what occurs again, and of what doesn't. At most 2**24 strings, in practice some ten thousand."""
        used = [c for c in ("h", "word", "n", "tables", "slots", "ns", "ts", "once") if c in rows.columns]
        found = rows.select(*used).mapInArrow(_totals, "key bigint, uses bigint, fixed bigint").groupBy("key").agg(F.sum("uses").alias("uses"), F.sum("fixed").alias("fixed")).orderBy("key")
        uses, fixed = {}, {}
        for r in found.toLocalIterator():
            if r["uses"]:
                uses[r["key"]] = r["uses"]
            if r["fixed"]:
                fixed[r["key"]] = r["fixed"]
        return uses, fixed

    uses, fixed = sums(seats)

    def totals(uses: dict[int, int], number: int):
        """(spelling, tables, customers, tables by context), what occurs once included."""
        every = dict(uses)
        for k, n in fixed.items():
            every[k] = every.get(k, 0) + n
        in_context = np.zeros(len(context_n), np.int64)
        for k, n in every.items():
            if k <= -3:
                in_context[-3 - k] = n
        strings = {k: every[k] for k in sorted(every) if k >= 0}
        return Spelling(strings, np.random.default_rng(number)), every[-1], every[-2], in_context

    state = totals(uses, 0)
    held, q_once = seats.where(F.col("n") > 1), 0.0
    for number in range(1, burn_in + samples + 1):
        weight = (number > burn_in) / samples
        q_once += weight * (1 - WORD_D) / (WORD_S + state[2])
        step = stage(held.mapInArrow(_pass(spark.sparkContext.broadcast((*state, context_n)), number, weight), SEATS), f"lm_pass_{number}")
        if number > 1:
            drop_stage(held)
        held, state = step, totals(sums(step.drop("once"))[0], number)
    a_once = (1 - PAIR_D) / (PAIR_S + context_n)
    spelling, backed = state[0], np.ones(len(context_n))
    for k, n in fixed.items():
        if k <= -3:
            backed[-3 - k] -= n * a_once[-3 - k]
    for r in held.select("slots", "a").mapInArrow(_given, "slot int, a double").groupBy("slot").agg(F.sum("a").alias("a")).collect():
        backed[r["slot"]] -= r["a"]
    left = 1 - (held.agg(F.coalesce(F.sum("q"), F.lit(0.0))).first()[0] + q_once * fixed.get(-1, 0))
    single = seats.where(F.col("n") == 1).withColumn("q", F.lit(q_once))
    done = stage(held.unionByName(single).mapInArrow(_finished(spark.sparkContext.broadcast((spelling, left, a_once))), WORDS), "lm_model")
    drop_stage(held)
    drop_stage(seats)
    del held, seats, single, step
    release(spark)
    learnt = done.agg(F.sum("p")).first()[0]
    return Model(done, contexts, backed, left, spelling, max(1 - learnt, 1e-12), tokens, types)


# ---- Scoring -----------------------------------------------------------------


def _level(n: Column) -> Column:
    return F.floor(F.log2(n) * 16)


def _bound(rows: DataFrame, most: int) -> int | None:
    """The lowest level of n above which no more than `most` rows stand; None if there is none."""
    steps = rows.groupBy(_level(F.col("n")).alias("level")).agg(F.count("*").alias("k")).orderBy(F.col("level").desc()).collect()  # some hundred rows
    bound, total = None, 0
    for s in steps:
        total += s["k"]
        if total > most:
            break
        bound = s["level"]
    return bound


class Frequent:
    """The most frequent words and pairs, sorted by hash, and whether they are all there are."""

    def __init__(self, model: Model, most: int = FREQUENT, most_pairs: int = PAIRS):
        words = model.words.select("h", "n", "p")
        never = F.lit(False)
        bound = _bound(words, most)
        is_word = never if bound is None else _level(F.col("n")) >= bound
        pairs = model.words.where(is_word).select("h", "slots", "ns", "a").mapInArrow(_pairs, "key bigint, m bigint, a double")
        pair_bound = _bound(model.words.where(is_word).select(F.explode("ns").alias("n")), most_pairs)
        is_pair = never if pair_bound is None else _level(F.col("m")) >= pair_bound
        top = words.where(is_word).toArrow().sort_by("h")
        self.h, self.n, self.p = (top.column(c).to_numpy() for c in ("h", "n", "p"))
        top = pairs.where(is_pair).select("key", "a").toArrow().sort_by("key")
        self.keys, self.a = top.column("key").to_numpy(), top.column("a").to_numpy()
        #: What must be joined: words by hash, and pairs of frequent words by key.
        rare = model.words.where(~is_word).select(F.col("h").alias("key"), "n", "p", "slots", "a")
        other = pairs.where(~is_pair).select("key", F.col("a").alias("p"))
        self.rest = rare.unionByName(other, allowMissingColumns=True)


#: The slot of rows that are joined by the key of a pair.
PAIR = -2


def _spelt(spelling: Spelling, left: float, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """log10 probability of words that weren't learnt."""
    return (np.log(max(left, 1e-300)) + spelling.log_p(data, start, end)) / np.log(10)


class Lookup:
    """Places of hashes among sorted ones, sought from where those with the same first bits begin."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, _U(64 - max(1, len(keys).bit_length()))
        self.first = np.searchsorted(self._high(keys), np.arange(1 << (64 - int(self.bits)), dtype=_U)).astype(np.int32)

    def _high(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(_U) ^ _U(1 << 63)) >> self.bits

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        last = len(self.keys) - 1
        if last < 0:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(self.first[self._high(keys)], last)
        left = np.flatnonzero(self.keys[at] < keys)
        while len(left):
            at[left] += 1
            left = left[at[left] <= last]
            left = left[self.keys[at[left]] < keys[left]]
        at = np.minimum(at, last)
        return at, self.keys[at] == keys


def _tokens(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (top, top_n, top_p, pair_keys, pair_a), (contexts, backed), (spelling, left), denominator = shared.value
        top, pair_keys = Lookup(top), Lookup(pair_keys)
        counted = np.log10((top_n + 1) / denominator)
        for batch in pieces(batches):
            count = batch.num_rows
            row, h, start, end, data = words(batch.column("text"), SPACES)
            row, token, before, ending, place = in_order(row, h, endings(data, start, end), count)
            slot = _slots(contexts, before, ending)
            share = backed[slot] if len(backed) else np.ones(len(slot))
            at, hit = top(token)
            base = np.bincount(row[hit], counted[at[hit]], count)
            p = np.where(hit, share * (top_p[at] if len(top_p) else 0.0), 0.0)
            key = np.where(hit, pair_key(token, slot), token)
            pair, there = pair_keys(key)
            there &= hit
            p[there] += pair_a[pair[there]]
            own = np.bincount(row[there], np.log10(p[there]), count)
            names = batch.column("row")
            doc = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.bincount(row, minlength=count)), "n_known": pa.array(np.bincount(row[hit], minlength=count)), "base": pa.array(base.astype(float)), "own": pa.array(own.astype(float))}
            doc = pa.StructArray.from_arrays(list(doc.values()), list(doc))
            keys = mix64(names.to_numpy().astype(_U) + _GOLD).view(np.int64)
            none = np.zeros(count, np.int32)
            yield _looked_up(names, keys, none, none, pa.nulls(count, pa.float32()), pa.nulls(count, pa.float32()), doc)
            rest = np.flatnonzero(~there)
            if len(rest):  # one row for each text, context and word
                row, key, slot = row[rest], key[rest], slot[rest]
                order, first = _runs(mix64(key.view(_U) ^ mix64(row.astype(_U) << _U(32) | slot.astype(_U))), key, row, slot)
                one, times = order[first], np.diff(np.append(first, len(order)))
                by_row = np.argsort(one)
                one, times = one[by_row], times[by_row]
                row, key, slot, order = row[one], key[one], slot[one], rest[one]
                known = hit[order]
                strange = np.flatnonzero(~known)
                word = np.full(len(token), -1)
                word[place] = np.arange(len(place))
                spelt = word[order[strange]]  # an end isn't among them where anything was learnt
                _, one, back = np.unique(token[order[strange]], return_index=True, return_inverse=True)
                some = spelt[one]
                values = np.zeros(len(some))
                values[some >= 0] = _spelt(spelling, left, data, start[some[some >= 0]], end[some[some >= 0]])
                miss = np.zeros(len(order), np.float32)
                miss[strange] = np.log10(share[order[strange]]) + values[back]
                b = np.where(known, p[order], share[order]).astype(np.float32)
                yield _looked_up(names.take(pa.array(row)), key, times, np.where(known, PAIR, slot), pa.array(b), pa.array(miss, mask=known), pa.nulls(len(order), doc.type))

    return run


LOOKED_UP = "row bigint, key bigint, times int, slot int, b float, miss float, doc struct<doc_id: bigint, n_tokens: bigint, n_known: bigint, base: double, own: double>"


def _looked_up(row, key, times, slot, b, miss, doc) -> pa.RecordBatch:
    """Rows that are joined with the model by key: texts (doc, times is 0), words (miss: log10 of what they have if they weren't learnt) and pairs of frequent words (slot PAIR)."""
    return pa.record_batch({"row": row, "key": pa.array(key), "times": pa.array(times, pa.int32()), "slot": pa.array(slot, pa.int32()), "b": b, "miss": miss, "doc": doc})


def score(model: Model, docs: DataFrame, most: int = FREQUENT, most_pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    top = Frequent(model, most, most_pairs)
    denominator = float(model.tokens + model.types + 1)
    shared = spark.sparkContext.broadcast(((top.h, top.n, top.p, top.keys, top.a), (model.contexts, model.backed), (model.spelling, model.left), denominator))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    made = rows.mapInArrow(_tokens(shared), LOOKED_UP)
    found = made.join(top.rest, "key", "left")
    times, b, p = F.col("times"), F.col("b").cast("double"), F.col("p")
    is_pair = F.col("slot") == PAIR
    is_word = ~is_pair & (times > 0)
    of_pair = F.coalesce(F.expr("try_element_at(a, cast(nullif(array_position(slots, slot), 0) as int))"), F.lit(0.0))
    own = F.when(is_pair, F.log10(F.coalesce(p, F.lit(0.0)) + b)).when(p.isNull(), F.col("miss").cast("double")).otherwise(F.log10(of_pair + b * p)) if model.tokens else F.lit(0.0)
    return (
        found.groupBy("row")
        .agg(
            F.max("doc.doc_id").alias("doc_id"),
            F.sum("doc.n_tokens").alias("n_tokens"),
            (F.sum("doc.n_known") + F.sum(F.when(is_word & F.col("n").isNotNull(), times).otherwise(0))).alias("n_known"),
            (F.sum("doc.base") + F.sum(F.when(is_word, times * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(denominator))).otherwise(0.0))).alias("base_score"),
            (F.sum("doc.own") + F.sum(F.when(times > 0, times * own).otherwise(0.0))).alias("score"),
        )
        .drop("row")
    )


def perplexity() -> Column:
    """An aggregate over scored rows."""
    return F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op6_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = score(model, docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
