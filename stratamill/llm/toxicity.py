"""Toxicity by a bidirectional gated recurrent network over words and their characters.

A text's words, lower-cased, are read in windows of WINDOW words, each beginning half
a window after the one before it; the last one ends with the text. A word's input is its
own vector and the sum of the vectors of its character n-grams, with its edges; what
too few texts of the sample hold has no vector, and adds nothing. A recurrent layer runs
over a window in each direction, attention pools the states, and a text's score is that
of its worst window.

Everything is trained in numpy, by backpropagation through time with Adam, in one task,
on a bounded sample of labelled rows: about PER_LABEL texts of each label, of at most LONGEST
characters, chosen by a hash of doc_id. As a text is as toxic as its worst window,
gradients go through that window of each text; the output is corrected for the share of
labels in the sample. The weights are small and are broadcast; texts are scored in
tasks, where a word's share of the gates is computed once for all its places.

Columns pass through. Defined results: a text that is null, empty or without a word
scores as one empty window; with nothing to learn from, or one label only, the score
is the share of that label (0 without labels); null labels and texts aren't learnt from;
a null doc_id is kept; repeated rows get a row each; an empty table gives an empty result;
texts are read whole; an input column with the name of a result is replaced by the result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm.store import free_name, table
from stratamill.llm.words import MARKS, kept, mix64, pieces, words

PER_LABEL, LONGEST = {0: 4000, 1: 2000}, 20_000
WINDOW, STEP = 32, 16
#: Numbers of a vector, of a direction's state and of the attention's layer.
VECTOR, STATE, ATTEND = 12, 12, 8
GRAMS = (3, 4, 5)
#: Texts of the sample that have to hold a word, and words of texts that have to hold an n-gram.
LEAST_WORD, LEAST_GRAM = 3, 5
STEPS, BATCH, RATE, DECAY = 400, 64, 0.01, 1e-5
#: Words whose gates a worker remembers, and windows that are worked on together.
REMEMBERED, TOGETHER = 100_000, 1 << 10

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


# ---- Inputs ------------------------------------------------------------------


def grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every character n-gram of the words, edges marked by a blank."""
    row, out = [], []
    at: dict[int, list[int]] = {}
    texts = [f" {w.decode('utf-8', 'replace').lower()} " for w in found]
    for i, t in enumerate(texts):
        at.setdefault(len(t), []).append(i)
    for length, rows in at.items():
        code = mix64(np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), np.uint32).astype(_U).reshape(len(rows), length) + _U(1))
        for n in GRAMS:
            if n <= length:
                h = np.zeros((len(rows), length - n + 1), _U)
                for k in range(n):
                    h = h * _ODD + code[:, k : length - n + 1 + k]
                out.append(mix64(h.ravel() + _U(n)))
                row.append(np.repeat(rows, length - n + 1))
    return (np.concatenate(row), np.concatenate(out)) if row else (np.zeros(0, np.int64), np.zeros(0, _U))


def places(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash is in the sorted ones; len(known) where it isn't."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


def windows(row: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows; row: each word's text, ascending. A text without words has one of no words."""
    n = np.bincount(row, minlength=count)
    begin = np.cumsum(n) - n
    many = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(count), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(k * STEP, np.maximum(n[text] - WINDOW, 0))
    return text, begin[text] + start, np.minimum(WINDOW, n[text])


# ---- The network -------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights by name; `word` and `gram` have a last row of zeros for what is unknown."""

    def __init__(self, word: np.ndarray, gram: np.ndarray, weights: dict[str, np.ndarray]):
        self.word, self.gram, self.w = word, gram, weights

    @classmethod
    def new(cls, word: np.ndarray, gram: np.ndarray, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {"word": np.zeros((len(word) + 1, VECTOR), np.float32), "gram": np.zeros((len(gram) + 1, VECTOR), np.float32)}
        for d in "fb":
            w |= {f"in_{d}": normal(2 * VECTOR, 3 * STATE), f"bias_{d}": np.zeros(3 * STATE, np.float32), f"hidden_{d}": normal(STATE, 3 * STATE)}
        w |= {"attend": normal(2 * STATE, ATTEND), "attend_bias": np.zeros(ATTEND, np.float32), "query": normal(ATTEND, 1)[:, 0], "out": normal(2 * STATE, 1)[:, 0], "out_bias": np.zeros(1, np.float32)}
        return cls(word, gram, w)

    def inputs(self, slot: np.ndarray, row: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Each word's input; gram: places of n-grams, row: their words."""
        summed = np.zeros((len(slot), VECTOR), np.float32)
        hit = gram < len(self.gram)
        if hit.any():
            row, gram = row[hit], gram[hit]
            order = np.argsort(row, kind="stable")
            row, gram = row[order], gram[order]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            summed[row[first]] = np.add.reduceat(self.w["gram"][gram], first)
        return np.hstack([self.w["word"][slot], summed])

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Each word's share of the gates of both directions, and a last row for no word."""
        one = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
        return np.hstack([one @ self.w[f"in_{d}"] + self.w[f"bias_{d}"] for d in "fb"])

    def states(self, g: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, window, STATE) of a direction over the gates' shares (time, window, 3 STATE)."""
        u, T = self.w[f"hidden_{d}"], len(g)
        h = np.zeros((g.shape[1], STATE), np.float32)
        out, tape = np.empty((T, g.shape[1], STATE), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            p = h @ u
            zr = _sigmoid(g[t, :, : 2 * STATE] + p[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(g[t, :, 2 * STATE :] + r * p[:, 2 * STATE :])
            new = n + z * (h - n)
            m = mask[t][:, None]
            if keep:
                tape.append((t, h, z, r, n, p[:, 2 * STATE :], m))
            h = np.where(m, new, h)
            out[t] = h
        return out, tape

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; g: (time, window, 6 STATE), mask: (time, window)."""
        f, tape_f = self.states(g[:, :, : 3 * STATE], mask, "f", keep)
        b, tape_b = self.states(g[:, :, 3 * STATE :], mask, "b", keep)
        h = np.concatenate([f, b], 2)
        a = np.tanh(h @ self.w["attend"] + self.w["attend_bias"])
        e = np.where(mask, a @ self.w["query"], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        share = e / e.sum(0)
        pooled = (share[:, :, None] * h).sum(0)
        logit = pooled @ self.w["out"] + self.w["out_bias"][0]
        return (logit, (h, a, share, pooled, tape_f, tape_b)) if keep else logit

    def backward(self, mask: np.ndarray, kept_: tuple, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense weights, and of g."""
        h, a, share, pooled, tape_f, tape_b = kept_
        w, out = self.w, {}
        out["out"], out["out_bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * w["out"]
        d_share = (h * d_pooled).sum(2)
        d_e = share * (d_share - (share * d_share).sum(0))
        d_a = d_e[:, :, None] * w["query"] * (1 - a * a)
        out["query"] = (a * d_e[:, :, None]).sum((0, 1))
        out["attend"] = h.reshape(-1, 2 * STATE).T @ d_a.reshape(-1, ATTEND)
        out["attend_bias"] = d_a.sum((0, 1))
        d_h = share[:, :, None] * d_pooled + d_a @ w["attend"].T
        d_g = np.zeros((*mask.shape, 6 * STATE), np.float32)
        for d, tape, low in (("f", tape_f, 0), ("b", tape_b, STATE)):
            u, carry = w[f"hidden_{d}"], np.zeros((mask.shape[1], STATE), np.float32)
            d_u = np.zeros_like(u)
            for t, before, z, r, n, p, m in reversed(tape):
                total = carry + d_h[t, :, low : low + STATE]
                new = np.where(m, total, 0)
                d_n = new * (1 - z) * (1 - n * n)
                d_z = new * (before - n) * z * (1 - z)
                d_r = d_n * p * r * (1 - r)
                d_p = np.hstack([d_z, d_r, d_n * r])
                d_g[t, :, 3 * low : 3 * low + 3 * STATE] = np.hstack([d_z, d_r, d_n])
                d_u += before.T @ d_p
                carry = np.where(m, new * z + d_p @ u.T, total)
            out[f"hidden_{d}"] = d_u
        return out, d_g


class Adam:
    """Adam; rows of the two tables of vectors move only where they have a gradient."""

    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.step = w, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def move(self, grads: dict[str, np.ndarray], at: dict[str, np.ndarray]) -> None:
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            i = at.get(k, slice(None))
            g = g + DECAY * self.w[k][i]
            self.m[k][i] = 0.9 * self.m[k][i] + 0.1 * g
            self.v[k][i] = 0.999 * self.v[k][i] + 0.001 * g * g
            self.w[k][i] -= rate * self.m[k][i] / (np.sqrt(self.v[k][i]) + 1e-8)


def _summed(place: np.ndarray, g: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct places, sums of their rows of g), without the place `none`."""
    hit = place < none
    place, g = place[hit], g[hit]
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], (np.add.reduceat(g[order], first) if len(first) else g[:0])


class Corpus:
    """Texts as words' numbers, with each distinct word's vocabulary place and n-grams."""

    def __init__(self, texts: list[str]):
        row, h, start, end, data = words(pa.array(texts, pa.large_string()), MARKS)
        raw = data.tobytes()
        self.hashes, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.row, self.texts = row, len(texts)
        self.gram_row, self.gram_hash = grams([raw[start[f] : end[f]] for f in first.tolist()])
        order = np.argsort(self.gram_row, kind="stable")
        self.gram_row, self.gram_hash = self.gram_row[order], self.gram_hash[order]

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words that enough texts hold, and of n-grams that enough words of texts do."""
        many = max(self.texts, 1)
        held = np.bincount(np.unique(self.word * many + self.row) // many, minlength=len(self.hashes))
        names, gram = np.unique(self.gram_hash, return_inverse=True)
        return self.hashes[held >= LEAST_WORD], names[np.bincount(gram, held[self.gram_row], len(names)) >= LEAST_GRAM]


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    corpus = Corpus(texts)
    net = Network.new(*corpus.vocabulary(), seed=seed)
    slot, gram = places(net.word, corpus.hashes), places(net.gram, corpus.gram_hash)
    text, start, size = windows(corpus.row, corpus.texts)
    first = np.searchsorted(text, np.arange(corpus.texts + 1))
    none, rng = len(corpus.hashes), np.random.default_rng(seed)
    gram_first = np.searchsorted(corpus.gram_row, np.arange(none + 1))
    word = np.append(corpus.word, none)

    def laid(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, mask), time first, of windows."""
        k = np.arange(WINDOW)[:, None]
        mask = k < size[which]
        return word[np.where(mask, start[which] + k, len(word) - 1)], mask

    def shares(distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gates, inputs, n-gram's word, n-gram) of distinct words."""
        many = gram_first[distinct + 1] - gram_first[distinct]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, g = np.repeat(np.arange(len(distinct)), many), gram[np.repeat(gram_first[distinct], many) + inner]
        x = net.inputs(slot[distinct], row, g)
        return net.gates(x), x, row, g

    adam = Adam(net.w, RATE)
    while adam.step < steps:
        order = rng.permutation(corpus.texts)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            every = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
            laid_, mask = laid(every)
            distinct, inverse = np.unique(laid_[mask], return_inverse=True)
            local = np.full(laid_.shape, len(distinct))
            local[mask] = inverse
            g, x, row, gr = shares(distinct)
            logit = np.concatenate([net.forward(g[local[:, a : a + TOGETHER]], mask[:, a : a + TOGETHER]) for a in range(0, len(every), TOGETHER)])
            # The worst window of each text.
            owner = text[every]
            edge = np.flatnonzero(np.diff(owner, prepend=-1))
            top = np.maximum.reduceat(logit, edge)
            best = np.array([a + logit[a:b].argmax() for a, b in zip(edge, [*edge[1:], len(every)], strict=True)])
            local, mask = local[:, best], mask[:, best]
            _, tape = net.forward(g[local], mask, keep=True)
            d_logit = ((_sigmoid(top) - labels[owner[edge]]) / len(edge)).astype(np.float32)
            grads, d_g = net.backward(mask, tape, d_logit)
            per, d_share = _summed(local.ravel(), d_g.reshape(-1, 6 * STATE), len(distinct) + 1)
            d_all = np.zeros((len(distinct) + 1, 6 * STATE), np.float32)
            d_all[per] = d_share
            x1 = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
            d_x = np.zeros_like(x)
            for k, d in enumerate("fb"):
                part = d_all[:, 3 * k * STATE : 3 * (k + 1) * STATE]
                grads[f"in_{d}"], grads[f"bias_{d}"] = x1.T @ part, part.sum(0)
                d_x += part[:-1] @ net.w[f"in_{d}"].T
            moved = {}
            moved["word"], grads["word"] = _summed(slot[distinct], d_x[:, :VECTOR], len(net.word))
            live = np.zeros(len(distinct), bool)
            live[per[per < len(distinct)]] = True
            use = live[row]
            moved["gram"], grads["gram"] = _summed(gr[use], d_x[row[use], VECTOR:], len(net.gram))
            adam.rate = RATE * max(0.1, 1 - adam.step / steps)
            adam.move(grads, moved)
    return net


# ---- On Spark ----------------------------------------------------------------


class Model:
    """A network and what its logits are short of; without a network, one score for all."""

    def __init__(self, net: Network | None, shift: float = 0.0, share: float = 0.0):
        self.net, self.shift, self.share = net, shift, share


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("label").to_pylist()
    if texts:
        yield pa.record_batch([pa.array([pickle.dumps(train(texts, np.array(labels, np.float32)))], pa.binary())], names=["net"])


def fit(docs: DataFrame, labels: DataFrame, per_label: dict[int, int] | None = None) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, label 0 or 1)."""
    per_label = per_label or PER_LABEL
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(None, share=float(next(iter(counts), 0)))
    rates = {k: min(1.0, per_label[k] / n) for k, n in counts.items()}
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("label") == 1, rates[1]).otherwise(rates[0]) * (1 << 30))
    # About per_label rows of each label are chosen, so they can be sent to every executor.
    texts = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    found = texts.repartition(1).sortWithinPartitions("doc_id", "label", "text").mapInArrow(_train, "net binary").collect()
    if not found:
        return Model(None, share=counts[1] / sum(counts.values()))
    return Model(pickle.loads(found[0]["net"]), float(np.log(rates[0] / rates[1])))


class Scorer:
    """A worker's network, with the gates of words that it has met."""

    def __init__(self, model: Model):
        self.model, self.net = model, model.net
        self.known: dict[int, int] = {}
        self.gates = np.zeros((1024, 6 * STATE), np.float32)
        self.none = self.net.gates(np.zeros((0, 2 * VECTOR), np.float32))

    def slots(self, distinct: np.ndarray, spelled) -> np.ndarray:
        """Rows of gates of distinct words; spelled(i): the bytes of word i."""
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            row, h = grams([spelled(i) for i in new])
            x = self.net.inputs(places(self.net.word, distinct[new]), row, places(self.net.gram, h))
            n = len(self.known)
            if n + len(new) > len(self.gates):
                self.gates = np.vstack([self.gates, np.zeros((n + len(new), 6 * STATE), np.float32)])
            self.gates[n : n + len(new)] = self.net.gates(x)[:-1]
            self.known.update(zip((keys[i] for i in new), range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def score(self, texts: pa.Array) -> np.ndarray:
        row, h, start, end, data = words(texts, MARKS)
        raw = data.tobytes()
        distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
        place = self.slots(distinct, lambda i: raw[start[first[i]] : end[first[i]]])[at] if len(h) else np.zeros(1, np.int64)
        text, begin, size = windows(row, len(texts))
        out = np.full(len(texts), -np.inf, np.float32)
        for a in range(0, len(text), TOGETHER):
            some = slice(a, a + TOGETHER)
            k = np.arange(WINDOW)[:, None]
            mask = k < size[some]
            g = np.where(mask[:, :, None], self.gates[place[np.where(mask, begin[some] + k, 0)]], self.none)
            np.maximum.at(out, text[some], self.net.forward(g, mask))
        return _sigmoid(out.astype(float) + self.model.shift)


def _score(shared, passed: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        scorer = kept("toxicity", zlib.crc32(packed), lambda: Scorer(pickle.loads(packed)))
        for batch in pieces(batches):
            yield pa.record_batch([*(batch.column(c) for c in passed), pa.array(scorer.score(batch.column("text")))], names=[*passed, name])

    return run


def scored(model: Model, docs: DataFrame, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs (with a column text) and two more columns: a score from 0 to 1, and 1 where it is 0.5 or more."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (score.lower(), predicted.lower())))
    if model.net is None:
        out = docs.withColumn(score, F.lit(model.share))
    else:
        free = free_name("_score", docs.columns)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
        out = docs.mapInArrow(_score(shared, docs.columns, free), f"{fields}, `{free}` double").withColumnRenamed(free, score)
    return out.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op13_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    out = scored(fit(docs, labels.where(~held_out(F.col("doc_id")))), docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
