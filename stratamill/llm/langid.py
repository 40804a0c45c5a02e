"""Language identification with segmentation-marginalised unigram models.

The pieces are those of a fixed public vocabulary. A language is a distribution over
them, and the probability of a word is the sum over all ways to cut it into pieces,
which the forward algorithm gives. A text's probability is the product over its
words; the prediction is the language with the largest posterior under equal priors.

Learning is expectation-maximisation from equal piece probabilities: forward-backward
over the distinct words of each language gives the expected number of times that
each piece is used. Texts to learn from are a bounded sample: about `per_language`
of each language, chosen by a hash of doc_id. The tables are pieces x languages.

Words are runs of letters and non-ASCII bytes, lower-cased, with a blank before
them that stands for the vocabulary's word mark; words and pieces have any length. Any
byte can stand alone. Sums of words over LONG bytes, and of those that a double can't
hold, are done in logarithms.

Columns pass through. Defined results: `und` with score 0 where text is null, empty or
without a letter, or where there was nothing to learn from; ties go to the smallest
language in code point order; a null doc_id is kept; repeated rows each get a row; an
empty table gives an empty result; texts are read whole; an input column with the name
of a result is replaced by the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm.store import free_name, stage, table
from stratamill.llm.words import MARKS, kept, pieces, words

UNKNOWN = "und"
PER_LANGUAGE = 2000
ROUNDS = 3
#: Each byte's factor, which keeps most words' products within doubles. Words with a sum below SMALL, and those longer than LONG bytes, are done in logarithms.
SCALE = 1000.0
SMALL, LONG = 1e-280, 64
#: Weight of the pooled distribution in each language's, in expected pieces.
POOLED = 50.0
#: Words whose probabilities a worker remembers.
REMEMBERED = 250_000
#: Bytes of words whose sums are made together; a longer word is alone.
TOGETHER = 1 << 15

LETTERS = MARKS.copy()
LETTERS[48:58] = True

_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15)
_CODE = (np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03)) ^ _U(0x8CB92BA72F3D8DD7)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces of more than one byte, sorted."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = {sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in plain if len(p) > 1)


class Pieces:
    """The vocabulary as hashes by length; piece 0 to 255 are the single bytes."""

    @classmethod
    def of(cls, path: str) -> "Pieces":
        return cls.made(read_pieces(path))

    @classmethod
    def made(cls, plain: list[bytes]) -> "Pieces":
        """A worker makes them of the names alone: the library that reads the file takes some 150 MB while it does."""
        return kept("langid", zlib.crc32(b"\0".join(plain)), lambda: cls(plain))

    def __init__(self, plain: list[bytes]):
        self.names = [bytes([b]) for b in range(256)] + plain
        self.size = len(self.names)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(plain, 256):
            h = 0
            for b in p:
                h = (h * int(_RADIX) + int(_CODE[b])) & (1 << 64) - 1
            by_length.setdefault(len(p), []).append((h, i))
        self.tables = {n: (np.array([h for h, _ in x], _U), np.array([i for _, i in x])) for n, x in ((n, sorted(x)) for n, x in by_length.items())}

    def ids(self, letters: np.ndarray, lengths: np.ndarray) -> dict[int, np.ndarray]:
        """For each length that pieces have the piece that begins at each place of each word; `size` where there is none."""
        count, width = letters.shape
        code, out, h = _CODE[letters], {}, np.zeros((count, width), _U)
        for n in range(1, min(max(self.tables, default=1), width) + 1):
            h = h[:, : width - n + 1] * _RADIX + code[:, n - 1 :]
            if n == 1:
                found = letters.astype(np.int64)
            elif n in self.tables:
                hashes, ids = self.tables[n]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                found = np.where(hashes[at] == h, ids[at], self.size)
            else:
                continue
            out[n] = np.where(np.arange(n, width + 1) <= lengths[:, None], found, self.size)
        return out


def _matrix(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in group])
    width = int(lengths.max())
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in group), np.uint8).reshape(len(group), width), lengths


def forward(ids: dict[int, np.ndarray], probability: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]; probability has a last row of zeros for no piece."""
    count, width = ids[1].shape
    alpha = np.zeros((count, width + 1, probability.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, width + 1):
        for n, found in ids.items():
            if n <= j:
                alpha[:, j] += alpha[:, j - n] * probability[found[:, j - n]]
    return alpha


def backward(ids: dict[int, np.ndarray], probability: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    count, width = ids[1].shape
    beta = np.zeros((count, width + 1, probability.shape[1]))
    beta[np.arange(count), lengths] = 1
    for j in range(width - 1, -1, -1):
        for n, found in ids.items():
            if n <= width - j:
                beta[:, j] += beta[:, j + n] * probability[found[:, j]]
    return beta


def log_forward(ids: dict[int, np.ndarray], logs: np.ndarray) -> np.ndarray:
    """ln alpha, from the logarithms of the factors."""
    count, width = ids[1].shape
    alpha = np.full((count, width + 1, logs.shape[1]), -np.inf)
    alpha[:, 0] = 0
    for j in range(1, width + 1):
        for n, found in ids.items():
            if n <= j:
                alpha[:, j] = np.logaddexp(alpha[:, j], alpha[:, j - n] + logs[found[:, j - n]])
    return alpha


def log_backward(ids: dict[int, np.ndarray], logs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    count, width = ids[1].shape
    beta = np.full((count, width + 1, logs.shape[1]), -np.inf)
    beta[np.arange(count), lengths] = 0
    for j in range(width - 1, -1, -1):
        for n, found in ids.items():
            if n <= width - j:
                beta[:, j] = np.logaddexp(beta[:, j], beta[:, j + n] + logs[found[:, j]])
    return beta


def _small(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words of which a sum, at any place up to their end, is too small for a double."""
    inside = np.arange(sums.shape[1]) <= lengths[:, None]
    return np.flatnonzero(((sums < SMALL).any(2) & inside).any(1))


def scaled(probability: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    lengths = np.array([len(p) for p in vocabulary.names])
    return np.vstack([probability * SCALE ** lengths[:, None], np.zeros((1, probability.shape[1]))])


def _groups(found: list[bytes]) -> Iterator[tuple[list[int], bool]]:
    """(words of about one length, whether they are long), by their numbers."""
    order = sorted(range(len(found)), key=lambda i: len(found[i]))
    a = 0
    while a < len(order):
        long = len(found[order[a]]) > LONG
        b = a + 1
        while b < len(order) and (b + 1 - a) * len(found[order[b]]) <= TOGETHER and (len(found[order[b]]) > LONG) == long:
            b += 1
        yield order[a:b], long
        a = b


def log_probability(found: list[bytes], factors: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """ln P(word) in each language, summed over all segmentations."""
    out = np.empty((len(found), factors.shape[1]))
    with np.errstate(divide="ignore"):
        logged = np.log(factors)
    for at, long in _groups(found):
        letters, lengths = _matrix([found[i] for i in at])
        ids = vocabulary.ids(letters, lengths)
        if long:
            small, logs = np.arange(len(at)), np.empty((len(at), factors.shape[1]))
        else:
            alpha = forward(ids, factors)
            small = _small(alpha, lengths)
            with np.errstate(divide="ignore"):
                logs = np.log(alpha[np.arange(len(at)), lengths])
        if len(small):
            logs[small] = log_forward({n: i[small] for n, i in ids.items()}, logged)[np.arange(len(small)), lengths[small]]
        out[at] = logs - lengths[:, None] * np.log(SCALE)
    return out


def expected(found: list[bytes], times: np.ndarray, factors: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Expected uses of each piece in `times` occurrences of the words; factors: one language."""
    out = np.zeros(vocabulary.size + 1)
    with np.errstate(divide="ignore"):
        logs = np.log(factors)
    for at, long in _groups(found):
        letters, lengths = _matrix([found[i] for i in at])
        ids, many = vocabulary.ids(letters, lengths), times[at].astype(float)
        if long:
            small = np.arange(len(at))
        else:
            alpha, beta = forward(ids, factors), backward(ids, factors, lengths)
            small = np.union1d(_small(alpha, lengths), _small(beta, lengths))
            alpha, beta = alpha[:, :, 0], beta[:, :, 0]
        if len(small):
            some = {n: i[small] for n, i in ids.items()}
            la, lb = log_forward(some, logs)[:, :, 0], log_backward(some, logs, lengths[small])[:, :, 0]
            whole = la[np.arange(len(small)), lengths[small]][:, None]
            for n, i in some.items():
                use = np.exp(la[:, : i.shape[1]] + logs[i, 0] + lb[:, n : n + i.shape[1]] - whole) * many[small, None]
                out += np.bincount(i.ravel(), use.ravel(), vocabulary.size + 1)
        if not long:
            alpha[small], many[small] = 1, 0
            each = many / alpha[np.arange(len(at)), lengths]
            for n, i in ids.items():
                use = alpha[:, : i.shape[1]] * factors[i, 0] * beta[:, n : n + i.shape[1]] * each[:, None]
                out += np.bincount(i.ravel(), use.ravel(), vocabulary.size + 1)
    return out[:-1]


def _spelled(word: bytes) -> bytes:
    return b" " + word.decode("utf-8", "replace").lower().encode()


# ---- Learning ----------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        langs = batch.column("lang").to_pylist()
        row, h, start, end, data = words(batch.column("text"), LETTERS)
        raw = data.tobytes()
        counts: dict[tuple[str, bytes], int] = {}
        names, code = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        key, first, n = np.unique(h ^ (code[row].astype(_U) * _RADIX), return_index=True, return_counts=True)
        for f, k in zip(first.tolist(), n.tolist(), strict=True):
            at = (str(names[code[row[f]]]), _spelled(raw[start[f] : end[f]]))
            counts[at] = counts.get(at, 0) + k
        yield pa.record_batch({"lang": pa.array([a for a, _ in counts], pa.string()), "word": pa.array([w for _, w in counts], pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, probability, plain = model.value
        vocabulary = Pieces.made(plain)
        factors = scaled(probability, vocabulary)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            found, times = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for k, language in enumerate(languages):
                at = np.flatnonzero(langs == language)
                if len(at):
                    use = expected([found[i] for i in at], times[at].astype(float), factors[:, k : k + 1], vocabulary)
                    ids = np.flatnonzero(use)
                    yield pa.record_batch({"k": pa.array(np.full(len(ids), k), pa.int64()), "piece": pa.array(ids, pa.int64()), "uses": pa.array(np.round(use[ids] * 2**20), pa.float64()).cast(pa.int64())})

    return run


def smoothed(uses: np.ndarray) -> np.ndarray:
    """Piece probabilities of each language: its expected uses with a share of the pooled ones."""
    pooled = uses.sum(1) + 1e-3 * (1 + uses.sum() / len(uses))
    pooled /= pooled.sum()
    return (uses + POOLED * pooled[:, None]) / (uses.sum(0) + POOLED)


class Model:
    def __init__(self, languages: list[str], probability: np.ndarray, plain: list[bytes]):
        self.languages, self.probability, self.plain = languages, probability, plain


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Learn from docs (doc_id, text, lang), of which null texts and languages are left out."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    docs = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(rows)
    plain = read_pieces(path)
    vocabulary = Pieces.made(plain)
    probability = np.full((vocabulary.size, len(languages)), 1 / vocabulary.size)
    if not languages:
        return Model([], probability, plain)
    rate = F.create_map(*(x for k, n in rows.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))))[F.col("lang")]
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30))
    counts = chosen.select("text", "lang").mapInArrow(_count_words, "lang string, word binary, n bigint")
    counts = stage(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid_words")
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((languages, probability, plain))
        found = counts.mapInArrow(_expect(model), "k bigint, piece bigint, uses bigint").groupBy("k", "piece").agg(F.sum("uses").alias("uses"))
        uses = np.zeros_like(probability)
        for r in found.toLocalIterator():  # pieces x languages rows at most
            uses[r["piece"], r["k"]] = r["uses"] / 2**20
        probability = smoothed(uses)
    return Model(languages, probability, plain)


# ---- Prediction --------------------------------------------------------------


def _predict(shared, lettered_as: str, names_of: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, probability, plain = shared.value
        vocabulary = Pieces.made(plain)
        factors = scaled(probability, vocabulary)
        known: dict[int, int] = {}
        values = np.zeros((1024, len(languages)))
        for batch in pieces(batches):
            row, h, start, end, data = words(batch.column("text"), LETTERS)
            total = np.zeros((batch.num_rows, len(languages)))
            if len(row):
                raw = data.tobytes()
                distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
                if len(known) + len(distinct) > REMEMBERED:
                    known.clear()
                keys = distinct.tolist()
                new = [i for i, k in enumerate(keys) if k not in known]
                if new:
                    each = log_probability([_spelled(raw[start[f] : end[f]]) for f in first[new].tolist()], factors, vocabulary)
                    if len(known) + len(new) > len(values):
                        values = np.vstack([values, np.zeros((len(known) + len(new), len(languages)))])
                    values[len(known) : len(known) + len(new)] = each
                    known.update(zip((keys[i] for i in new), range(len(known), len(known) + len(new)), strict=True))
                slots = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
                full = np.flatnonzero(np.diff(row, prepend=-1))
                total[row[full]] = np.add.reduceat(values[slots[at]], full)
            best = total.argmax(1)
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            lettered = batch.column(batch.schema.names.index(lettered_as)).to_numpy(zero_copy_only=False)
            pred = np.where(lettered, np.array(languages, object)[best], UNKNOWN)
            passed = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != lettered_as]
            names = [x for x in batch.schema.names if x != lettered_as]
            yield pa.record_batch([*passed, pa.array(pred.tolist(), pa.string()), pa.array(np.where(lettered, score, 0.0))], names=[*names, *names_of])

    return run


def predict(model: Model, docs: DataFrame, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs (with a column text) and two more columns, named pred and score."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (pred.lower(), score.lower())))
    if not model.languages:
        return docs.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.probability, model.plain))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    lettered = free_name("_lettered", docs.columns)
    return docs.withColumn(lettered, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(
        _predict(shared, lettered, (pred, score)), f"{fields}, `{pred}` string, `{score}` double"
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(model, docs.select("doc_id", "text"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
