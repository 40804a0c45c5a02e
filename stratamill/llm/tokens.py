"""Token ids in binary blocks with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id and sorted inside each partition, so that
blocks follow each other in ascending doc_id order. A block is one row of a Parquet
file (any Hadoop store holds it, a rewritten task replaces it):

    part, seq   the block's place: range partition, then number in it
    nulls       rows without a doc_id, which come first
    doc_ids     int64 little-endian, the first value and then differences
    ids         all token ids, concatenated, little-endian unsigned 16 or 32 bit
    n_docs, n_tokens, low_bits
    low, high   Elias-Fano code of the documents' end offsets in `ids`

An Elias-Fano code keeps the low bits of each offset as they are and the high bits
in unary, about 2 + log2(tokens / documents) bits a document. select(i) finds the
i-th one bit of `high` from ranks of its stretches.

Defined results: null text is empty and gives the end id alone; repeated doc_ids
are kept next to each other, ordered by text; rows with null doc_id come first, and
are dealt out by the beginnings of their texts; empty tables give no blocks; other
input columns are not read. A text is encoded whole: it's cut only at ASCII white
space, which this tokenizer drops, and where its own rule always parts an ASCII letter,
digit or mark from the next, so each cut has the ids that it has in the whole text.
Whether a tokenizer does so is tried when it's loaded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamill.llm.store import stage, table
from stratamill.llm.words import SPACES, forget, give_back, kept, pieces, words

END = 1
#: A block is closed when it holds so many token ids.
BLOCK_TOKENS = 1 << 20
#: Words whose ids a worker remembers, some 50 bytes each; beyond that it starts anew.
REMEMBERED = 1_000_000
#: UTF-8 bytes of text in a partition.
PARTITION = 64 << 20
#: Characters of a text by which rows without a doc_id, or with the same one, are dealt to partitions.
PREFIX = 32
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Bytes that are parted from their neighbours: letters (1) and marks (3) from those of another kind, digits (2) from each other, too. An apostrophe may begin a unit with letters in it, and a bar stands in special tokens.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = [1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 0 if chr(c) in "'|" else 3 for c in range(33, 127)]
#: What is tried when a tokenizer is loaded.
_TRIED = "ab,c12d. X-y(z)=1/2!? e.g. a_b#c@d ~x^ {q}[r] 3rd \"Oh\" don't"
#: Documents whose ends are looked up at once.
ASKED = 1 << 14

BLOCK = "part int, seq int, n_docs bigint, n_tokens bigint, width int, low_bits int, doc_ids binary, nulls bigint, ids binary, low binary, high binary"


# ---- Elias-Fano --------------------------------------------------------------


def encode_bounds(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """(low_bits, low, high) of non-decreasing offsets."""
    n, most = len(ends), int(ends[-1]) if len(ends) else 0
    bits = max(0, (most // max(n, 1)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    low = ((ends[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    unary = np.zeros((most >> bits) + n + 1, np.uint8)
    unary[(ends >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
    return bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes()


#: The bit of a byte's k-th one.
_ONE = np.array([[next((b for b in range(8) if (v & (1 << b) - 1).bit_count() == k and v >> b & 1), 0) for k in range(8)] for v in range(256)], np.uint8)


class Bounds:
    """select() over a code: the end offset of documents.

    Ranks are kept for each 512 bits of `high`, and for each 64 bits inside them as 16-bit
    numbers: 24 bytes for 64 of the code. What is between is counted in eight bytes.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.bits = n, low_bits
        self.high = np.frombuffer(high + b"\0" * (-len(high) % 64), np.uint8)
        self.low = np.frombuffer(low + b"\0", np.uint8)
        ones = np.bitwise_count(self.high.view("<u8")).reshape(-1, 8).astype(np.int64)
        self.rank = np.cumsum(ones.sum(1)) - ones.sum(1)
        self.inside = (np.cumsum(ones, 1) - ones).astype(np.uint16)

    def select(self, i) -> np.ndarray:
        """The end offsets of documents i."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        wide = np.searchsorted(self.rank, i, "right") - 1
        rest = i - self.rank[wide]
        word = (self.inside[wide] <= rest[:, None]).sum(1) - 1
        rest = rest - self.inside[wide, word]
        place = 8 * wide + word
        eight = self.high.reshape(-1, 8)[place]
        ones = np.bitwise_count(eight).astype(np.int64)
        before = np.cumsum(ones, 1) - ones
        byte = (before <= rest[:, None]).sum(1) - 1
        at = np.arange(len(i))
        bit = _ONE[eight[at, byte], rest - before[at, byte]]
        out = (8 * (8 * place + byte) + bit - i) << self.bits
        first = i * self.bits
        for k in range(self.bits):
            out |= (self.low[(first + k) >> 3].astype(np.int64) >> ((first + k) & 7) & 1) << k
        return out


# ---- Encoding ----------------------------------------------------------------

class Buffer:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.size = np.zeros(1 << 12, dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.size + len(x) > len(self.held):
            grown = np.zeros(max(2 * len(self.held), self.size + len(x)), self.held.dtype)
            grown[: self.size] = self.held[: self.size]
            self.held = grown
        self.held[self.size : self.size + len(x)] = x
        self.size += len(x)


def _places(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch, one after the other."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - begin, length)


def cuts(data: np.ndarray) -> np.ndarray:
    """Before which bytes (and after the last) a unit surely ends."""
    kind, out = _KIND[data], np.zeros(len(data) + 1, bool)
    out[1:-1] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    return out


class WordIds:
    """Token ids of the words met so far: in arrays, found by a hash and compared byte for byte."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        #: Ids that end a word, for vocabularies that mark them.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()
        self.drops_space = self._parted(_TRIED.split())
        raw = np.frombuffer(_TRIED.encode(), np.uint8)
        at = [0, *np.flatnonzero(cuts(raw)).tolist(), len(raw)]
        #: Whether units can be parted as cuts() does.
        self.parts = self.drops_space and self._parted([x for a, b in zip(at, at[1:], strict=False) for x in raw[a:b].tobytes().decode().split()])

    def _parted(self, found: list[str]) -> bool:
        return np.concatenate(self._encode(found)).tolist() == self._encode([_TRIED])[0].tolist()

    def forget(self) -> None:
        #: Sorted hashes and the words' numbers, in a large and a small level that is merged into it.
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.raw, self.raw_end = Buffer(np.uint8), Buffer(np.int64)
        self.ids, self.ids_end = Buffer(self.dtype), Buffer(np.int64)
        self.raw_end.add(np.zeros(1, np.int64))
        self.ids_end.add(np.zeros(1, np.int64))
        self.words = 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, found: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words of letters together, as the ids tell where one ends."""
        out: list = [None] * len(found)
        plain, other = [], []
        for i, w in enumerate(found):
            t = w.decode()
            (plain if _LETTERS.fullmatch(t) else other).append((i, t))
        for a in range(0, len(plain), 500):
            some = plain[a : a + 500]
            ids = self._encode([" ".join(t for _, t in some)])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                other += some
                continue
            begin = 0
            for (i, _), end in zip(some, ends.tolist(), strict=True):
                out[i] = ids[begin:end]
                begin = end
        for a in range(0, len(other), 4096):
            some = other[a : a + 4096]
            for (i, _), ids in zip(some, self._encode([t for _, t in some]), strict=True):
                out[i] = ids
        return out

    def _learn(self, hashes: np.ndarray, found: list[bytes]) -> np.ndarray:
        """Numbers of the words, which are new and whose hashes are sorted."""
        ids = self.encode(found)
        number = np.arange(self.words, self.words + len(found), dtype=np.int32)
        self.raw.add(np.frombuffer(b"".join(found), np.uint8))
        self.raw_end.add(self.raw_end.held[self.words] + np.cumsum([len(w) for w in found]))
        self.ids.add(np.concatenate(ids))
        self.ids_end.add(self.ids_end.held[self.words] + np.cumsum([len(x) for x in ids]))
        self.words += len(found)
        self.levels[1] = _merged(self.levels[1], (hashes, number))
        if len(self.levels[1][0]) > 1 << 16:
            self.levels = [_merged(*self.levels), (np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        return number

    def numbers(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray, most: int) -> np.ndarray:
        """Number of each word; the hashes are sorted and different."""
        if self.words + len(hashes) > most:
            self.forget()
        out = np.full(len(hashes), -1, np.int64)
        for level, number in self.levels:
            if len(level):
                at = np.minimum(np.searchsorted(level, hashes), len(level) - 1)
                out = np.where(level[at] == hashes, number[at], out)
        new = np.flatnonzero(out < 0)
        if len(new):
            raw = data.tobytes()
            out[new] = self._learn(hashes[new], [raw[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
        return out


def _merged(a: tuple, b: tuple) -> tuple:
    h, number = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(h, kind="stable")
    return h[order], number[order]


def encoder(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept("tokens", path, lambda: WordIds(path))


def encode_column(col: pa.Array, path: str, remembered: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each row) of a text column."""
    held = encoder(path)
    if not held.drops_space:
        raise ValueError(f"a tokenizer that keeps white space: {path}")
    row, h, start, end, data = words(col, SPACES, exact=True, cuts=cuts if held.parts else None)
    if not len(row):
        return np.zeros(0, held.dtype), np.zeros(len(col), np.int64)
    distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
    number = held.numbers(distinct, start[first], end[first], data, REMEMBERED if remembered is None else remembered)
    # every word against the remembered one of its hash
    own, length = number[at], end - start
    begin = held.raw_end.held[own]
    known = held.raw_end.held[own + 1] - begin
    same = known == length
    if same.all() and (data[_places(start, length)] == held.raw.held[_places(begin, length)]).all():
        begin = held.ids_end.held[own]
        n = held.ids_end.held[own + 1] - begin
        return held.ids.held[_places(begin, n)], np.bincount(row, n, len(col)).astype(np.int64)
    raw = data.tobytes()  # two words of one hash: this piece word by word
    every = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    kinds = sorted(set(every))
    ids = dict(zip(kinds, held.encode(kinds), strict=True))
    n = np.array([len(ids[w]) for w in every], np.int64)
    return np.concatenate([ids[w] for w in every]), np.bincount(row, n, len(col)).astype(np.int64)


def encode_texts(texts: list[bytes | None], path: str, remembered: int | None = None) -> tuple[list[bytes], np.dtype]:
    """Ids of each UTF-8 text as little-endian bytes."""
    ids, n = encode_column(pa.array(texts, pa.binary()), path, remembered)
    ends = np.cumsum(n)
    return [ids[a:b].tobytes() for a, b in zip(ends - n, ends, strict=True)], ids.dtype


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each row's ids."""
    out = np.full(len(ids) + len(lengths), end, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out, lengths + 1


def _blocks(path: str, end: int, block_tokens: int, remembered: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        docs, lengths, ids = [], [], []

        def closed():
            n, every = np.concatenate(lengths), np.concatenate(ids)
            bits, low, high = encode_bounds(np.cumsum(n))
            named = pa.chunked_array(docs).combine_chunks().drop_null().to_numpy(zero_copy_only=False)
            deltas = np.diff(named.astype("<i8"), prepend=0).astype("<i8").tobytes()
            row = (part, seq, len(n), len(every), every.dtype.itemsize, bits, deltas, len(n) - len(named), every.tobytes(), low, high)
            names = [c.split()[0] for c in BLOCK.split(", ")]
            kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            return pa.record_batch([pa.array([v], kinds[c.split()[1]]) for v, c in zip(row, BLOCK.split(", "), strict=True)], names=names)

        for batch in pieces(batches):
            found, n = with_end(*encode_column(batch.column("text"), path, remembered), end)
            doc, taken, at = batch.column("doc_id"), 0, np.cumsum(n)
            # a block ends with the document that fills it
            while taken < len(n):
                held = sum(map(len, ids))
                before = int(at[taken - 1]) if taken else 0
                last = min(len(n), int(np.searchsorted(at, before + max(1, block_tokens - held))) + 1)
                docs.append(doc.slice(taken, last - taken))
                lengths.append(n[taken:last])
                ids.append(found[before : int(at[last - 1])])
                taken = last
                if held + len(ids[-1]) >= block_tokens:
                    yield closed()
                    docs, lengths, ids, seq = [], [], [], seq + 1
        if lengths:
            yield closed()

    return run


def encode(docs: DataFrame, path: str, end: int = END, block_tokens: int = BLOCK_TOKENS, partitions: int | None = None, remembered: int | None = None) -> DataFrame:
    """Blocks of docs (doc_id, text) in doc_id order, not yet written. There are as many partitions as the texts fill."""
    rows = docs.select("doc_id", "text")
    if partitions is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    dealt = rows.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, PREFIX).asc_nulls_first())
    return dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(_blocks(path, end, block_tokens, remembered), BLOCK)


def write(docs: DataFrame, path: str, out: str, **how) -> None:
    encode(docs, path, **how).write.parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks are taken one at a time; the tokenizer that wrote them isn't needed any more."""
    forget()
    for batch in batches:
        for i in range(batch.num_rows):
            b = {c: batch.column(c)[i] for c in batch.schema.names}
            ids = np.frombuffer(b.pop("ids").as_buffer(), f"<u{b['width'].as_py()}").astype("<u4")
            b = {c: v.as_py() for c, v in b.items()}
            bounds = Bounds(b["n_docs"], b["low_bits"], b["low"], b["high"])
            ends = np.concatenate([bounds.select(np.arange(i, min(i + ASKED, b["n_docs"]))) for i in range(0, b["n_docs"], ASKED)])
            starts = np.concatenate([[0], ends[:-1]])
            docs = [None] * b["nulls"] + np.cumsum(np.frombuffer(b["doc_ids"], "<i8")).tolist()
            yield pa.record_batch(
                {
                    "doc_id": pa.array(docs, pa.int64()),
                    "start": pa.array(starts + b["base"], pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[s:e]) for s, e in zip(starts, ends, strict=True)], pa.int64()),
                }
            )
    give_back()


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from written blocks.

    Running sums come in two steps, inside each partition's blocks and then over one
    row per partition. A block's offset is joined to it by its place.
    """
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    head = blocks.select("part", "seq", "n_tokens")
    parts = head.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_base"))
    own = head.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("own_base"))
    bases = stage(own.join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("own_base")).alias("base")), "token_bases")
    return blocks.join(bases, ["part", "seq"]).mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_ids(spark, sf_dir):
    return token_ids(table(spark, sf_dir, "documents"))


def token_ids(docs: DataFrame, **how) -> DataFrame:
    return read(stage(encode(docs, tokenizer_path(), **how), "token_blocks"))
