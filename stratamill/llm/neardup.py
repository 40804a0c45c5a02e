"""Near-duplicate documents by BagMinHash signatures.

A document is the multiset of its five-word shingles (words in lower case, without
ASCII punctuation); similarity is the weighted
Jaccard index, the sum of minima over the sum of maxima of the counts. A signature
register is the time of the first point that falls to it in Poisson processes, one
for each shingle and each dyadic range of count levels [0,1), [1,2), [2,4), [4,8) ...
A range that a count covers only in part is halved again and again, and the points
of a half are the same whatever the count, so that two documents agree in a register
with probability equal to their similarity. Points come in order of time, and those
past a bound, that no register can need, aren't made; a document whose registers
aren't all filled by then is done again with a larger bound.

Bands of rows of the signature are hashed to buckets. In a bucket the members are
compared with one of them, the star's centre, and not in all pairs; members that are
in the centre's class by then needn't be. A second round takes other centres, at
random, one for each bucket. What is left are members outside the main class of a
bucket: those are compared with all other members there that aren't in their class,
in a small bucket as pairs, in a large one in blocks of bounded size. So every link
between different texts that share a bucket, and that would join two classes, is found.
Exact copies are folded into one before all this. Similar pairs, verified on the
multisets, join documents into classes by repeated minimum-label propagation.

Defined results: null or empty text, and text without words, are equal to each other
and form one class; fewer than five words make one shingle of what there is; repeated
rows share a class; rows with null doc_id take part and a class made of nothing else
has a null class id; an empty table gives an empty result; texts are read whole;
other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm.store import free_name, stage, table
from stratamill.llm.words import MARKS, give_back, kept, lowered, mix64, pieces, words

SHINGLE = 5
THRESHOLD = 0.8
#: At 0.8 a pair shares no bucket with probability (1 - 0.8**5)**24, less than 1 in 10,000.
BANDS, ROWS = 24, 5
#: Rounds of stars before the rest is compared.
STARS = 2
#: Buckets up to this size compare their rest as pairs; larger ones in blocks of BLOCK by BLOCK members.
FEW, BLOCK = 64, 512
#: Shared shingles that a block counts at once.
PAIRS = 1 << 20
#: Members that one copy of a star's centre is compared with.
SALT = 64
#: A candidate table up to this size is sent to every executor; a larger one is joined by shuffle.
SMALL = 32 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingles(col: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), sorted by row and hash."""
    row, h, *_ = words(lowered(col), MARKS)
    if not len(row):
        return row, h, row
    first = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(first, len(row)))
    rank = np.arange(len(row)) - np.repeat(first, size)
    left = np.repeat(size, size) - rank
    out, held = np.zeros(len(row), _U), np.ones(len(row), bool)
    for j in range(k):
        inside = left > j
        out[inside] = mix64(out[inside] * _STEP + h[np.flatnonzero(inside) + j] + _U(j + 1))
    held &= (left >= k) | (rank == 0)
    row, out = row[held], out[held]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | np.append(True, out[1:] != out[:-1]))
    return row[new], out[new], np.diff(np.append(new, len(row)))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _ranges(row, shingle, count):
    """Dyadic level ranges that begin below each count: (row, seed, low, width, count)."""
    rows, seeds, lows, widths, counts = [row], [mix64(shingle + _STEP)], [np.zeros_like(count)], [np.ones_like(count)], [count]
    j = 0
    while True:
        at = np.flatnonzero(count > 1 << j)
        if not len(at):
            break
        rows.append(row[at])
        seeds.append(mix64(shingle[at] + _U(int(_STEP) * (j + 2) & (1 << 64) - 1)))
        lows.append(np.full(len(at), 1 << j))
        widths.append(np.full(len(at), 1 << j))
        counts.append(count[at])
        j += 1
    return [np.concatenate(x) for x in (rows, seeds, lows, widths, counts)]


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash registers (n x m, as the 64-bit identity of each register's first point)."""
    weight = np.bincount(row, count, n)
    bound = np.full(n, np.log(m) + 6.0)
    out = np.zeros((n, m), _U)
    todo = np.flatnonzero(weight)
    while len(todo):
        index = np.full(n, -1)
        index[todo] = np.arange(len(todo))
        use = index[row] >= 0
        limit = bound[todo] / weight[todo]
        time = np.full(len(todo) * m, np.inf)
        mark = np.zeros(len(todo) * m, _U)
        r, s, low, width, c = _ranges(index[row[use]], shingle[use], count[use])
        t = np.zeros(len(r))
        k = np.zeros(len(r), _U)
        while len(r):
            k = k + _U(1)
            point = mix64(s ^ (k * _STEP))
            t = t - np.log(_unit(point)) / (width * m)
            going = t < limit[r]
            if not going.all():
                r, s, low, width, c, t, k, point = (x[going] for x in (r, s, low, width, c, t, k, point))
                if not len(r):
                    break
            # halve the range around the point until its level is certain to lie below or above the count
            a, w, z = low.copy(), width.copy(), mix64(point + _STEP)
            part = np.flatnonzero(a + w > c)
            while len(part):
                w[part] //= 2
                up = (z[part] & _U(1)).astype(bool)
                z[part] >>= _U(1)
                a[part[up]] += w[part[up]]
                part = part[(a[part] < c[part]) & (a[part] + w[part] > c[part])]
            below = a < c
            slot = r[below] * m + (mix64(point[below] ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(m)).astype(np.int64)
            when, what = t[below], point[below]
            # several points may meet in a slot: the earliest of this round, then the earlier of it and the one that is there
            order = np.lexsort((when, slot))
            slot, when, what = slot[order], when[order], what[order]
            one = np.flatnonzero(np.diff(slot, prepend=-1))
            slot, when, what = slot[one], when[one], what[one]
            better = when < time[slot]
            time[slot[better]], mark[slot[better]] = when[better], what[better]
        time, mark = time.reshape(-1, m), mark.reshape(-1, m)
        full = np.isfinite(time).all(1)
        out[todo[full]] = mark[full]
        todo = todo[~full]
        bound[todo] *= 2
    return out


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("neardup", None, lambda: None)
        salt = np.arange(1, bands + 1, dtype=_U) * _STEP
        for batch in pieces(batches):
            n = batch.num_rows
            row, h, c = shingles(batch.column("text"))
            sig = signatures(row, h, c, n, bands * rows).reshape(n, bands, rows)
            key = np.broadcast_to(salt, (n, bands)).copy()
            for i in range(rows):
                key = mix64(key * _STEP + sig[:, :, i])
            # the multiset itself, as two independent sums over its elements
            own = mix64(h * _STEP + c.astype(_U))
            same = [np.zeros(n, _U), np.zeros(n, _U)]
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                for x, v in zip(same, (own, mix64(own ^ _STEP)), strict=True):
                    x[row[first]] = np.add.reduceat(v, first)
            flat = pa.array(key.view(np.int64).ravel(), pa.int64())
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "tk": batch.column("tk"),
                    "same": pa.array(same[0].view(np.int64), pa.int64()),
                    "same2": pa.array(same[1].view(np.int64), pa.int64()),
                    "some": pa.array(np.bincount(row, minlength=n) > 0),
                    "keys": pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), flat),
                }
            )

    return run


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A multiset as a set, which has the same Jaccard index: each shingle with the numbers 0, 1, ... up to its count; 32 bits of a hash each."""
    for batch in pieces(batches):
        row, h, c = shingles(batch.column("text"))
        number = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        row, h = np.repeat(row, c), (mix64(np.repeat(h, c) + number.astype(_U) * _STEP) >> _U(32)).astype(np.uint32)
        key = np.unique((row.astype(_U) << _U(32)) | h)  # sorted by row and hash
        at = np.searchsorted(key >> _U(32), np.arange(batch.num_rows + 1))
        values = (key & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        yield pa.record_batch({"node": batch.column("node"), "bag": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))})


def similarity(a: Column, b: Column) -> Column:
    """Jaccard index of two sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, sim) for (a, b): b may be the centre of very many pairs, so its copies are dealt out."""
    often = pairs.groupBy("b").agg(F.count("*").alias("n")).select(F.col("b"), F.ceil(F.col("n") / SALT).cast("int").alias("parts"))
    centres = bags.join(often, bags.node == often.b).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("bag").alias("bag_b"), "parts")
    dealt = pairs.join(often, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    joined = dealt.join(centres.drop("parts"), ["b", "part"]).join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    return joined.select("a", "b", similarity(F.col("bag_a"), F.col("bag_b")).alias("sim"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes with an edge in (a, b)."""
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup_edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("node"), F.least("a", "n").alias("label")), "neardup_labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        # jump: a node takes the label of its label
        of = step.select(F.col("node").alias("up"), F.col("label").alias("above"))
        step = step.join(of, step.label == of.up, "left").select("node", F.least("label", "above").alias("label"), "old")
        step = stage(step, "neardup_labels")
        labels = step.select("node", "label")
        if step.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def _key() -> Column:
    return F.xxhash64("text")


def small(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """df, marked for broadcast if its rows, counted, fit SMALL; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() * bytes_a_row <= SMALL else df


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, tk, node, keys): tk names the text, node its multiset (null without words), keys are the buckets."""
    made = docs.select("doc_id", "text", _key().alias("tk")).mapInArrow(_sign(bands, rows), "doc_id bigint, tk bigint, same bigint, same2 bigint, some boolean, keys array<bigint>")
    made = stage(made, "neardup_signed")
    return made.select("doc_id", "tk", F.when(F.col("some"), F.xxhash64("same", "same2")).alias("node"), "keys")


def _flat(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    col = col.combine_chunks()
    return col.flatten().to_numpy(), col.value_lengths().to_numpy().astype(np.int64)


def _blocks(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        left, right = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        out: list[list[np.ndarray]] = [[], [], []]
        if len(left) and len(right):
            every, size = _flat(right["bag"])
            owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            nodes, labels = right["node"].to_numpy(), right["label"].to_numpy()
            asked, long = _flat(left["bag"])
            ends = np.cumsum(long)
            for node, label, a, b in zip(left["node"].to_numpy(), left["label"].to_numpy(), ends - long, ends, strict=True):
                x = asked[a:b]
                lo, hi = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
                n = hi - lo
                both, total = np.zeros(len(size), np.int64), np.cumsum(n)
                # shingles that very many members hold are looked at a part at a time
                for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(total // PAIRS)) + 1):
                    k, first = n[part], lo[part]
                    at = np.repeat(first - (np.cumsum(k) - k), k) + np.arange(k.sum())
                    both += np.bincount(owner[at], minlength=len(size))
                sim = both / (size + len(x) - both)
                i = np.flatnonzero((sim >= threshold) & (labels != label))
                for held, found in zip(out, (np.full(len(i), node), nodes[i], sim[i]), strict=True):
                    held.append(found)
        a, b, sim = (np.concatenate(x) if x else np.zeros(0) for x in out)
        give_back()
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "sim": pa.array(sim.astype(float))})

    return run


def edges(docs: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): similar nodes, enough of them to connect every class."""
    named = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("of")
    texts = signed.where("node is not null").groupBy("node").agg(F.first("keys").alias("keys"), named)
    buckets = texts.select("node", "of", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(buckets.join(shared, "key").select("key", "n", "node", "of"), "neardup_buckets")
    asked = stage(members.groupBy("node").agg(F.first("of").alias("of")).select("node", "of.doc_id", "of.tk"), "neardup_asked")
    members = members.drop("of")
    found = docs.select("doc_id", "text", _key().alias("tk")).alias("d").join(small(asked, 48).alias("q"), F.expr("d.tk = q.tk and d.doc_id <=> q.doc_id"))
    bags = stage(found.select("node", "text").dropDuplicates(["node"]).mapInArrow(_multisets, "node bigint, bag array<int>"), "neardup_bags")
    similar: list[DataFrame] = []
    labelled = members.withColumn("label", F.col("node"))

    def relabel() -> DataFrame:
        every = similar[0]
        for e in similar[1:]:
            every = every.union(e)
        labels = components(every).withColumnRenamed("node", "l")
        return stage(members.join(labels, F.col("node") == F.col("l"), "left").select("key", "n", "node", F.coalesce("label", "node").alias("label")), "neardup_labelled")

    for star in range(STARS):
        order = F.xxhash64("node") if not star else F.xxhash64("node", "key", F.lit(star))
        centres = labelled.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("centre"), F.col("label").alias("c_label"))).alias("c")).select("key", "c.centre", "c.c_label")
        pairs = labelled.join(centres, "key").where("label != c_label").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
        similar.append(stage(verified(stage(pairs, f"neardup_pairs_{star}"), bags).where(F.col("sim") >= threshold).select("a", "b"), f"neardup_star_{star}"))
        labelled = relabel()
    # the rest: members outside their bucket's main class, against whom they aren't in one class with
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("classes")).where("classes > 1").select("key", F.col("m.label").alias("main"))
    mixed = stage(labelled.join(main, "key").withColumn("asks", F.col("label") != F.col("main")), "neardup_mixed")
    low = mixed.where(F.col("n") <= FEW)
    one = low.where("asks").select("key", F.col("node").alias("a"), F.col("label").alias("la"))
    two = low.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("asks").alias("too"))
    pairs = one.join(two, "key").where("la != lb and (not too or a < b)").select("a", "b").distinct()
    similar.append(verified(stage(pairs, "neardup_pairs_rest"), bags).where(F.col("sim") >= threshold).select("a", "b"))
    high = mixed.where(F.col("n") > FEW).join(bags, "node").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    own, others = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asking = high.where("asks").select("key", "node", "label", "bag", F.lit(True).alias("asks"), own.alias("i"), others.alias("j"))
    asked_of = high.select("key", "node", "label", "bag", F.lit(False).alias("asks"), own.alias("j"), others.alias("i"))
    blocks = asking.unionByName(asked_of).groupBy("key", "i", "j").applyInArrow(_blocks(threshold), "a bigint, b bigint, sim double")
    similar.append(blocks.select("a", "b"))
    every = similar[0]
    for e in similar[1:]:
        every = every.union(e)
    return stage(every, "neardup_links")


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(signed, of): of has node, class_id (the smallest doc_id of the class) and rep, the class's first row."""
    signed = sign(docs, bands, rows)
    labels = components(edges(docs, signed, threshold))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    nodes = signed.groupBy("node").agg(F.min(first).alias("rep")).join(labels.select(F.col("node").alias("n"), "label"), F.col("node") == F.col("n"), "left")
    nodes = nodes.select("node", F.coalesce("label", "node").alias("label"), "rep")
    reps = nodes.groupBy(F.col("label").alias("l")).agg(F.min("rep").alias("rep"))
    of = nodes.drop("rep").join(reps, F.col("label").eqNullSafe(F.col("l"))).select("node", "rep.doc_id", "rep.tk")
    return signed, stage(of.withColumnRenamed("doc_id", "class_id"), "neardup_classes")


def assign(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id for every row of docs (doc_id, text)."""
    signed, of = classes(docs, **how)
    of = of.select(F.col("node").alias("n"), "class_id")
    return signed.select("doc_id", "node").join(of, F.col("node").eqNullSafe(F.col("n"))).select("doc_id", "class_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with the first document of each class only (smallest doc_id)."""
    signed, of = classes(docs, **how)
    of = of.select(F.col("node").alias("n"), "class_id", F.col("tk").alias("class_tk"))
    rows = signed.select("doc_id", "tk", "node").join(of, F.col("node").eqNullSafe(F.col("n")))
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tk") == F.col("class_tk"))
    gone_id, gone_tk = (free_name(c, docs.columns) for c in ("_gone_id", "_gone_tk"))
    gone = stage(rows.where(~first).select(F.col("doc_id").alias(gone_id), F.col("tk").alias(gone_tk)).distinct(), "neardup_gone")
    out = docs.join(small(gone, 32), (_key() == F.col(gone_tk)) & F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
    repeated = rows.where(first).groupBy("doc_id", "tk").agg(F.count("*").alias("times")).where("times > 1")
    return out if repeated.isEmpty() else _once(out)


def _once(docs: DataFrame) -> DataFrame:
    """Of rows with one doc_id and text that whose columns have the smallest hash, once."""
    h, best, d, k = (free_name(c, docs.columns) for c in ("_h", "_best", "_d", "_k"))
    named = docs.withColumn(h, F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256))
    first = named.groupBy(F.col("doc_id").alias(d), _key().alias(k)).agg(F.min(h).alias(best))
    kept = named.join(first, F.col("doc_id").eqNullSafe(F.col(d)) & (_key() == F.col(k)) & (F.col(h) == F.col(best)), "left_semi")
    return kept.dropDuplicates([h]).drop(h)


def op2_near_duplicates(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"))
