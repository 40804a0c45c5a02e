"""Pareto fronts: no worse on every axis and better on one. Equal vectors don't dominate each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamill.operators.ranks import RANGES
from stratamill.storage import cut_lineage
from stratamill.types import Refusal

def admit(axes: list[tuple[str, str]]) -> dict[str, str]:
    """Axes as (name, direction): two or more, different names, directions that are said."""
    if len({n for n, _ in axes}) != len(axes):
        raise Refusal("axis_repeated", str([n for n, _ in axes]))
    _axes(dict(axes))
    return dict(axes)


def _axes(axes: dict[str, str]) -> list[str]:
    if len(axes) < 2:
        raise Refusal("axes", "two or more are needed")
    if bad := [d for d in axes.values() if d not in ("maximize", "minimize")]:
        raise Refusal("axis_direction", str(bad))
    return list(axes)


def _signed(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    return df.select(*(((F.col(a) if d == "maximize" else -F.col(a)) + 0.0).alias(f"_{i}") for i, (a, d) in enumerate(axes.items())))


def vectors(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    """_0, _1, ..., n: distinct vectors, all to be maximised, and how many rows have each."""
    names = [f"_{i}" for i in range(len(axes))]
    return _signed(df, axes).groupBy(*names).agg(F.count("*").alias("n"))


def _front_2(v: DataFrame) -> DataFrame:
    """Two axes: in descending order of the first, a vector is on the front if its second is above all before it, and the highest of its own first."""
    top = v.groupBy("_0").agg(F.max("_1").alias("_1"))
    cuts = sorted(set(top.approxQuantile("_0", [i / RANGES for i in range(1, RANGES)], 0.005)))
    top = top.withColumn("_r", sum(((F.col("_0") >= c).cast("int") for c in cuts), F.lit(0)))
    w = Window.partitionBy("_r").orderBy(F.col("_0").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = top.groupBy("_r").agg(F.max("_1").alias("_m"))
    edge = edge.withColumn("_before", F.max("_m").over(Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    seen = F.greatest(F.max("_1").over(w), F.col("_before"))
    return top.join(edge, "_r").withColumn("_seen", seen).where("_seen is null or _1 > _seen").select("_0", "_1")


#: Pairs of vectors that are compared at once.
PAIRS = 1 << 20


def dominating(a, w, b):
    """For each row of b the weights of the rows of a that are as large or larger on every axis.

    Divide and conquer: at a middle value of the first axis the upper part of a is above
    the lower part of b, which leaves one axis less; the two parts that share a side go on
    with the same axis. One axis is a search in sorted values, few pairs are compared.
    """
    import numpy as np

    out = np.zeros(len(b), np.int64)
    stack = [(np.arange(len(a)), np.arange(len(b)), 0)]
    while stack:
        i, j, axis = stack.pop()
        if not len(i) or not len(j):
            continue
        x, y = a[i, axis], b[j, axis]
        i, j = i[x >= y.min()], j[y <= x.max()]
        if not len(i) or not len(j):
            continue
        x, y = a[i, axis], b[j, axis]
        if axis == a.shape[1] - 1:
            order = np.argsort(x, kind="stable")
            after = np.append(np.cumsum(w[i][order][::-1])[::-1], 0)
            out[j] += after[np.searchsorted(x[order], y, "left")]
        elif x.min() >= y.max():
            stack.append((i, j, axis + 1))
        elif len(i) * len(j) <= PAIRS:
            above = np.ones((len(j), len(i)), bool)
            for k in range(axis, a.shape[1]):
                above &= a[i, k] >= b[j, k][:, None]
            out[j] += above @ w[i]
        else:
            middle = np.sort(np.concatenate([x, y]))[(len(x) + len(y)) // 2]
            upper, over = x >= middle, y > middle
            stack += [(i[upper], j[~over], axis + 1), (i[upper], j[over], axis), (i[~upper], j[~over], axis)]
    return out


#: Vectors that a task keeps to drop others by.
STRONG = 20_000


def _local(names: list[str]):
    """Vectors that nothing in sight dominates: those of their batch and the ones that the task keeps."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept = np.zeros((0, len(names)))
        for batch in batches:
            x = np.vstack([kept, np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])])
            kept = x[dominating(x, np.ones(len(x), np.int64), x) == 1]  # vectors are distinct, so each has itself at least
            if len(kept) > STRONG:
                yield pa.record_batch([pa.array(c) for c in kept.T], names=names)
                kept = kept[:0]
        if len(kept):
            yield pa.record_batch([pa.array(c) for c in kept.T], names=names)

    return run


def front(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    """The rows of df that no row dominates.

    Two axes need one running maximum. With more, each task first drops what it can by
    itself; of the survivors those stay that no survivor dominates, by counts over ranges.
    """
    _axes(axes)
    names = [f"_{i}" for i in range(len(axes))]
    v = vectors(df, axes).drop("n")
    if len(names) == 2:
        on = _front_2(v)
    else:
        left = v.mapInArrow(_local(names), ", ".join(f"{n} double" for n in names)).withColumn("n", F.lit(1).cast("bigint"))
        on = _counts(left, names).where("dominated_by = 0").select(*names)
    keys = [((F.col(a) if d == "maximize" else -F.col(a)) + 0.0) for a, d in axes.items()]
    rows = df.withColumns({n: k for n, k in zip(names, keys, strict=True)})
    return rows.join(on, names, "left_semi").drop(*names)


#: Vectors of a range, and cells of ranges at most (the size of a table that every executor gets).
IN_RANGE, MOST_CELLS = 50_000, 1 << 20


def _counts(v: DataFrame, names: list[str]) -> DataFrame:
    """names, dominated_by of distinct vectors (names, n), without pairs of them.

    Every axis is cut in ranges. Let k be the first axis on which what dominates a vector
    lies in the vector's own range: on those before it the range is higher, on those after it
    the value is as high at least. So there is one count inside the ranges of each axis, and
    what is beyond on all axes is a sum over cells of ranges. A range with many vectors, as
    one value of an axis may have, is cut in slices: each slice of it meets each, in a task of
    its own.
    """
    import numpy as np
    import pyarrow as pa

    v = cut_lineage(v)
    d = len(names)
    ranges = max(1, min(int(MOST_CELLS ** (1 / d)), -(-v.count() // IN_RANGE)))
    cuts = [np.array(sorted(set(c))) for c in v.approxQuantile(names, [i / ranges for i in range(1, ranges)], 0.1 / ranges)] if ranges > 1 else [np.zeros(0)] * d
    places = [f"r{i}" for i in range(d)]

    def dealt(batches):
        for x in batches:
            r = [pa.array(np.searchsorted(c, x.column(n).to_numpy(zero_copy_only=False), "right"), pa.int32()) for n, c in zip(names, cuts, strict=True)]
            yield pa.record_batch([x.column(n) for n in (*names, "n")] + r, names=[*names, "n", *places])

    rows = cut_lineage(v.select(*names, "n").mapInArrow(dealt, ", ".join([*(f"{n} double" for n in names), "n bigint", *(f"{p} int" for p in places)])))
    cells, many = np.zeros((ranges + 1,) * d, np.int64), np.zeros((ranges + 1,) * d, np.int64)
    for c in rows.groupBy(*places).agg(F.sum("n").alias("n"), F.count("*").alias("m")).toLocalIterator():  # MOST_CELLS at most
        at = tuple(c[p] for p in places)
        cells[at], many[at] = c["n"], c["m"]
    for k in range(d):
        cells = np.flip(np.flip(cells, k).cumsum(k), k)
    beyond = v.sparkSession.sparkContext.broadcast(cells)

    def over_all(batches):
        for x in batches:
            at = tuple(x.column(p).to_numpy() + 1 for p in places)
            yield pa.record_batch([x.column(n) for n in names] + [pa.array(beyond.value[at])], names=[*names, "above"])

    def inside(k: int):
        def run(g: pa.Table) -> pa.Table:
            # on axes before k the range has to be higher, from k on the value as high
            x = np.column_stack([g.column(p if i < k else n).to_numpy().astype(float) for i, (n, p) in enumerate(zip(names, places, strict=True))])
            w, ours = g.column("n").to_numpy(), g.column("asks").to_numpy(zero_copy_only=False)
            asked = x[ours]
            asked[:, :k] += 1
            above = dominating(x[~ours], w[~ours], asked)
            return pa.table({n: g.column(n).filter(pa.array(ours)) for n in names} | {"above": pa.array(above)})

        return run

    kind = ", ".join([*(f"{n} double" for n in names), "above bigint"])
    parts = [rows.mapInArrow(over_all, kind)]
    for k in range(d):
        sizes = many.sum(tuple(i for i in range(d) if i != k))
        cut = F.element_at(F.array(*(F.lit(int(-(-m // IN_RANGE)) or 1) for m in sizes)), F.col(f"r{k}") + 1)
        sliced = rows.withColumn("_s", cut).withColumn("_own", F.pmod(F.xxhash64(*names), F.col("_s")))
        every = F.sequence(F.lit(0).cast("bigint"), (F.col("_s") - 1).cast("bigint"))
        asks = sliced.withColumns({"asks": F.lit(True), "_of": F.explode(every)})
        gives = sliced.withColumns({"asks": F.lit(False), "_of": F.col("_own")}).withColumn("_own", F.explode(every))
        both = asks.unionByName(gives)
        parts.append(both.groupBy(f"r{k}", "_own", "_of").applyInArrow(inside(k), kind))
    total = reduce(DataFrame.union, parts).groupBy(*names).agg(F.sum("above").alias("_above"))
    # A vector is as high as itself, inside the ranges of the first axis.
    return total.join(v.select(*names, "n"), names).select(*names, (F.col("_above") - F.col("n")).alias("dominated_by"))


def domination_counts(df: DataFrame, axes: dict[str, str], max_work: int | None = None) -> DataFrame:
    """df with `dominated_by`, the number of rows that dominate it. Vectors are counted by ranges of their axes, not held against each other in pairs."""
    _axes(axes)
    names = [f"_{i}" for i in range(len(axes))]
    v = vectors(df, axes)
    if max_work is not None and (n := v.count()) * (n - 1) // 2 > max_work:
        raise Refusal("work", f"{n * (n - 1) // 2} comparisons, {max_work} admitted")
    counts = _counts(v, names)
    keys = [((F.col(a) if d == "maximize" else -F.col(a)) + 0.0) for a, d in axes.items()]
    rows = df.withColumns({n: k for n, k in zip(names, keys, strict=True)}).join(counts, names, "left")
    return rows.withColumn("dominated_by", F.coalesce("dominated_by", F.lit(0))).drop(*names)


def work(n: int) -> int:
    """Rows read and comparisons of all pairs, which is what `max_work` admits."""
    return n + n * (n - 1) // 2


def input_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """digest, rows: a name for a set of rows whatever their order: per-row SHA-256, combined by bucket and then over 256 buckets."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    buckets = df.select(row.alias("d")).groupBy(F.substring("d", 1, 2).alias("b"), F.substring("d", 3, 3).alias("c")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.count("*").alias("n"))
    top = buckets.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda x: x["d"]), ""), 256).alias("d"), F.sum("n").alias("n"))
    return top.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.sum("n").alias("rows"))
