"""k-means over integer vectors, with Elkan's bounds instead of most distances.

Each vector carries an upper bound of the distance to its centroid and a lower bound
of the distance to each of the k. When centroids move the bounds move with them. A
vector's centroid stays without any distance while its upper bound is below half the
way to the nearest other centroid; of the rest, centroid j is tried only if neither
its lower bound nor half the way between the two centroids is above the upper bound.
Upper bounds are rounded up, lower ones and half ways down, and the comparisons that
skip are strict: a centroid that could be as near is always tried, so ties are seen.
Squared distances and centroids are exact integers.

A round is one pass over a table (vector, its cluster, its bounds) that the round
before it wrote, without a shuffle; sums by cluster and component are partial sums,
of which k rows reach the driver. A round's table goes when the next one is written.

Defined results: vectors that are null, have another number of components or one
that is null or not finite are left out; others get a row each, repeated rows
too; a null vec_id is kept, and comes last among the first centroids; of rows with one
vec_id the one with the smaller vector comes first there; fewer than k vectors give as
many centroids; an empty table gives an empty result; ties go to the smaller centroid.
Components of LIMIT or more, whose squared distances long may not hold, raise an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.llm.store import drop_stage, stage, table

COMPONENTS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Differences below 2 * LIMIT, of which 64 squares fit into a long.
LIMIT = 1 << 27
STATE = "vec_id {kind}, vector array<int>, cluster int, upper float, lower array<float>"


def _up(x: np.ndarray) -> np.ndarray:
    """The next 32-bit floats above x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = x - c
    return (d * d).sum(-1)


class Centres:
    """What a pass needs of the centroids: where they are, how far they moved and half the ways between them."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.at = now.astype(np.int64)
        k = len(self.at)
        apart = np.array([squares(self.at, self.at[j]) for j in range(k)], np.int64).reshape(k, k)
        self.half = _down(np.sqrt(apart) / 2)
        alone = self.half.copy()
        np.fill_diagonal(alone, np.float32(np.inf))
        self.nearest = alone.min(1) if k else alone
        moved = np.zeros(k) if before is None else np.sqrt(squares(self.at, before.astype(np.int64)))
        self.moved = np.where(moved > 0, _up(moved), np.float32(0))


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: Centres) -> int:
    """Move the bounds with the centroids and the vectors to their nearest centroid, in place; the number of distances that it took."""
    upper[:] = np.where(centres.moved[cluster] > 0, _up(upper + centres.moved[cluster]), upper)
    lower[:] = np.where(centres.moved > 0, _down(lower - centres.moved), lower)
    open_ = np.flatnonzero(upper >= centres.nearest[cluster])
    best = squares(x[open_], centres.at[cluster[open_]])
    root = np.sqrt(best)
    upper[open_], lower[open_, cluster[open_]] = _up(root), _down(root)
    tried = len(open_)
    for j in range(len(centres.at)):
        own, most = cluster[open_], upper[open_]
        at = np.flatnonzero((own != j) & (most >= lower[open_, j]) & (most >= centres.half[own, j]))
        rows = open_[at]
        found = squares(x[rows], centres.at[j])
        root = np.sqrt(found)
        lower[rows, j] = _down(root)
        nearer = (found < best[at]) | ((found == best[at]) & (j < cluster[rows]))
        cluster[rows[nearer]], upper[rows[nearer]], best[at[nearer]] = j, _up(root[nearer]), found[nearer]
        tried += len(at)
    return tried


def _rows(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _pass(centres, width: int):
    """A round's assignments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch, "vector", width).astype(np.int64)
            cluster, upper = batch.column("cluster").to_numpy().copy(), batch.column("upper").to_numpy().copy()
            lower = _rows(batch, "lower", len(c.at)).copy()
            assign(x, cluster, upper, lower, c)
            yield pa.record_batch([batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower)], names=["vec_id", "vector", "cluster", "upper", "lower"])

    return run


def _first(centres, width: int):
    """The first assignment: nothing is known, so every vector begins at centroid 0 with bounds that skip nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres.value.at)
        for batch in batches:
            n = batch.num_rows
            if n:
                bounds = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, np.inf, np.float32)), _lists(np.zeros((n, k), np.float32))]
                yield from _pass(centres, width)([pa.record_batch([batch.column("vec_id"), batch.column("vector"), *bounds], names=["vec_id", "vector", "cluster", "upper", "lower"])])

    return run


def _last(centres, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            found = squares(_rows(batch, "vector", width).astype(np.int64), centres.value.at[cluster])
            yield pa.record_batch([batch.column("vec_id"), batch.column("vector"), batch.column("cluster"), pa.array(found, pa.int64())], names=["vec_id", "vector", "cluster", "distance"])

    return run


def integers(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) of the vectors that count; df: vec_id, embedding."""
    e, v = F.col("embedding"), F.col("_scaled")
    sound = F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf)))
    kept = df.select("vec_id", "embedding").where(F.coalesce((F.size(e) == components) & sound, F.lit(False)))
    scaled = kept.select("vec_id", F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("_scaled"))
    small = F.forall(v, lambda x: (x < LIMIT) & (x > -LIMIT))
    return scaled.select("vec_id", F.when(small, v.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component of {LIMIT} or more"))).alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hash of their vec_id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = vectors.select(h.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([r["vector"] for r in found], np.int64)


def _centroids(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Floors of the means of non-empty clusters."""
    sums = [F.sum(F.col("vector")[i].cast("bigint")).alias(f"s{i}") for i in range(now.shape[1])]
    out = now.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows at most
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(now.shape[1])]
    return out


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, vector, cluster, distance), final centroids); df: vec_id, embedding."""
    spark, kind = df.sparkSession, df.schema["vec_id"].dataType.simpleString()
    vectors = integers(df, components, scale)
    now = first_centroids(vectors, k, seed)
    if not len(now):
        return vectors.select("vec_id", "vector", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), now
    form = STATE.format(kind=kind)
    centres = spark.sparkContext.broadcast(Centres(now))
    state = stage(vectors.mapInArrow(_first(centres, components), form), "elkan")
    for _ in range(rounds):
        moved = _centroids(state, now)
        if (moved == now).all():
            break
        centres, now = spark.sparkContext.broadcast(Centres(moved, now)), moved
        following = stage(state.mapInArrow(_pass(centres, components), form), "elkan")
        drop_stage(state)
        state = following
    return state.mapInArrow(_last(centres, components), f"vec_id {kind}, vector array<int>, cluster int, distance bigint"), now


def op12_centroid_clustering(spark, sf_dir):
    out, centroids = cluster(table(spark, sf_dir, "embeddings", 10_000))
    by = {r["cluster"]: r["n"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    written = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(j, by.get(j, 0), sum(by.values()), h) for j, h in enumerate(written)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> str:
    assigned = """a{r} AS MATERIALIZED (SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
      SELECT x.n, m.c, sum((x.v - m.v) * (x.v - m.v))::BIGINT AS d FROM x JOIN m{r} m USING (i) GROUP BY 1, 2) GROUP BY 1)"""
    moved = """m{s} AS MATERIALIZED (SELECT m.c, m.i, coalesce(f.v, m.v) AS v FROM m{r} m LEFT JOIN (
      SELECT c, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM x JOIN a{r} USING (n) GROUP BY 1, 2) f USING (c, i))"""
    steps = ",\n    ".join(assigned.format(r=r) + (",\n    " + moved.format(r=r, s=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
    WITH kept AS MATERIALIZED (SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v, row_number() OVER () AS n
      FROM embeddings WHERE len(embedding) = {components} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {components}),
    x AS MATERIALIZED (SELECT n, unnest(v) AS v, unnest(range({components})) AS i FROM kept),
    m0 AS MATERIALIZED (SELECT c, unnest(v) AS v, unnest(range({components})) AS i FROM (
      SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept) WHERE c < {k}),
    {steps},
    facts AS (SELECT c, sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY 1)
    SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
    FROM kept JOIN a{rounds} USING (n) JOIN facts USING (c)"""


ORACLE_OP12 = _oracle()
