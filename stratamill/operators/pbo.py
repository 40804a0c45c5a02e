"""Probability of backtest overfitting by combinatorially symmetric cross-validation.

Input is one row per trial and block of returns (n, s, m2). Every choice of half of
the blocks is a training set; the trials with the best pooled statistic there are
looked up in the other half. What grows is splits x trials; splits are a table, and
folds go over at most `blocks` elements.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.operators.ranks import below
from stratamill.storage import cut_lineage
from stratamill.types import Refusal


def ordered_splits(blocks: int) -> list[tuple[int, ...]]:
    """Training halves: those with block 0 in lexicographic order, then their complements."""
    if blocks < 2 or blocks % 2:
        raise Refusal("pbo_odd_s", str(blocks))
    first = [c for c in combinations(range(blocks), blocks // 2) if c[0] == 0]
    return first + [tuple(sorted(set(range(blocks)) - set(c))) for c in first]


def work(blocks: int, trials: int) -> int:
    splits = math.comb(blocks, blocks // 2)
    return splits // 2 * trials * (blocks - 2) + 2 * splits * trials


def splits_table(spark: SparkSession, blocks: int) -> DataFrame:
    """split, block, train, in the order of ordered_splits(), made by the executors.

    A half with block 0 is a mask of the other blocks, block 1 the highest bit; its
    place in lexicographic order is the number of masks above it, a sum of binomials.
    """
    if blocks < 2 or blocks % 2 or blocks > 62:
        raise Refusal("pbo_odd_s", str(blocks))
    half, mask = blocks // 2, F.col("id")
    place, left = F.lit(0).cast("long"), F.lit(half - 1)
    for i in range(blocks - 2, -1, -1):
        bit = F.shiftright(mask, i).bitwiseAND(F.lit(1).cast("long"))
        above = F.array(*(F.lit(math.comb(i, k - 1) if k else 0).cast("long") for k in range(half + 1)))
        place = place + F.when(bit == 0, F.get(above, left)).otherwise(F.lit(0).cast("long"))
        left = left - bit.cast("int")
    masks = spark.range(1 << (blocks - 1)).where(F.bit_count(mask) == half - 1).select(place.alias("split"), mask.alias("mask"))
    block = masks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    train = F.when(F.col("block") == 0, F.lit(True)).otherwise(F.expr(f"(shiftright(mask, {blocks - 1} - block) & 1) = 1"))
    first = block.select(F.col("split").cast("int").alias("split"), "block", train.alias("train"))
    other = first.select((F.col("split") + math.comb(blocks, half) // 2).cast("int").alias("split"), "block", (~F.col("train")).alias("train"))
    return first.union(other)


def merge(a: Column, b: Column) -> Column:
    """Moments (n, s, m2) of two disjoint sets of values together; the same operations in the same order everywhere (fixed by the contract)."""
    n = a["n"] + b["n"]
    delta = b["s"] / b["n"] - a["s"] / a["n"]
    m2 = (a["m2"] + b["m2"]) + delta * delta * a["n"] * b["n"] / n
    return F.struct(n.alias("n"), (a["s"] + b["s"]).alias("s"), m2.alias("m2"))


def statistic(m: Column) -> Column:
    """Mean over sample standard deviation; null without spread."""
    return F.when(m["m2"] > 0, (m["s"] / m["n"]) / F.sqrt(m["m2"] / (m["n"] - 1)))


def fold(blocks: Column) -> Column:
    """Moments of an array of (n, s, m2), merged from left to right."""
    first = F.struct(blocks[0]["n"].alias("n"), blocks[0]["s"].alias("s"), blocks[0]["m2"].alias("m2"))
    return F.aggregate(F.slice(blocks, 2, F.size(blocks)), first, merge)


def folded(moments: DataFrame, *by: str) -> DataFrame:
    """by and m, the moments of all blocks of each group, in ascending order. A list has as many elements as there are blocks."""
    item = F.struct("block", F.col("n").cast("double").alias("n"), "s", "m2")
    g = moments.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_b"))
    return g.select(*by, fold(F.col("_b")).alias("m"))


def pooled(moments: DataFrame, splits: DataFrame) -> DataFrame:
    """split, key, train, stat, from moments (key, block, n, s, m2): blocks merged in ascending order, left to right."""
    j = moments.join(splits, "block")
    return folded(j, "split", "key", "train").select("split", "key", "train", statistic(F.col("m")).alias("stat"))


def split_results(moments: DataFrame, blocks: int, spark: SparkSession | None = None) -> DataFrame:
    """split, winner, ties, rank2, trials, side: for every split and each of its `ties` winners twice the mid-rank out of sample, and whether that is below (-1), at (0) or above (1) the middle."""
    spark = spark or moments.sparkSession
    stats = cut_lineage(pooled(moments, splits_table(spark, blocks)))
    if flat := stats.where("stat is null").limit(1).collect():  # a flat trial has no rank, and leaving it out would rank the others anew
        raise Refusal("pbo_zero_variance", str(flat[0]["key"]))
    train = stats.where("train").select("split", "key", "stat")
    test = stats.where("not train").select("split", "key", F.col("stat").alias("out"))
    top = train.groupBy("split").agg(F.max("stat").alias("top"))
    best = train.join(top, "split").where("stat = top").select("split", F.col("key").alias("winner"))
    facts = best.groupBy("split").agg(F.count("*").alias("ties")).join(test.groupBy("split").agg(F.count("*").alias("trials")), "split")
    reference = best.join(test.withColumnRenamed("key", "winner"), ["split", "winner"])
    # A winner's place comes from counts by (split, value), summed over ranges of values: one row a winner, however many trials tie.
    places = below(test, "out", ["split"]).select("split", "out", (2 * F.col("before") + F.col("n") + 1).alias("rank2"))
    ranked = reference.join(places, ["split", "out"]).join(facts, "split").select("split", "winner", "ties", "rank2", "trials")
    return ranked.withColumn("side", F.signum((F.col("rank2") - (F.col("trials") + 1)).cast("double")).cast("int"))


def pbo(moments: DataFrame, blocks: int, max_work: int | None = None) -> dict:
    """Shares of splits whose winner falls to or below the middle, exactly."""
    trials = moments.select("key").distinct().count()
    if max_work is not None and work(blocks, trials) > max_work:
        raise Refusal("pbo_resource_exceeded", str(work(blocks, trials)))
    if trials < 2:
        raise Refusal("pbo_too_few_trials", str(trials))
    if moments.groupBy("key").agg(F.count_distinct("block").alias("b")).where(F.col("b") != blocks).limit(1).count():
        raise Refusal("pbo_block_mismatch")
    counts = split_results(moments, blocks).groupBy("side", "ties").agg(F.count("*").alias("n")).collect()
    by = {-1: Fraction(0), 0: Fraction(0), 1: Fraction(0)}
    for r in counts:
        by[r["side"]] += Fraction(r["n"], r["ties"])
    n = math.comb(blocks, blocks // 2)
    return {"n_splits": n, "n_lt0": float(by[-1]), "n_eq0": float(by[0]), "n_gt0": float(by[1]), "pbo": float((by[-1] + by[0]) / n), "strict_rate": float(by[-1] / n), "work": work(blocks, trials)}


#: Samplers whose trials don't depend on results (fixed names).
INDEPENDENT = ("grid", "random", "sobol")
ADAPTIVE = ("tpe", "dlib_global", "candidates")
#: Why a roster's rows can't be used, in the order in which they're told (fixed values).
DEFECTS = (
    "pbo_input_invalid",
    "pbo_roster_mismatch",
    "pbo_status_error",
    "pbo_status_pruned",
    "pbo_status_partial",
    "pbo_non_positive_equity",
    "pbo_rows_incomplete",
    "pbo_block_mismatch",
)


def roster_label(sampler: str, early_stop: bool) -> str:
    """Whether the estimate is that of the published method or only a diagnostic."""
    if sampler not in INDEPENDENT + ADAPTIVE:
        raise Refusal("pbo_sampler_unknown", sampler)
    return "paper_conformant" if sampler in INDEPENDENT and not early_stop else "diagnostic_adaptive_roster"


def roster_labels(sampler: Column, early_stop: Column) -> Column:
    """roster_label() of columns; null for a sampler that isn't known."""
    conformant = sampler.isin(*INDEPENDENT) & ~early_stop
    return F.when(sampler.isin(*INDEPENDENT, *ADAPTIVE), F.when(conformant, "paper_conformant").otherwise("diagnostic_adaptive_roster"))


def roster_defects(rows: DataFrame, roster: DataFrame, blocks: int) -> DataFrame:
    """key, defect: rows held against the declared roster (key).

    rows: key, status, n_blocks, and if it's there block_status, which isn't 0 for a curve
    that isn't positive throughout. A key in several rows doesn't match the roster.
    """
    own = rows if "block_status" in rows.columns else rows.withColumn("block_status", F.lit(0))
    twice = own.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_times"))
    own = own.join(twice, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    j = own.withColumn("_row", F.lit(1)).join(roster.withColumn("_in", F.lit(1)), "key", "full_outer")
    here = F.col("_row").isNotNull()
    defect = (
        F.when(here & (F.col("status").isNull() | F.col("key").isNull()), DEFECTS[0])
        .when(~here | F.col("_in").isNull() | (F.col("_times") > 1), DEFECTS[1])
        .when(~F.col("status").isin("ok", "constraint_violation", "pruned", "partial"), DEFECTS[2])
        .when(F.col("status") == "pruned", DEFECTS[3])
        .when(F.col("status") == "partial", DEFECTS[4])
        .when(F.col("block_status") != 0, DEFECTS[5])
        .when(F.col("n_blocks").isNull(), DEFECTS[6])
        .when(F.col("n_blocks") != blocks, DEFECTS[7])
    )
    return j.select("key", defect.alias("defect")).where("defect is not null")


def first_defect(defects: DataFrame) -> str | None:
    found = {r["defect"] for r in defects.select("defect").distinct().collect()}
    return next((d for d in DEFECTS if d in found), None)
