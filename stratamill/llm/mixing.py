"""Mix sources to target weights by hash-threshold histograms.

Every row gets a 60-bit hash. Words are summed by source and by the first ten bits
of the hash; a running sum over those 1,024 buckets finds the bucket in which a
source's budget ends. Only the rows of that bucket are split by the next ten bits,
and so on, until the boundary bucket holds one hash. A row is taken when its hash
lies below its source's threshold: no sort and nothing per row leaves the executors.

A source whose target is above its size takes every row once and spends the rest
as second copies by the same rule.

Defined results: null text has size 0 and is never taken twice or once more than
its words (0); null source is a source of its own and comes last; rows that agree
in doc_id and text share a hash and therefore their fate; an empty table gives an
empty result; a column named like one of ours in the input is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamill.llm.store import free_name, stage, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BITS, LEVELS = 10, 6


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5, so that SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources in code point order get the weights in turn. Resharing what exceeds
    `most` times a source's size until none does is filling to one water level:
    with sources in the order of size over weight, those before the level are
    capped and the rest get level x weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    picked = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    w = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", picked)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumns(
        {
            "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most),
            "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "budget": F.sum("source_size").over(everything) * F.lit(share),
        }
    )
    w = w.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("left_weight"))
    w = w.withColumn("over", F.col("level") * F.col("weight") > F.col("source_size") * F.lit(most))
    first = F.min(F.when(~F.col("over"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level").alias("v")))).over(everything)
    w = w.withColumn("level", first["v"])
    return w.select("source", "source_size", F.when(F.col("over"), F.col("source_size") * F.lit(most)).otherwise(F.col("level") * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, cut): rows of the source with hash < cut fill its budget as nearly as whole hashes can.

    sized: (source, size, h); goals: (source, source_size, target, budget).
    """
    cut = goals.select("source", F.lit(0).cast("long").alias("low"), F.col("budget").alias("left"), F.lit(False).alias("done"))
    for level in range(LEVELS):
        shift = 60 - BITS * (level + 1)
        rows = sized.join(cut.where(~F.col("done")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        if level:
            rows = rows.where(F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS))
        hist = rows.groupBy("source", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count_distinct("h").alias("hashes") if level >= 2 else F.count("*").alias("hashes"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        edge = (
            hist.withColumn("upto", upto)
            .where(F.col("upto") > F.col("left"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "words", "hashes", "left")).alias("e"))
            .select(
                F.col("source").alias("s"),
                F.shiftleft("e.bucket", shift).alias("at"),
                (F.col("e.left") - (F.col("e.upto") - F.col("e.words"))).alias("rest"),
                F.col("e.words").alias("words"),
                (F.col("e.hashes") == 1).alias("single"),
            )
        )
        last = level == LEVELS - 1
        nearer = F.col("words") - F.col("rest") < F.col("rest")  # taking the boundary hash too is nearer
        step = (
            cut.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
            .select(
                "source",
                F.when(F.col("done"), F.col("low"))
                .when(F.col("at").isNull(), F.lit(1 << 60))  # the budget is never reached: everything is taken
                .when(F.col("single") | F.lit(last), F.col("at") + F.when(nearer, F.lit(1 << shift)).otherwise(F.lit(0)))
                .otherwise(F.col("at"))
                .alias("low"),
                F.coalesce("rest", "left").alias("left"),
                (F.col("done") | F.col("at").isNull() | F.col("single")).alias("done"),
            )
        )
        cut = stage(step, f"mix_cut_{level}")
        if cut.where(~F.col("done")).isEmpty():
            break
    return cut.select(F.col("source").alias("s"), F.col("low").alias("cut"))


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> tuple[DataFrame, DataFrame]:
    """(sized, per_source): sized has doc_id, source, size, h for every row; per_source has s, source_size, target, once, cut."""
    sized = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h")), "mix_sized")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    second = F.col("target") > F.col("source_size")
    goals = stage(goals.withColumn("once", F.when(second, 1).otherwise(0)).withColumn("budget", F.col("target") - F.when(second, F.col("source_size")).otherwise(F.lit(0))), "mix_goals")
    cuts = thresholds(sized, goals)
    per_source = goals.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "once", "cut")
    return sized, stage(per_source, "mix_per_source")


def _copies(h: Column) -> Column:
    return F.col("once") + F.when(h < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source)."""
    sized, per_source = plan(docs, **how)
    out = sized.join(per_source, F.col("source").eqNullSafe(F.col("s")))
    copies = _copies(F.col("h"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs with each row as often as it's taken. Rows stay where they are; only the table of sources is sent to them."""
    _, per_source = plan(docs, **how)
    own = {c: free_name(f"_mix_{c}", docs.columns) for c in (*per_source.columns, "copy")}
    per_source = per_source.select(*(F.col(c).alias(own[c]) for c in per_source.columns))
    rows = docs.join(per_source, F.col("source").eqNullSafe(F.col(own["s"])))
    copies = F.col(own["once"]) + F.when(hash60(F.col("doc_id"), F.col("text")) < F.col(own["cut"]), 1).otherwise(0)
    return rows.withColumn(own["copy"], F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(copies > 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_OP4 = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15)) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s),
p AS (
  SELECT *, coalesce(sum(source_size) OVER b, 0) * 2.0::DOUBLE AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM w WINDOW b AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - capped) / left_weight AS level FROM p),
o AS (SELECT *, level * weight > source_size * 2.0::DOUBLE AS is_over FROM l),
t AS (
  SELECT source, source_size, CASE WHEN is_over THEN source_size * 2.0::DOUBLE ELSE (SELECT arg_min(level, (source_size / weight, rank)) FROM o WHERE NOT is_over) * weight END AS target FROM o),
g AS (SELECT *, CASE WHEN target > source_size THEN 1 ELSE 0 END AS once, target - CASE WHEN target > source_size THEN source_size ELSE 0 END AS budget FROM t),
k AS (
  SELECT d.*, g.source_size, g.target, g.once, g.budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
m AS (
  SELECT *, CASE WHEN upto <= budget THEN 1 WHEN upto - own <= budget AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END AS again FROM k)
SELECT doc_id, size, source_size, target, size * (once + again) AS taken FROM m
"""
