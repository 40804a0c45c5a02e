"""The finer entries of the inventory, one query each."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratamill.functions.expr import Expression, Policy, columns, feasible
from stratamill.operators import curves, evaluate, exact, holdout, neighbourhood, pareto, pbo, rows
from stratamill.operators import dsr as dsr_
from stratamill.operators.ranks import below
from stratamill.plans import continuation, ordinals, parzen, samplers
from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space
from stratamill.plans.study import Study, write_trials
from stratamill.plans.tpe import Tpe, weighted
from stratamill.queries import AXES, BLOCKS, BRAND_LIST, CURVE, EMITTED, EVAL_SPACE, EVERY_HOUR, HOLDOUT, HOURLY, NBH, PART_SPACE, POOL, SIGNALS, RETURNS, SELECTION, SOBOL_SPACE, START, STATS, STUDIES, STUDY, TRIALS_SQL, WALK, _emitted, _moments, _nbh, _part_ids, _sobol_sql, _two, events, every_hour, hourly, query, r, studies, t, trials, user_curve
from stratamill.sources import bars as bars_
from stratamill.sources import trials as trial_files
from stratamill.storage import folder, cut_lineage
from stratamill.streaming import emission

# ---- Sources and sinks -------------------------------------------------------


def _scratch(spark, name: str) -> str:
    return f"{folder(spark)}/stratamill/{uuid.uuid4().hex}/{name}"


def _parts(spark, sf_dir):
    """The parts, dealt over all cores by their keys: their file may be one task's, and Python goes on with each row."""
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return t(spark, sf_dir, "part").repartition(cores, "p_partkey")


@query(f"WITH {EVERY_HOUR} SELECT timestamp, open, high, low, close, volume FROM b")
def src1_csv_scan(spark, sf_dir):
    path = _scratch(spark, "bars.csv")
    every_hour(spark, sf_dir).write.option("header", True).csv(path)
    return bars_.read_csv(spark, path)


@query(f"WITH {TRIALS_SQL} SELECT trial_id, status, feasible, objective, CAST(size AS DOUBLE) AS size FROM tr")
def src9_trial_lines(spark, sf_dir):
    path = _scratch(spark, "trials")
    tr = trials(spark, sf_dir)
    write_trials(tr.select("trial_id", "status", "feasible", "objective", F.struct("size").alias("metrics"), F.struct("size", "brand").alias("parameters")), path)
    return trial_files.read_lines(spark, path).select("trial_id", "status", "feasible", "objective", F.col("metrics")["size"].alias("size"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS trial_id, CAST(p_size AS BIGINT) AS size, p_brand AS brand FROM part")
def src16_candidate_list(spark, sf_dir):
    """The parts' vectors as lists of lines, in the order of their keys."""
    path = _scratch(spark, "candidates")
    trial_files.write_candidates(trials(spark, sf_dir).select("trial_id", "size", "brand"), "trial_id", path)
    return trial_files.read_candidates(spark, path + "/*.json", PART_SPACE)


@query(f"""WITH {TRIALS_SQL}, g AS (SELECT brand AS source, count(DISTINCT CASE WHEN size = 7 THEN 'b' ELSE 'a' END) AS k FROM tr GROUP BY 1) SELECT source, k = 1 AS common FROM g""")
def src13_common_space(spark, sf_dir):
    """Each brand as a source, whose space is another one for size 7."""
    return trial_files.common_spaces(trials(spark, sf_dir).select(F.col("brand").alias("source"), F.when(F.col("size") == 7, "b").otherwise("a").alias("space_hash"))).select("source", "common")


@query("SELECT p_partkey AS trial_id FROM part WHERE p_size = 8")
def src18_sobol_parent(spark, sf_dir):
    """A parent study with a trial for each part, of which those of size 8 aren't what its generator makes."""
    ids = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"), "p_size")
    parent = samplers.sobol_at(ids, SOBOL_SPACE, 3).withColumn("a", F.when(F.col("p_size") == 8, F.pmod(F.col("a") + 1, F.lit(1000))).otherwise(F.col("a")))
    return samplers.admit_sobol(spark, SOBOL_SPACE, parent, seed=3).select("trial_id")


@query(f"WITH {TRIALS_SQL} SELECT trial_id, status, objective FROM tr")
def snk2_trial_lines(spark, sf_dir):
    path = _scratch(spark, "lines")
    write_trials(trials(spark, sf_dir).select("trial_id", "status", "objective"), path)
    return spark.read.schema("trial_id bigint, status string, objective double").json(path)


# ---- Expressions -------------------------------------------------------------


def _value(spark, sf_dir, text, policy=Policy(), **extra):
    tr = trials(spark, sf_dir).withColumns(extra)
    value, error = Expression(text).compile(columns(tr.columns), policy)
    return tr.select("trial_id", r(value).alias("value"), error.alias("error"))


@query(f"WITH {TRIALS_SQL} SELECT trial_id, round(-(price - 3.5) * 2 + abs(size - 25) / 4.0, 6) AS value, NULL::VARCHAR AS error FROM tr")
def exp1_arithmetic(spark, sf_dir):
    return _value(spark, sf_dir, "-(price - 3.5) * 2 + abs(size - 25) / 4")


@query(f"WITH {TRIALS_SQL} SELECT trial_id, CASE WHEN size % 3 <> 0 THEN round(price + 1, 6) END AS value, CASE WHEN size % 3 = 0 THEN 'missing_metric' END AS error FROM tr")
def exp3_missing_metric(spark, sf_dir):
    return _value(spark, sf_dir, "seldom + 1", seldom=F.when(F.col("size") % 3 != 0, F.col("price")))


@query(f"WITH {TRIALS_SQL} SELECT trial_id, CASE WHEN size % 4 = 0 THEN 'nan' ELSE CAST(CAST(floor(least(price, 1200)) AS INT) AS VARCHAR) END AS least FROM tr")
def exp6_min_max(spark, sf_dir):
    tr = trials(spark, sf_dir).withColumn("x", F.when(F.col("size") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("price")))
    value, _ = Expression("min(x, 1200)").compile(columns(tr.columns), Policy(False, False))
    return tr.select("trial_id", F.when(F.isnan(value), "nan").otherwise(F.floor(value).cast("int").cast("string")).alias("least"))


@query("SELECT DISTINCT p_name AS name, p_type AS type, array_to_string(list_distinct_in_order, ',') AS identifiers FROM (SELECT p_name, p_type, [x FOR x, i IN w IF list_position(w, x) = i] AS list_distinct_in_order FROM (SELECT p_name, p_type, list_concat(string_split(lower(p_name), ' '), [lower(p_type), string_split(lower(p_name), ' ')[1]]) AS w FROM part))")
def exp8_identifiers(spark, sf_dir):
    """What an expression of a part's words asks for, in the order in which it is first asked."""

    @F.pandas_udf("string")
    def asked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: ",".join(Expression(x).identifiers))

    words = F.split(F.lower("p_name"), " ")
    kinds = t(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    text = F.concat(words[0], F.lit(" + max("), words[1], F.lit(", "), F.lower("p_type"), F.lit(") / "), words[0])
    return kinds.select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), asked(text).alias("identifiers"))


@query(f"WITH {TRIALS_SQL} SELECT trial_id, objective IS NOT NULL AND size >= 5 AND price <= 1500 AS feasible FROM tr")
def exp11_feasible(spark, sf_dir):
    tr = trials(spark, sf_dir)
    m = columns(tr.columns)
    return tr.select("trial_id", feasible(Expression("objective").compile(m), [Expression(x).compile(m) for x in ("size >= 5", "price <= 1500")]).alias("feasible"))


@query(f"WITH {TRIALS_SQL} SELECT trial_id, round(price * 2, 6) AS value, NULL::VARCHAR AS error FROM tr")
def exp12_report_aliases(spark, sf_dir):
    return _value(spark, sf_dir, "report.net_profit + net_profit", net_profit=F.col("price"))


@query(f"WITH {TRIALS_SQL} SELECT 'status_' || status AS reason, count(*) AS n, min(trial_id) AS first_id, max(trial_id) AS last_id FROM tr WHERE status <> 'ok' GROUP BY 1")
def exp14_exclusion_report(spark, sf_dir):
    return rows.exclusions(trials(spark, sf_dir), rows.exclusion([]))


# ---- Spaces and samplers -----------------------------------------------------


@query("SELECT DISTINCT CAST(p_size AS BIGINT) AS size, CAST(p_size + 1 AS BIGINT) AS stepped, CAST(p_size // 2 + 1 AS BIGINT) AS whole FROM part")
def spc3_stepped_counts(spark, sf_dir):
    """Values from 0 to a tenth of each size by tenths, and to the size by twos."""

    def counted(make):
        return F.pandas_udf(lambda s: s.map(lambda n: make(int(n)).count), "bigint")

    sizes = trials(spark, sf_dir).select("size").distinct()
    return sizes.select("size", counted(lambda n: Real("x", 0.0, n / 10, 0.1))(F.col("size")).alias("stepped"), counted(lambda n: Integer("x", 0, n, 2))(F.col("size")).alias("whole"))


@query("SELECT p_partkey AS trial_id, 5 * (range // 6) - 10 AS a, ['x','y'][1 + (range // 3) % 2] AS b, range % 3 + 7 AS c FROM (SELECT p_partkey, p_partkey % 30 AS range FROM part)")
def spc4_decode(spark, sf_dir):
    space = Space((Integer("a", -10, 10, 5), Categorical("b", ("x", "y")), Integer("c", 7, 9)))
    return space.decode(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"), (F.col("p_partkey") % 30).alias("ordinal"))).drop("ordinal")


@query(f"""WITH {TRIALS_SQL} SELECT trial_id, '{{"brand":["string","' || brand || '"],"size":["integer","' || size || '"]}}' AS key FROM tr""")
def spc9_vector_keys(spark, sf_dir):
    return trials(spark, sf_dir).select("trial_id", PART_SPACE.vector_key_column().alias("key"))


def _split_mix_sql(x: str) -> str:
    """SplitMix64 of a UHUGEINT below 2**64, from its published definition."""
    word = "18446744073709551616::UHUGEINT"
    x = f"(({x} + 11400714819323198485::UHUGEINT) % {word})"
    x = f"((xor({x}, {x} >> 30) * 13787848793156543929::UHUGEINT) % {word})"
    x = f"((xor({x}, {x} >> 27) * 10723151780598845931::UHUGEINT) % {word})"
    return f"xor({x}, {x} >> 31)"


@query(f"SELECT CAST(range AS INT) AS seed, lpad(lower(hex(CAST({_split_mix_sql('((range::UHUGEINT + 3::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)')} AS UBIGINT))), 16, '0') AS word FROM (SELECT p_partkey AS range FROM part)")
def smp5_digital_shift(spark, sf_dir):
    """The fourth column's shift, with each part's key for a seed."""

    @F.pandas_udf("string")
    def shift(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda s: f"{samplers.shift_word(int(s), 3):016x}")

    return _parts(spark, sf_dir).select(F.col("p_partkey").cast("int").alias("seed"), shift("p_partkey").alias("word"))


@query(f"""WITH w AS (SELECT range AS trial_id, {_sobol_sql(0, 25)} AS w0, {_sobol_sql(1, 25)} AS w1 FROM (SELECT p_partkey AS range FROM part))
SELECT trial_id, CAST(least(greatest(floor(1 + 0.5 * (exp(ln(1 + 100 / 0.5) * (CAST(w0 >> 11 AS DOUBLE) * pow(2.0, -53))) - 1)), 1), 100) AS BIGINT) AS n, round(0.001 * exp(ln(1 + (10 - 0.001) / 0.001) * (CAST(w1 >> 11 AS DOUBLE) * pow(2.0, -53))), 6) AS x FROM w""")
def smp6_log_mapping(spark, sf_dir):
    space = Space((Integer("n", 1, 100, log=True), Real("x", 0.001, 10.0, log=True)))
    return samplers.sobol_at(_part_ids(spark, sf_dir), space).withColumn("x", r(F.col("x")))


@query("""WITH i AS (SELECT CAST(year(o_orderdate) - 1995 AS INT) AS part, o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY year(o_orderdate)) AS z FROM orders),
d AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS k FROM i), n AS (SELECT part, count(*) AS n FROM i GROUP BY 1), s AS (SELECT part, n, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
x AS (SELECT d.part, before + k AS trial_id FROM d JOIN s USING (part) WHERE NOT (d.part = 3 AND k = 5)),
p AS (SELECT part, count(*) AS terminal_trials, max(trial_id) AS high FROM x GROUP BY 1)
SELECT part, CAST(coalesce(max(high) OVER w + 1, 0) AS BIGINT) AS first_index, CAST(high + 1 AS BIGINT) AS next_index, terminal_trials, part < 3 AS exact_stream FROM p WINDOW w AS (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def smp7_sobol_continuation(spark, sf_dir):
    """The orders of each year as a part that goes on after the years before; the fourth part lacks one of its trials."""
    o = t(spark, sf_dir, "orders").select((F.year("o_orderdate") - 1995).alias("part"), "o_orderkey")
    ids = below(o, "o_orderkey", ["part"]).select("part", F.col("before").alias("k"))
    before = ids.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    rows_ = ids.join(F.broadcast(before), "part").where(~((F.col("part") == 3) & (F.col("k") == 5)))
    return samplers.parts(rows_.select("part", (F.col("start") + F.col("k")).alias("trial_id")))


@query(f"""WITH {TRIALS_SQL}, k AS (SELECT trial_id, row_number() OVER (ORDER BY trial_id) AS rn, count(*) OVER () AS n FROM tr WHERE status = 'ok')
SELECT trial_id, round(CASE WHEN n < 25 OR rn > n - 25 THEN 1.0 ELSE 1.0 / n + (rn - 1) * (1 - 1.0 / n) / (n - 26) END, 9)::DOUBLE AS weight FROM k""")
def smp10_weights(spark, sf_dir):
    return weighted(trials(spark, sf_dir).where("status = 'ok'").select("trial_id")).select("trial_id", r(F.col("weight"), 9).alias("weight"))


LONG_SPACE = Space((Real("price", 0.0, 200_000.0), Integer("quantity", 1, 50)))
NORMALS = """h AS (SELECT 9 * l_orderkey + l_linenumber AS id, any_value(l_discount * l_extendedprice) AS objective, any_value(l_extendedprice) AS price, any_value(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY 1 HAVING count(*) = 1),
bd AS (SELECT * FROM h QUALIFY row_number() OVER (ORDER BY objective DESC, id) > 25), wt AS (SELECT *, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS m FROM bd),
wx AS (SELECT *, CASE WHEN m < 25 OR rn > m - 25 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / m + (rn - 1) * (1 - 1.0::DOUBLE / m) / (m - 26) END AS w FROM wt),
ax AS (SELECT id, w, 'price' AS dimension, price / 200000.0::DOUBLE AS x FROM wx UNION ALL SELECT id, w, 'quantity', (quantity - 0.5::DOUBLE) / 50 FROM wx),
pl AS (SELECT dimension, x, count(*) AS n, arg_min(w, id) AS f, arg_max(w, id) AS l, sum(w) AS s FROM ax GROUP BY 1, 2),
gp AS (SELECT *, x - lag(x) OVER o AS lo, lead(x) OVER o - x AS hi, sum(n) OVER (PARTITION BY dimension) AS tot FROM pl WINDOW o AS (PARTITION BY dimension ORDER BY x)),
en AS (SELECT *, coalesce(lo, CASE WHEN n > 1 THEN 0 END, hi) AS low, coalesce(hi, CASE WHEN n > 1 THEN 0 END, lo) AS high FROM gp),
nm AS (SELECT dimension, x AS mean, tot, unnest(CASE WHEN n = 1 THEN [{'g': greatest(low, high), 'w': f}] ELSE [{'g': low, 'w': f}, {'g': 0.0::DOUBLE, 'w': CASE WHEN n > 2 THEN s - f - l ELSE 0 END}, {'g': high, 'w': l}] END) AS p FROM en),
nr AS (SELECT dimension, mean, least(greatest(p.g, 1.0::DOUBLE / least(100, tot + 2)), 1.0::DOUBLE) AS sigma, p.w AS weight FROM nm WHERE p.w > 0)"""


def _long(spark, sf_dir):
    """Each line of an order as an observation; lines that share their number are left out, as ids are unique."""
    return t(spark, sf_dir, "lineitem").groupBy((9 * F.col("l_orderkey") + F.col("l_linenumber")).alias("trial_id")).agg(
        F.count("*").alias("n"), F.max(F.col("l_discount") * F.col("l_extendedprice")).alias("objective"), F.max("l_extendedprice").alias("price"), F.max(F.col("l_quantity").cast("bigint")).alias("quantity")
    ).where("n = 1").drop("n")


@query(f"WITH {NORMALS} SELECT dimension, round(mean, 9) AS mean, round(sigma, 9) AS sigma, round(weight, 6) AS weight FROM nr")
def smp11_parzen_widths(spark, sf_dir):
    """The normals of all lines but the good ones."""
    found = parzen.bad_normals(_long(spark, sf_dir), LONG_SPACE)
    return found.select("dimension", r(F.col("mean"), 9).alias("mean"), r(F.col("sigma"), 9).alias("sigma"), r(F.col("weight")).alias("weight"))


def _between(a: str, b: str) -> str:
    """Normal mass between two places; beyond 8 none is left."""
    from stratamill.queries import _phi_sql

    return f"({_phi_sql(f'least(8.0, greatest(-8.0, {b}))')} - {_phi_sql(f'least(8.0, greatest(-8.0, {a}))')})"


@query(f"""WITH {NORMALS}, ins AS (SELECT *, {_between('-mean / sigma', '(1 - mean) / sigma')} AS inside FROM nr UNION ALL SELECT DISTINCT dimension, 0.5, 1.0, 1.0, {_between('-0.5::DOUBLE', '0.5::DOUBLE')} FROM nr),
tw AS (SELECT dimension, sum(weight) AS total FROM ins GROUP BY 1),
dn AS (SELECT 'price' AS dimension, CAST(k AS INT) AS point, sum(weight / sigma / sqrt(2 * pi()) * exp(-0.5 * pow((k / 40.0::DOUBLE - mean) / sigma, 2)) / inside) AS v FROM ins, range(41) t(k) WHERE dimension = 'price' GROUP BY 1, 2),
mq AS (SELECT mean, sigma, sum(weight) AS weight, any_value(inside) AS inside FROM ins WHERE dimension = 'quantity' GROUP BY 1, 2),
ms AS (SELECT 'quantity' AS dimension, CAST(pt AS INT) AS point, sum(weight * {_between('(pt / 50.0::DOUBLE - mean) / sigma', '((pt + 1) / 50.0::DOUBLE - mean) / sigma')} / inside) AS v FROM mq, range(50) t(pt) GROUP BY 1, 2)
SELECT dimension, point, round(ln(v / total), 6) AS ln FROM (SELECT * FROM dn UNION ALL SELECT * FROM ms) JOIN tw USING (dimension)""")
def smp12_full_history(spark, sf_dir):
    """The model of all lines but the good ones: ln density at 41 prices, ln mass of each quantity."""
    quantity = np.array([(k / 50, (k + 1) / 50) for k in range(50)])
    found = parzen.log_densities(parzen.bad_normals(_long(spark, sf_dir), LONG_SPACE), {"price": np.arange(41) / 40, "quantity": quantity})
    return spark.createDataFrame([(d, i, round(float(v), 6)) for d, x in found.items() for i, v in enumerate(x)], "dimension string, point int, ln double")


@query(f"WITH {TRIALS_SQL}, g AS (SELECT range AS ordinal, 1 + range // 25 AS size, 'Brand#' || (1 + range % 25) AS brand FROM range(1250)) SELECT ordinal FROM g ANTI JOIN tr USING (size, brand) ORDER BY 1 LIMIT 20")
def smp16_lowest_untried(spark, sf_dir):
    return spark.createDataFrame([(o,) for o in continuation.lowest_untried(spark, PART_SPACE, trials(spark, sf_dir), 20)], "ordinal bigint")


LINES_TRIED = "WITH o AS (SELECT DISTINCT 9 * l_orderkey + l_linenumber AS ordinal FROM lineitem)"


@query(f"{LINES_TRIED} SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS rank FROM o")
def smp16_ordinal_ranks(spark, sf_dir):
    """How many tried ordinals are below each: bitmaps of two halves, merged."""
    o = t(spark, sf_dir, "lineitem").select((9 * F.col("l_orderkey") + F.col("l_linenumber")).alias("ordinal"))
    tried = cut_lineage(ordinals.union(ordinals.build(o.where("ordinal % 2 = 0")), ordinals.build(o.where("ordinal % 2 = 1"))))
    return ordinals.ranks(tried, o.distinct())


@query(f"{LINES_TRIED}, m AS (SELECT max(ordinal) + 1 AS n FROM o) SELECT range AS ordinal FROM range((SELECT n FROM m)) r ANTI JOIN o ON o.ordinal = r.range ORDER BY 1 LIMIT 500")
def smp16_lowest_unset(spark, sf_dir):
    o = t(spark, sf_dir, "lineitem").select((9 * F.col("l_orderkey") + F.col("l_linenumber")).alias("ordinal"))
    tried = cut_lineage(ordinals.build(o))
    return spark.createDataFrame([(x,) for x in ordinals.lowest_unset(spark, tried, o.agg(F.max("ordinal")).first()[0] + 1, 500)], "ordinal bigint")


@query(None)
def smp8_parzen_study(spark, sf_dir):
    b = evaluate.bars_of(every_hour(spark, sf_dir), ("timestamp", "close"))
    found, _ = STUDY.run_adaptive(spark, Tpe(EVAL_SPACE, 1), b, evaluate.threshold, 24, batch=12)
    return spark.createDataFrame([(x["trial_id"], x["entry"], x["exit"], x["objective"]) for x in found], "trial_id bigint, entry bigint, exit bigint, objective double")


@query(f"WITH {TRIALS_SQL}, g AS (SELECT 1 + range // 25 AS size, 'Brand#' || (1 + range % 25) AS brand FROM range(1250)) SELECT size, brand, TRUE AS later FROM g ANTI JOIN tr USING (size, brand)")
def smp23_random_continuation(spark, sf_dir):
    """More is asked than is left, so all of it comes, with ids after those of the history."""
    history = trials(spark, sf_dir)
    last = history.agg(F.max("trial_id")).first()[0]
    return continuation.continued_random(spark, PART_SPACE, history, 5, 2000).select("size", "brand", (F.col("trial_id") > last).alias("later"))


# ---- Evaluation --------------------------------------------------------------


@query(f"WITH {HOURLY}, n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1) SELECT symbol, CAST(unnest(list_sort(list_distinct([greatest(1, CAST(ceil(0.1 * n) AS BIGINT)), CAST(ceil(0.5 * n) AS BIGINT), n]))) AS BIGINT) AS bars FROM n")
def evl3_prefixes(spark, sf_dir):
    """Rungs of each symbol's bars; two fractions may ask for the same prefix."""
    rungs = F.udf(lambda n: evaluate.rungs([0.1, 0.1 + 1e-12, 0.5], n), "array<bigint>")  # a row for each symbol
    n = hourly(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    return n.select("symbol", F.explode(rungs("n")).alias("bars"))


SCORES = STUDIES + """, x AS (SELECT window AS rung, trial_id, value AS score, row_number() OVER (PARTITION BY window ORDER BY trial_id DESC) AS recent FROM s WHERE reason IS NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY score DESC, trial_id) AS place, count(*) OVER (PARTITION BY rung) AS n FROM x WHERE recent <= 1024), ct AS (SELECT rung, score AS cut FROM y WHERE place = ceil(n / 3.0))"""


@query(f"WITH {SCORES} SELECT rung, trial_id, score FROM x LEFT JOIN ct USING (rung) WHERE cut IS NULL OR score >= cut")
def evl5_survivors(spark, sf_dir):
    h = studies(spark, sf_dir).where("reason is null").select(F.col("window").alias("rung"), "trial_id", F.col("value").alias("score"))
    return evaluate.survivors(h, evaluate.cut(h, 3)).select("rung", "trial_id", "score")


@query("SELECT range AS trial_id, CASE WHEN 5 + range // 3 <= 4 + 2 * (range % 3) THEN 'trial_error' ELSE 'ok' END AS status FROM range(9)")
def evl6_status_taxonomy(spark, sf_dir):
    space = Space((Integer("entry", 5, 7), Integer("exit", 4, 8, 2)))
    b = evaluate.bars_of(every_hour(spark, sf_dir), ("timestamp", "close"))
    return Study(space, "net_profit", evaluate.THRESHOLD_METRICS).run(space.grid(spark), b, evaluate.threshold).select("trial_id", "status")


@query(f"""WITH {HOURLY}, c AS (SELECT *, timestamp // 14400000 AS bucket, timestamp < {START} AS before FROM b WHERE timestamp >= {START - 5 * 86_400_000} AND timestamp < {START + 5 * 86_400_000}),
g AS (SELECT symbol, bucket, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS k FROM (SELECT DISTINCT symbol, bucket FROM c WHERE before)), f AS (SELECT symbol, min(bucket) AS first_bucket FROM g WHERE k <= 12 GROUP BY 1),
q AS (SELECT c.* FROM c LEFT JOIN f USING (symbol) WHERE NOT before OR bucket >= first_bucket), n AS (SELECT symbol, count(*) AS fed, row_number() OVER (ORDER BY symbol) AS i FROM q GROUP BY 1)
SELECT symbol, CASE i WHEN 2 THEN 'sum' WHEN 3 THEN 'first' WHEN 4 THEN 'last' END AS broken FROM n""")
def evl11_plan_identities(spark, sf_dir):
    """Plans of the symbols, of which some were spoilt: a bar more than its parts, a first bar before the floor, a last one at the end."""
    start, day = START, 86_400_000
    p = bars_.window_plan(hourly(spark, sf_dir), ["symbol"], start, start + 5 * day, start - 5 * day, 4 * 3_600_000, 12)
    i = F.row_number().over(Window.orderBy("symbol"))  # a row for each symbol
    p = p.withColumn("_i", i).withColumns({
        "fed_bars": F.when(F.col("_i") == 2, F.col("fed_bars") + 1).otherwise(F.col("fed_bars")), "first_ts": F.when(F.col("_i") == 3, start - 6 * day).otherwise(F.col("first_ts")),
        "last_ts": F.when(F.col("_i") == 4, start + 5 * day).otherwise(F.col("last_ts")),
    })
    return p.select("symbol", bars_.plan_defect(start - 5 * day, start + 5 * day).alias("broken"))


@query(f"WITH {HOURLY} SELECT symbol, CASE symbol WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS dataset_id, sum(volume) AS volume FROM b GROUP BY 1, 2")
def evl13_symbol_routing(spark, sf_dir):
    bound = spark.createDataFrame([("click", 1), ("view", 2)], "choice string, dataset_id int")
    return evaluate.routed(hourly(spark, sf_dir), bound, "symbol").groupBy("symbol", "dataset_id").agg(F.sum("volume").alias("volume"))


PREFIXED = SIGNALS + """, no AS (SELECT trial_id, entry, exit, timestamp, equity - 1000 AS net, row_number() OVER (PARTITION BY trial_id ORDER BY timestamp) AS i FROM q),
nb AS (SELECT max(i) AS n, CAST(ceil(0.25 * max(i)) AS BIGINT) AS a, CAST(ceil(0.5 * max(i)) AS BIGINT) AS b FROM no),
r0 AS (SELECT trial_id, entry, exit, round(net, 6) AS net, i, row_number() OVER (ORDER BY round(net, 6) DESC, trial_id) AS place, count(*) OVER () AS m FROM no, nb WHERE i = a), c0 AS (SELECT net AS cut FROM r0 WHERE place = ceil(m / 3.0)),
r1 AS (SELECT no.trial_id, no.entry, no.exit, round(no.net, 6) AS net, no.i, row_number() OVER (ORDER BY round(no.net, 6) DESC, no.trial_id) AS place, count(*) OVER () AS m FROM no, nb, c0, r0 WHERE no.i = b AND r0.trial_id = no.trial_id AND r0.net >= cut), c1 AS (SELECT net AS cut FROM r1 WHERE place = ceil(m / 3.0)),
r2 AS (SELECT no.trial_id, no.entry, no.exit, round(no.net, 6) AS net, no.i FROM no, nb, c1, r1 WHERE no.i = n AND r1.trial_id = no.trial_id AND r1.net >= cut)"""


@query(f"""WITH {PREFIXED} SELECT trial_id, entry, exit, net AS objective, CAST(0 AS INT) AS rung, CAST(i AS INT) AS bars_processed, TRUE AS pruned FROM r0, c0 WHERE net < cut
UNION ALL SELECT trial_id, entry, exit, net, 1, CAST(i AS INT), TRUE FROM r1, c1 WHERE net < cut UNION ALL SELECT trial_id, entry, exit, net, 2, CAST(i AS INT), FALSE FROM r2""")
def evl4_successive_halving(spark, sf_dir):
    b = evaluate.bars_of(every_hour(spark, sf_dir), ("timestamp", "close"))
    out = evaluate.halving(EVAL_SPACE.grid(spark), b, evaluate.threshold, ("net_profit",), lambda d: F.round(F.col("metrics")["net_profit"], 6), [0.25, 0.5], 3)
    return out.select("trial_id", "entry", "exit", "objective", "rung", "bars_processed", "pruned")


# ---- Curves ------------------------------------------------------------------


@query(f"WITH {CURVE}{RETURNS}, a AS (SELECT key, count(*) AS points, (max(time_ms) - min(time_ms)) / 31557600000.0::DOUBLE AS span FROM c GROUP BY 1) SELECT key, points, round((points - 1) / span, 6) AS periods FROM a WHERE points >= 3 AND span > 0")
def agg3_periods_per_year(spark, sf_dir):
    return curves.periods_per_year(user_curve(spark, sf_dir)).where("periods is not null").select("key", "points", r(F.col("periods")).alias("periods"))


@query(f"WITH {CURVE}, b AS (SELECT key, idx, time_ms, equity - 990 AS equity FROM c), p AS (SELECT *, lag(equity) OVER (PARTITION BY key ORDER BY idx) AS prior FROM b), n AS (SELECT key, sum((prior > 0)::INT) AS n, sum((prior <= 0)::INT) AS skipped FROM p WHERE idx > 0 GROUP BY 1) SELECT key, CAST(n AS BIGINT) AS count, CAST(skipped AS BIGINT) AS skipped, CAST(CASE WHEN n < 4 THEN 1 ELSE 0 END AS INT) AS status FROM n")
def agg5_statuses(spark, sf_dir):
    c = user_curve(spark, sf_dir).withColumn("equity", F.col("equity") - 990)
    return curves.return_stats(c).select("key", "count", "skipped", "status")


@query(f"WITH {CURVE} SELECT key, CAST(CASE WHEN key % 10 = 3 THEN 4 ELSE 0 END AS INT) AS status, CAST(CASE WHEN key % 10 = 3 THEN 4 ELSE 7 END AS INT) AS monthly_status FROM c GROUP BY 1")
def agg6_non_finite(spark, sf_dir):
    """A curve with one value that isn't finite, and months of a chart outside UTC: the first cause is told."""
    c = cut_lineage(user_curve(spark, sf_dir).withColumn("equity", F.when((F.col("key") % 10 == 3) & (F.col("idx") == 2), F.lit(float("nan"))).otherwise(F.col("equity"))))
    months = curves.return_stats(c, monthly=True, utc=False).select("key", F.col("status").alias("monthly_status"))
    return curves.return_stats(c).select("key", "status").join(months, "key")


@query(f"WITH {CURVE}, k AS (SELECT key, count(*) - 1 AS k FROM c GROUP BY 1), b AS (SELECT key, k, unnest([0, 1, 2, 3, 4, 5]) AS block FROM k WHERE k >= 6) SELECT key, CAST(block AS INT) AS block, CAST(ceil(block * k / 6) AS BIGINT) AS first_interval, CAST(ceil((block + 1) * k / 6) - ceil(block * k / 6) AS BIGINT) AS n FROM b")
def agg7_block_layout(spark, sf_dir):
    return curves.block_layout(user_curve(spark, sf_dir), 6)


@query(f"WITH {CURVE}, k AS (SELECT key, count(*) AS k FROM c GROUP BY 1), f AS (SELECT arg_min(k, key) AS own FROM k) SELECT key FROM k, f WHERE k <> own")
def agg9_layout_agreement(spark, sf_dir):
    return curves.layout_disagreements(curves.block_layout(user_curve(spark, sf_dir), 6))


# ---- Analyses ----------------------------------------------------------------


@query(f"WITH {TRIALS_SQL}, ok AS (SELECT * FROM tr WHERE status = 'ok') SELECT count(DISTINCT (price, size)) AS vectors, count(*) AS trials FROM ok x WHERE NOT EXISTS (SELECT 1 FROM ok y WHERE y.price >= x.price AND y.size <= x.size AND (y.price > x.price OR y.size < x.size))")
def par4_front_vectors(spark, sf_dir):
    return pareto.front(trials(spark, sf_dir).where("status = 'ok'"), AXES).agg(F.count_distinct("price", "size").alias("vectors"), F.count("*").alias("trials"))


@query(f"""WITH {TRIALS_SQL}, d AS (SELECT sha256('{{"trial_id":' || trial_id || ',"status":"' || status || '","size":' || size || ',"brand":"' || brand || '"}}') AS d FROM tr),
x AS (SELECT d[1:2] AS b, d[3:5] AS c, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM d GROUP BY 1, 2), y AS (SELECT b, sha256(string_agg(d, '' ORDER BY c)) AS d, sum(n) AS n FROM x GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM y""")
def par5_input_digest(spark, sf_dir):
    return pareto.input_digest(trials(spark, sf_dir), ["trial_id", "status", "size", "brand"])


@query(f"WITH {TRIALS_SQL}, n AS (SELECT count(*) AS n FROM tr) SELECT n AS rows, CAST(n + n * (n - 1) // 2 AS BIGINT) AS work FROM n")
def par6_work_figure(spark, sf_dir):
    n = trials(spark, sf_dir).count()
    return spark.createDataFrame([(n, pareto.work(n))], "rows bigint, work bigint")


@query(f"""WITH {TRIALS_SQL}, x AS (SELECT trial_id AS key, CASE WHEN size = 13 THEN 'pbo_input_invalid' WHEN trial_id % 5 = 0 THEN 'pbo_roster_mismatch' WHEN status = 'engine_error' THEN 'pbo_status_error' WHEN status = 'pruned' THEN 'pbo_status_pruned'
WHEN size % 10 = 4 THEN 'pbo_non_positive_equity' WHEN size % 10 = 6 THEN 'pbo_rows_incomplete' WHEN size % 2 = 1 THEN 'pbo_block_mismatch' END AS defect FROM tr) SELECT * FROM x WHERE defect IS NOT NULL""")
def pbo1_roster_admission(spark, sf_dir):
    size = F.col("size")
    tr = trials(spark, sf_dir).select(
        F.col("trial_id").alias("key"), F.when(size != 13, F.col("status")).alias("status"), F.when(size % 10 == 6, None).when(size % 2 == 1, 3).otherwise(4).alias("n_blocks"), F.when(size % 10 == 4, 2).otherwise(0).alias("block_status")
    )
    return pbo.roster_defects(tr, tr.where("key % 5 != 0").select("key"), 4)


POOLED = CURVE + BLOCKS + """, sp AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS block), mo AS (SELECT bm.key, ret.r FROM bm JOIN sp USING (block) JOIN y ret ON ret.key = bm.key AND ret.block = bm.block),
po AS (SELECT key, avg(r) AS m, stddev_samp(r) AS sd FROM mo GROUP BY 1)"""


@query(f"WITH {POOLED} SELECT key, round(m / sd, 9) AS stat FROM po")
def pbo4_ranking_statistic(spark, sf_dir):
    moments = curves.block_moments(user_curve(spark, sf_dir), 6).select("key", "block", "n", "s", "m2")
    every = spark.range(6).select(F.lit(0).alias("split"), F.col("id").cast("int").alias("block"), F.lit(True).alias("train"))
    return pbo.pooled(moments, every).select("key", r(F.col("stat"), 9).alias("stat"))


@query("WITH x AS (SELECT user_id % 5 AS roster, count(DISTINCT user_id) AS trials FROM events GROUP BY 1), y AS (SELECT roster, trials, 2 * CAST(roster + 1 AS INT) AS blocks FROM x), c AS (SELECT *, factorial(blocks) // (factorial(blocks // 2) * factorial(blocks // 2)) AS splits FROM y) SELECT CAST(roster AS INT) AS roster, CAST(splits // 2 * trials * (blocks - 2) + 2 * splits * trials AS BIGINT) AS work FROM c")
def pbo7_work(spark, sf_dir):
    """Rosters of users, held over 2, 4, 6, 8 and 10 blocks."""
    n = events(spark, sf_dir).groupBy((F.col("user_id") % 5).cast("int").alias("roster")).agg(F.count_distinct("user_id").alias("trials"))
    figure = F.create_map(*(x for k in range(5) for x in (F.lit(k), F.lit(pbo.work(2 * k + 2, 1)))))  # work is a multiple of the trials
    return n.select("roster", (figure[F.col("roster")] * F.col("trials")).alias("work"))


@query(f"WITH {TRIALS_SQL}, g AS (SELECT brand, ['grid', 'random', 'sobol', 'tpe', 'candidates'][1 + CAST(substr(brand, 7) AS INT) % 5] AS sampler, bool_or(status = 'pruned' AND size > 45) AS early_stop FROM tr GROUP BY 1) SELECT brand, CASE WHEN sampler IN ('grid', 'random', 'sobol') AND NOT early_stop THEN 'paper_conformant' ELSE 'diagnostic_adaptive_roster' END AS label FROM g")
def pbo8_roster_label(spark, sf_dir):
    """Each brand as a roster: its sampler by its number, stopped early if a large part was pruned."""
    sampler = F.element_at(F.array(*map(F.lit, ("grid", "random", "sobol", "tpe", "candidates"))), F.substring("brand", 7, 9).cast("int") % 5 + 1)
    g = trials(spark, sf_dir).groupBy("brand").agg(F.max((F.col("status") == "pruned") & (F.col("size") > 45)).alias("early_stop"))
    return g.select("brand", pbo.roster_labels(sampler, F.col("early_stop")).alias("label"))


@query(f"WITH {CURVE}{STATS} SELECT count(*) AS eligible, round(var_samp((mean - 0.02 / periods) / std), 6) AS variance FROM st")
def dsr2_sharpe_variance(spark, sf_dir):
    found = dsr_.sharpe_variance(dsr_.eligible(curves.return_stats(user_curve(spark, sf_dir))))
    return spark.createDataFrame([(found.n, round(exact.rounded(found.variance()), 6))], "eligible bigint, variance double")


@query("""SELECT event_type AS symbol, count(*) AS n, CAST(sum(CAST(value * pow(2.0::DOUBLE, 60) AS HUGEINT)) AS VARCHAR) AS scaled_sum,
(sum(CAST(value * pow(2.0::DOUBLE, 60) AS HUGEINT)) / count(*)) / pow(2.0::DOUBLE, 60) AS mean, round(var_samp(value), 9) AS variance FROM events GROUP BY 1""")
def dsr2_exact_moments(spark, sf_dir):
    """Exact sums of the events' values; scaled_sum is the sum times 2**60, which is a whole number."""
    sums = exact.sums(events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "value"), "value", ["symbol"])
    lift = F.pow(F.lit(2).cast("double"), F.col("power") + 60).cast("decimal(38,0)")
    scaled = sums.groupBy("symbol").agg(F.sum((F.col("s") * lift).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string").alias("scaled_sum"))
    return exact.figures(sums, ["symbol"]).join(scaled, "symbol").select("symbol", "n", "scaled_sum", "mean", r(F.col("variance"), 9).alias("variance"))


@query(f"WITH {CURVE}{STATS} SELECT key, CASE key % 7 WHEN 1 THEN 'missing' WHEN 2 THEN 'status_4' WHEN 3 THEN 'count' WHEN 4 THEN 'not_finite' END AS reason FROM st WHERE n >= 4")
def dsr1_eligibility(spark, sf_dir):
    """Users whose figures are spoilt in each way, and the first reason that is found."""
    k, stats = F.col("key") % 7, curves.return_stats(user_curve(spark, sf_dir))
    spoilt = stats.withColumns({
        "status": F.when(k == 2, 4).when(k != 1, F.col("status")), "count": F.when(k == 3, 1).when(k != 1, F.col("count")),
        "skew": F.when(k == 4, F.lit(float("nan"))).when(k == 3, F.lit(float("inf"))).otherwise(F.col("skew")),
    })
    return dsr_.reasons(spoilt).select("key", "reason")


@query(f"WITH {POOL} SELECT CAST(row_number() OVER (ORDER BY value DESC, trial_id) AS INT) AS place, vector, trial_id, value FROM sel QUALIFY place <= 20")
def hld2_followed(spark, sf_dir):
    return holdout.followed(_two(spark, sf_dir)[0], 20).select("place", "vector", "trial_id", "value")


@query(f"WITH {POOL} SELECT vector, value, selected_value FROM po")
def hld3_vector_join(spark, sf_dir):
    return holdout.pool(*_two(spark, sf_dir)).select("vector", "value", "selected_value")


@query(f"""WITH {POOL}, un AS (SELECT vector, trial_id FROM sel ANTI JOIN hol USING (vector)), ho AS (SELECT vector, arg_min(reason, trial_id) AS why, count(*) AS rows, min(trial_id) AS first_id, max(trial_id) AS last_id FROM s WHERE window = {HOLDOUT} GROUP BY 1)
SELECT vector, un.trial_id, coalesce(why, 'no_row') AS reason, coalesce(rows, 0) AS rows, first_id, last_id FROM un LEFT JOIN ho USING (vector)""")
def hld4_unmatched(spark, sf_dir):
    return holdout.unmatched(*_two(spark, sf_dir))


@query(f"WITH {STUDIES}, w AS (SELECT DISTINCT window FROM s WHERE window NOT IN (1997, 1999)), n AS (SELECT window, lead(window) OVER (ORDER BY window) AS next_window FROM w) SELECT window, next_window FROM n WHERE next_window > window + 1")
def wfw2_breaks(spark, sf_dir):
    """Two years are left out."""
    return holdout.breaks(studies(spark, sf_dir).where(~F.col("window").isin(1997, 1999)))


@query(f"WITH {NBH} SELECT CAST(centre AS INT) AS centre, dimension, size, brand FROM nb")
def nbh1_neighbours(spark, sf_dir):
    return neighbourhood.neighbours(neighbourhood.top(_nbh(spark, sf_dir), PART_SPACE, 5), PART_SPACE)


@query(f"WITH {NBH} SELECT cell, count(*) AS n FROM lk GROUP BY 1")
def nbh2_cells(spark, sf_dir):
    u = _nbh(spark, sf_dir)
    return neighbourhood.looked_up(neighbourhood.neighbours(neighbourhood.top(u, PART_SPACE, 5), PART_SPACE), u, PART_SPACE).groupBy("cell").agg(F.count("*").alias("n"))


@query(f"WITH {NBH} SELECT trial_id, best - objective <= 0.05 * abs(best) AS near FROM u, be WHERE status = 'ok'")
def nbh3_band(spark, sf_dir):
    return neighbourhood.near_best(_nbh(spark, sf_dir).where("status = 'ok'"), 0.05, relative=True).select("trial_id", "near")


LOGGED = Space((Integer("n", 2, 50, log=True), Real("x", 0.001, 1000.0, log=True)))


@query(f"""WITH {TRIALS_SQL}, c AS (SELECT DISTINCT size AS n FROM tr WHERE size >= 2), m AS (SELECT n, unnest([floor(n / 1.5 + 0.5), floor(n * 1.5 + 0.5)])::BIGINT AS t FROM c)
SELECT n AS centre, list_sort(list(t) FILTER (t <> n AND t BETWEEN 2 AND 50)) AS moves, CAST(sum((t <> n AND t NOT BETWEEN 2 AND 50)::INT) AS BIGINT) AS bounds, CAST(sum((t = n)::INT) AS BIGINT) AS same_as_centre FROM m GROUP BY 1""")
def nbh1_log_integer_moves(spark, sf_dir):
    """Every size of a part as a value of a logarithmic dimension, with the ratio 1.5."""
    c = trials(spark, sf_dir).where("size >= 2").select("size").distinct().select(F.col("size").alias("centre"), F.col("size").alias("n"), F.lit(1.0).alias("x"))
    moved = neighbourhood.neighbours(c, LOGGED, ratio=1.5).where("dimension = 'n'").groupBy("centre").agg(F.sort_array(F.collect_list("n")).alias("moves"))
    return moved.join(neighbourhood.dropped(c, LOGGED, ratio=1.5).where("dimension = 'n'").drop("dimension"), "centre")


# ---- Emission ----------------------------------------------------------------


@query(f"WITH {EMITTED} SELECT CASE WHEN status IN ('ok', 'constraint_violation') THEN 'ok' WHEN status = 'pruned' THEN 'pruned' ELSE 'failed' END AS projected, status = 'ok' AS feasible, count(*) AS n FROM em GROUP BY 1, 2")
def str2_projection(spark, sf_dir):
    status, feasible = emission.projected(F.col("status"))
    return _emitted(spark, sf_dir).groupBy(status.alias("projected"), feasible.alias("feasible")).agg(F.count("*").alias("n"))


@query(f"WITH {EMITTED}, i AS (SELECT study, trial_id, trial_id - row_number() OVER (PARTITION BY study ORDER BY trial_id) AS k FROM em WHERE trial_id >= 1), f AS (SELECT study, max(trial_id) AS w FROM i WHERE k = 0 GROUP BY 1) SELECT em.study, trial_id, trial_id > coalesce(w, 0) AS beyond_watermark, trial_id < 1 AS rejected FROM em LEFT JOIN f USING (study)")
def str4_beyond_watermark(spark, sf_dir):
    return emission.beyond(_emitted(spark, sf_dir), 1).select("study", "trial_id", "beyond_watermark", "rejected")


@query("WITH l AS (SELECT CAST(0 AS INT) AS study, o_orderkey AS trial_id, o_custkey % 50 AS completed_before, o_custkey % 40 AS completion_order FROM orders), p AS (SELECT *, lag(completed_before) OVER (ORDER BY trial_id) AS b FROM l) SELECT trial_id FROM p WHERE completed_before < b OR completed_before > completion_order")
def str6_log_audit(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(0).alias("study"), F.col("o_orderkey").alias("trial_id"), (F.col("o_custkey") % 50).alias("completed_before"), (F.col("o_custkey") % 40).alias("completion_order"))
    return emission.audit(log).select("trial_id")


@query("SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS month, count(*) AS n FROM orders GROUP BY 1")
def str7_month_buckets(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    return o.groupBy(curves.month(F.col("ms")).cast("int").alias("month")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT epoch_us(ts::TIMESTAMP) // 1000 AS ms FROM events), w AS (SELECT unnest([ms - ms % 3600000, ms - ms % 3600000 - 3600000]) AS start FROM e) SELECT start, count(*) AS n FROM w GROUP BY 1""")
def str8_sliding_windows(spark, sf_dir):
    w = F.window(F.timestamp_millis("ms"), "2 hours", "1 hour")
    return events(spark, sf_dir).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.unix_millis("w.start").alias("start"), "n")


# ---- Studies, documents, identities ------------------------------------------


@query(f"WITH {CURVE}{STATS}, x AS (SELECT key, (mean - 0.02 / periods) / std AS sr FROM st), o AS (SELECT key, row_number() OVER (ORDER BY sr DESC, key) AS place, count(*) OVER () AS n FROM x) SELECT key AS selected, n AS eligible, n AS trials, place = 1 AS selected_is_max FROM o WHERE place IN (1, 2, 40)")
def dsr4_selected_is_max(spark, sf_dir):
    """The estimate for the best, the second and the fortieth user: only the first is the maximum."""
    stats = cut_lineage(curves.return_stats(user_curve(spark, sf_dir)))
    top = [x["key"] for x in dsr_.eligible(stats).orderBy(F.col("sharpe_per_period").desc(), "key").select("key").limit(40).collect()]
    made = [(k, found["eligible"], found["trials"], found["selected_is_max"]) for k in (top[0], top[1], top[39]) for found in [dsr_.dsr(stats, k)]]
    return spark.createDataFrame(made, "selected bigint, eligible bigint, trials bigint, selected_is_max boolean")


@query(f"""WITH {CURVE}{BLOCKS}, f0 AS (SELECT key, list(struct_pack(n := n::DOUBLE, s := s, m2 := m2) ORDER BY block) AS b FROM bm GROUP BY 1),
m AS (SELECT key, list_reduce(b, lambda x, z: struct_pack(n := x.n + z.n, s := x.s + z.s, m2 := (x.m2 + z.m2) + (z.s / z.n - x.s / x.n) * (z.s / z.n - x.s / x.n) * x.n * z.n / (x.n + z.n))) AS v FROM f0)
SELECT key, v.n AS n, round(v.s, 9) AS s, round(v.m2, 9) AS m2 FROM m""")
def pbo3_moment_merge(spark, sf_dir):
    m = F.col("m")
    found = pbo.folded(curves.block_moments(user_curve(spark, sf_dir), 6), "key")
    return found.select("key", m["n"].alias("n"), r(m["s"], 9).alias("s"), r(m["m2"], 9).alias("m2"))


SELECTED = EVERY_HOUR + f""", g AS (SELECT range AS trial_id, 12 + 2 * (range // 4) AS entry, 2 + 2 * (range % 4) AS exit FROM range(20)),
k AS (SELECT trial_id, timestamp, close, CASE WHEN close >= entry THEN 1 WHEN close <= exit THEN 0 END AS s FROM g, b WHERE timestamp >= {START} AND timestamp < {START + 5 * 86_400_000}),
h AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 0) AS held FROM k),
i AS (SELECT trial_id, coalesce(lag(held) OVER w * (close - lag(close) OVER w), 0) AS gain FROM h WINDOW w AS (PARTITION BY trial_id ORDER BY timestamp))"""


@query(f"WITH {SELECTED} SELECT trial_id, round(sum(gain), 6) AS net_profit FROM i GROUP BY 1")
def evl12_selected_window(spark, sf_dir):
    b = bars_.between(every_hour(spark, sf_dir), START, START + 5 * 86_400_000)
    out = evaluate.evaluate(EVAL_SPACE.grid(spark), evaluate.bars_of(b, ("timestamp", "close")), evaluate.threshold, ("net_profit",))
    return out.select("trial_id", r(F.col("metrics")["net_profit"]).alias("net_profit"))


@query("SELECT range AS trial_id, 'num_trades' AS metrics FROM range(20)")
def evl7_requested_metrics(spark, sf_dir):
    b = evaluate.bars_of(every_hour(spark, sf_dir), ("timestamp", "close"))
    out = evaluate.evaluate(EVAL_SPACE.grid(spark), b, evaluate.threshold, ("num_trades",))
    return out.select("trial_id", F.array_join(F.map_keys("metrics"), ",").alias("metrics"))


#: The serial random stream of seed 3 over EVAL_SPACE (fixed values): entry and exit of 16 trials.
DRAWN = ((16, 8), (12, 4), (14, 2), (20, 2), (18, 8), (12, 6), (12, 6), (18, 8), (16, 2), (20, 6), (20, 8), (18, 6), (20, 4), (14, 2), (20, 6), (16, 4))
G = SIGNALS[SIGNALS.index("g AS (") : SIGNALS.index("k AS (")]
OF_DRAWN = SIGNALS.replace(G, "g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {e}, {x})" for i, (e, x) in enumerate(DRAWN)) + ") v(trial_id, entry, exit)),\n")


@query(f"""WITH {OF_DRAWN}, st AS (SELECT trial_id, CASE WHEN trades >= 1 THEN 'ok' ELSE 'constraint_violation' END AS status, round(net - 0.25 * dd, 6) AS objective FROM m),
be AS (SELECT *, CASE WHEN status = 'ok' THEN objective END AS v, max(CASE WHEN status = 'ok' THEN objective END) OVER (ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM st),
la AS (SELECT *, trial_id - max(CASE WHEN v IS NOT NULL AND (best IS NULL OR v > best) THEN trial_id END) OVER (ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS idle FROM be),
wh AS (SELECT CASE WHEN max(idle) >= 10 THEN 'PATIENCE' WHEN bool_or(status = 'ok') THEN 'COMPLETE' ELSE 'NO_FEASIBLE' END AS stop FROM la)
SELECT CAST(trial_id AS BIGINT) AS trial_id, status, objective, stop FROM la, wh""")
def lif1_batches(spark, sf_dir):
    b = evaluate.bars_of(every_hour(spark, sf_dir), ("timestamp", "close"))
    found, why = STUDY.run_adaptive(spark, continuation.Random(EVAL_SPACE, 3), b, evaluate.threshold, 16, batch=8, patience=10)
    return spark.createDataFrame([(x["trial_id"], x["status"], None if x["objective"] is None else round(x["objective"], 6), why.name) for x in found], "trial_id bigint, status string, objective double, stop string")


@query(None)
def lif2_rolling_schedule(spark, sf_dir):
    from stratamill.plans import rolling

    b = evaluate.bars_of(every_hour(spark, sf_dir), ("timestamp", "close"))
    _, log = rolling.run(spark, STUDY, continuation.Random(EVAL_SPACE, 3), b, evaluate.threshold, 4)
    return spark.createDataFrame(log, "completion_order int, trial_id int, completed_before int")


@query(f"WITH {TRIALS_SQL}, g AS (SELECT range AS ordinal, 1 + range // 25 AS size, 'Brand#' || (1 + range % 25) AS brand FROM range(1250)), u AS (SELECT g.* FROM g ANTI JOIN tr USING (size, brand)) SELECT (SELECT max(trial_id) FROM tr) + row_number() OVER (ORDER BY ordinal) AS trial_id, size, brand FROM u ORDER BY ordinal LIMIT 100")
def lif6_continued_grid(spark, sf_dir):
    return continuation.continued_grid(spark, PART_SPACE, trials(spark, sf_dir), 100)


SPEC = {
    "schema_version": 1,
    "mode": "single_strategy",
    "strategies": [{"id": "t", "source": "t", "datasets": ["d"], "search_space": {"a": {"kind": "integer", "low": 1, "high": 9}, "b": {"kind": "boolean"}}}],
    "datasets": [{"id": "d", "ohlcv": "x.csv", "input_tf": "1", "script_tf": "15"}],
    "objective": {"kind": "expression", "direction": "maximize", "expression": "net_profit", "constraints": ["num_trades >= 1"]},
    "sampler": {"kind": "grid"},
}


@query("SELECT p_partkey AS trial_id, CASE p_partkey % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 2 * CAST(p_size AS BIGINT) END AS cardinality, CASE p_partkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS issues FROM part")
def src17_study_spec(spark, sf_dir):
    """A specification for each part, bounded by its size; some lack a bound, some the objective and the sampler's kind."""
    from stratamill.plans.spec import parse
    from stratamill.types import Refusal

    def admitted(batches):
        for g in batches:
            made = []
            for n, k in zip(g["p_size"].tolist(), (g["p_partkey"] % 5).tolist(), strict=True):
                spec = json.loads(json.dumps(SPEC))
                bounds = spec["strategies"][0]["search_space"]["a"]
                bounds["high"] = n
                if k == 1:
                    bounds["low"] = n + 1
                if k == 2:
                    spec["objective"]["direction"], spec["sampler"] = "sideways", {"kind": "guess"}
                try:
                    made.append((parse(json.dumps(spec)).space.cardinality(), 0))
                except Refusal as e:
                    made.append((None, len(e.context.get("issues", [1]))))
            yield pd.DataFrame({"trial_id": g["p_partkey"], "cardinality": pd.array([m[0] for m in made], "Int64"), "issues": [m[1] for m in made]})

    return _parts(spark, sf_dir).select("p_partkey", "p_size").mapInPandas(admitted, "trial_id bigint, cardinality bigint, issues int")


@query("SELECT p_partkey AS trial_id, ['ok', 'json_repeated_key', 'json_constant', 'json_range', 'json_syntax'][1 + p_partkey % 5] AS outcome FROM part")
def src8_strict_json(spark, sf_dir):
    """The parts as lines of JSON, of which one in five is sound."""

    def read(text: str) -> str:
        try:
            trial_files.loads_strict(text)
            return "ok"
        except trial_files.Refusal as e:
            return e.code

    outcome = F.pandas_udf(lambda s: s.map(read), "string")
    name, price, k = (F.to_json(F.struct(F.col("p_name").alias("a"))), F.col("p_retailprice").cast("string"), F.col("p_partkey") % 5)
    text = F.when(k == 1, F.concat(F.rtrim(name, F.lit("}")), F.lit(', "a": 1}'))).when(k == 2, F.concat(F.lit("["), price, F.lit(", NaN]"))).when(k == 3, F.concat(price, F.lit("e999"))).when(k == 4, F.rtrim(name, F.lit("}"))).otherwise(name)
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("trial_id"), outcome(text).alias("outcome"))


@query(f"WITH {TRIALS_SQL} SELECT status, count(*) AS n FROM tr GROUP BY 1")
def snk1_document_counts(spark, sf_dir):
    tr = trials(spark, sf_dir)
    found = Study(PART_SPACE, "price", ("price",)).document(tr, "grid")
    return spark.createDataFrame(sorted(found["statuses"].items()), "status string, n bigint")


@query(f"""WITH {TRIALS_SQL}, o AS (SELECT * FROM tr WHERE trial_id >= 700 AND trial_id % 9 <> 4), a AS (SELECT * FROM tr WHERE trial_id < 700 AND size > 3),
c AS (SELECT part, count(*) AS trials, min(trial_id) AS first_id, max(trial_id) AS last_id, max(trial_id) - min(trial_id) + 1 - count(*) AS missing_ids, CAST(sum((status IN ('ok', 'constraint_violation') AND objective IS NOT NULL)::INT) AS BIGINT) AS scored, count(DISTINCT (size, brand)) AS vectors
FROM (SELECT 'own' AS part, * FROM o UNION ALL SELECT 'ancestors', * FROM a) GROUP BY 1), b AS (SELECT trial_id, objective FROM o WHERE status = 'ok' ORDER BY objective DESC, trial_id LIMIT 1)
SELECT c.*, CASE WHEN part = 'ancestors' THEN (SELECT count(*) FROM (SELECT DISTINCT size, brand FROM o) SEMI JOIN a USING (size, brand)) END AS repeated_vectors, CASE WHEN part = 'own' THEN b.trial_id END AS best FROM c, b""")
def snk1_document(spark, sf_dir):
    """Coverage of a study that goes on from earlier trials, with some ids missing, and its best trial."""
    tr = cut_lineage(trials(spark, sf_dir))
    d = Study(PART_SPACE, "price", ("price",)).document(tr.where("trial_id >= 700 and trial_id % 9 <> 4"), "grid", tr.where("trial_id < 700 and size > 3"))
    rows_ = [{"part": "own", "best": d["best"]["trial_id"], "repeated_vectors": None} | d["coverage"], {"part": "ancestors", "best": None} | d["ancestors"]]
    kind = "part string, trials bigint, first_id bigint, last_id bigint, missing_ids bigint, scored bigint, vectors bigint, repeated_vectors bigint, best bigint"
    return spark.createDataFrame([tuple(x[c.split()[0]] for c in kind.split(", ")) for x in rows_], kind)


@query("SELECT p_partkey AS trial_id, CASE p_partkey % 4 WHEN 0 THEN p_size > 25 WHEN 1 THEN p_size <= 20 WHEN 2 THEN p_size <= 10 ELSE p_size % 2 = 0 END AS refused FROM part")
def spc1_dimension_refusals(spark, sf_dir):
    """A dimension for each part: bounds that cross, a logarithm from 0, a step of 0, choices that repeat."""
    from stratamill.types import Refusal

    made = {
        0: lambda n: Integer("a", n, 25), 1: lambda n: Integer("b", max(0, n - 20), 99, log=True),
        2: lambda n: Real("c", 0.0, 1.0, max(0, n - 10) / 50), 3: lambda n: Categorical("d", ("x", "x" if n % 2 == 0 else "y")),
    }

    def refused(n: int, k: int) -> bool:
        try:
            made[k](n)
            return False
        except Refusal:
            return True

    udf = F.pandas_udf(lambda n, k: pd.Series([refused(int(a), int(b)) for a, b in zip(n, k, strict=True)]), "boolean")
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("trial_id"), udf(F.col("p_size"), F.col("p_partkey") % 4).alias("refused"))


@query("SELECT p_brand AS brand, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 5 <> 0 THEN CAST(max(p_size) * 2 * count(DISTINCT p_type) * 4 AS BIGINT) END AS cardinality FROM part GROUP BY 1")
def spc2_cardinality(spark, sf_dir):
    """A space for each brand: sizes, a switch, types and a real dimension, which has no steps for every fifth brand."""

    def vectors(size: int, types: int, brand: int):
        return Space((Integer("size", 1, size), Boolean("flag"), Categorical("type", tuple(range(types))), Real("x", 0.0, 0.3, 0.1 if brand % 5 else None))).cardinality()

    udf = F.pandas_udf(lambda a, b, c: pd.Series([vectors(*map(int, x)) for x in zip(a, b, c, strict=True)], dtype="Int64"), "bigint")
    g = t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.max("p_size").alias("size"), F.count_distinct("p_type").alias("types"))
    return g.select("brand", udf("size", "types", F.substring("brand", 7, 9).cast("int")).alias("cardinality"))


@query("SELECT p_partkey AS trial_id, format('{:.17g}', p_retailprice / 3) AS real, CAST(p_size AS VARCHAR) AS whole, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS flag FROM part")
def spc8_serialised(spark, sf_dir):
    from stratamill.plans.space import serialised

    text = F.pandas_udf(lambda s: s.map(lambda v: serialised(bool(v) if isinstance(v, (bool, np.bool_)) else v)), "string")
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("trial_id"), text(F.col("p_retailprice") / 3).alias("real"), text("p_size").alias("whole"), text(F.col("p_size") > 25).alias("flag"))


@query("SELECT DISTINCT CAST(p_size AS BIGINT) AS size, p_size <= 46 AS injective FROM part")
def spc7_injective_grids(spark, sf_dir):
    """Halves from a power of two on, 16 times that of the size: doubles hold them, and the unit that an end may be off, apart up to 2**50."""
    from stratamill.plans.spec import injective

    udf = F.pandas_udf(lambda s: s.map(lambda n: injective(Real("x", 2.0 ** (int(n) + 4), 2.0 ** (int(n) + 4) + 64, 0.5))), "boolean")
    return trials(spark, sf_dir).select("size").distinct().select("size", udf("size").alias("injective"))


@query(f"SELECT p_partkey AS trial_id, lpad(lower(hex(CAST({_split_mix_sql('xor(p_partkey::UHUGEINT, p_size::UHUGEINT)')} AS UBIGINT))), 16, '0') AS seed FROM part")
def smp22_continuation_seed(spark, sf_dir):
    """Each part's key as a seed, its size as the number of warm rows."""
    udf = F.pandas_udf(lambda s, n: pd.Series([f"{samplers.continuation_seed(int(a), int(b)):016x}" for a, b in zip(s, n, strict=True)]), "string")
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("trial_id"), udf("p_partkey", "p_size").alias("seed"))


@query("WITH c AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS trial_id, p_brand AS brand, p_retailprice AS price FROM part) SELECT brand, count(*) AS trials, CAST(min(trial_id) AS BIGINT) AS first_id, CAST(max(trial_id) AS BIGINT) AS last_id FROM c GROUP BY 1")
def smp21_listed_candidates(spark, sf_dir):
    """Each line of a list is a trial, once."""
    return src16_candidate_list(spark, sf_dir).groupBy("brand").agg(F.count("*").alias("trials"), F.min("trial_id").alias("first_id"), F.max("trial_id").alias("last_id"))


@query(f"WITH {EMITTED}, i AS (SELECT study, trial_id, trial_id - row_number() OVER (PARTITION BY study ORDER BY trial_id) AS k FROM em) SELECT study, trial_id, status FROM i JOIN em USING (study, trial_id) WHERE k = -1")
def str1_ordered_emission(spark, sf_dir):
    source, out, state = (_scratch(spark, x) for x in ("stream", "emitted", "state"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", emission.ROCKS)
    _emitted(spark, sf_dir).select(F.col("study").cast("string").alias("study"), "trial_id", "status").repartition(4).write.json(source)
    stream = spark.readStream.schema("study string, trial_id bigint, status string").option("maxFilesPerTrigger", 2).json(source)
    q = emission.emit(stream).where("outcome = 'emitted'").writeStream.outputMode("append").option("checkpointLocation", state).format("parquet").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.col("study").cast("bigint").alias("study"), "trial_id", "status")


@query("WITH p AS (SELECT p_partkey % 3 AS study, p_partkey // 3 AS trial_id FROM part) SELECT study, trial_id, CASE WHEN study = 2 AND trial_id > 5 THEN 'held' ELSE 'emitted' END AS outcome FROM p WHERE NOT (study = 2 AND trial_id = 5)")
def str1_back_pressure(spark, sf_dir):
    """The first id of each study comes last, and one of the third study never: state has 100 rows of a study at most, what is further ahead stays outside."""
    p = t(spark, sf_dir, "part").select((F.col("p_partkey") % 3).cast("string").alias("study"), F.floor(F.col("p_partkey") / 3).alias("trial_id"), F.lit("ok").alias("status"))
    p, source = p.where("not (study = '2' and trial_id = 5)"), _scratch(spark, "source")
    p.where("trial_id > 0").coalesce(1).write.parquet(source)
    p.where("trial_id = 0").coalesce(1).write.mode("append").parquet(source)
    out = emission.drained(spark, source, _scratch(spark, "drained"), bound=100)
    return out.where("outcome <> 'rejected'").select(F.col("study").cast("bigint").alias("study"), "trial_id", "outcome")


@query(f"WITH {EMITTED} SELECT DISTINCT study, trial_id FROM em")
def str9_repeated_trials(spark, sf_dir):
    source, out, state = (_scratch(spark, x) for x in ("stream", "distinct", "state"))
    rows_ = _emitted(spark, sf_dir).select("study", "trial_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    rows_.union(rows_).write.parquet(source)
    stream = spark.readStream.schema("study bigint, trial_id bigint, at timestamp").parquet(source)
    q = emission.late(stream, "1 hour").writeStream.outputMode("append").option("checkpointLocation", state).format("parquet").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("study", "trial_id")


from stratamill import queries_more  # noqa: E402, F401
