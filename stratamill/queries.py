"""Registered queries: name -> (callable(spark, sf_dir), oracle SQL or None).

Inputs are made from the driver's tables by the same rules on both sides: bars and
equity curves from `events`, trials from `part`, studies by year from `lineitem`.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamill.functions.expr import Expression, Policy, columns, satisfied, status, violation
from stratamill.operators import curves, evaluate, holdout, neighbourhood, pareto, pbo, rows
from stratamill.operators.dsr import dsr
from stratamill.operators.ordered import numbered, numbered_running
from stratamill.plans import samplers, tpe
from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space
from stratamill.plans.study import Study, list_coverage
from stratamill.sources import bars as bars_
from stratamill.storage import cut_lineage
from stratamill.streaming import emission

QUERIES: dict = {}


def query(sql: str | None = None):
    if sql:
        sql = re.sub(r'(?<!")\bwindow\b(?!")', '"window"', sql)  # a column here, a word of the language in lower case elsewhere

    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6):
    return F.round(c, digits)


# ---- Inputs ------------------------------------------------------------------


def events(spark, sf_dir):
    return t(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).select("event_id", "ms", "user_id", "event_type", "value")


def hourly(spark, sf_dir):
    """symbol, timestamp, open, high, low, close, volume"""
    e = events(spark, sf_dir).select(F.col("event_type").alias("symbol"), (F.col("ms") - F.col("ms") % 3_600_000).alias("timestamp"), F.struct("ms", "event_id").alias("o"), "value")
    return e.groupBy("symbol", "timestamp").agg(F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o").alias("close"), F.count("*").cast("double").alias("volume"))


def every_hour(spark, sf_dir):
    """timestamp, open, high, low, close, volume of all events together: the bars of one symbol"""
    e = events(spark, sf_dir).select((F.col("ms") - F.col("ms") % 3_600_000).alias("timestamp"), F.struct("ms", "event_id").alias("o"), "value")
    return e.groupBy("timestamp").agg(F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o").alias("close"), F.count("*").cast("double").alias("volume"))


DAY = 86_400_000


def user_curve(spark, sf_dir):
    """key, idx, time_ms, equity by user: running sums in blocks of days"""
    e = events(spark, sf_dir).withColumn("key", F.col("user_id")).withColumn("_day", F.floor(F.col("ms") / DAY))
    e = numbered_running(e, ["key"], "_day", ["ms", "event_id"], F.col("value").cast("decimal(18,6)") - F.lit(10).cast("decimal(18,6)"), "idx", "gain")
    return e.select("key", "idx", F.col("ms").alias("time_ms"), (F.lit(1000).cast("decimal(18,6)") + F.col("gain")).cast("double").alias("equity"))


def order_curve(spark, sf_dir):
    """key, idx, time_ms, equity by customer number mod 20, over years"""
    o = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("key"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    o = o.withColumn("_y", F.floor(F.col("ms") / (DAY * 365)))
    o = numbered_running(o, ["key"], "_y", ["ms", "o_orderkey"], F.col("p"), "idx", "gain")
    return o.select("key", "idx", F.col("ms").alias("time_ms"), (F.lit(1000000).cast("decimal(18,2)") + F.col("gain")).cast("double").alias("equity"))


EVENTS = "e AS (SELECT event_id, epoch_us(ts::TIMESTAMP) // 1000 AS ms, user_id, event_type, value FROM events)"
HOURLY = EVENTS + """, b AS (
  SELECT event_type AS symbol, ms - ms % 3600000 AS timestamp, arg_min(value, (ms, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ms, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM e GROUP BY 1, 2)"""
EVERY_HOUR = EVENTS + """, b AS (
  SELECT ms - ms % 3600000 AS timestamp, arg_min(value, (ms, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ms, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM e GROUP BY 1)"""
CURVE = EVENTS + """, c AS (
  SELECT user_id AS key, row_number() OVER w - 1 AS idx, ms AS time_ms,
         CAST(CAST(1000 AS DECIMAL(18,6)) + sum(CAST(value AS DECIMAL(18,6)) - CAST(10 AS DECIMAL(18,6))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS equity
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))"""
ORDER_CURVE = """o AS (SELECT o_custkey % 20 AS key, epoch_us(o_orderdate::TIMESTAMP) // 1000 AS ms, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders),
c AS (SELECT key, row_number() OVER w - 1 AS idx, ms AS time_ms, CAST(CAST(1000000 AS DECIMAL(18,2)) + sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS equity
  FROM o WINDOW w AS (PARTITION BY key ORDER BY ms, o_orderkey))"""
RETURNS = """, p AS (SELECT *, lag(equity) OVER (PARTITION BY key ORDER BY idx) AS prior FROM c),
ret AS (SELECT key, idx, time_ms, prior, equity, prior <= 0 AS skipped, CASE WHEN prior > 0 THEN equity / prior - 1 END AS r FROM p WHERE idx > 0)"""

TRIALS_SQL = """tr AS (
  SELECT p_partkey AS trial_id, CAST(p_size AS BIGINT) AS size, p_brand AS brand, CAST(p_retailprice AS DOUBLE) AS price,
         CASE p_partkey % 11 WHEN 0 THEN 'engine_error' WHEN 1 THEN 'constraint_violation' WHEN 2 THEN 'pruned' ELSE 'ok' END AS status,
         p_partkey % 11 > 2 AS feasible, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_retailprice AS DOUBLE) END AS objective
  FROM part)"""


def trials(spark, sf_dir):
    m = F.col("p_partkey") % 11
    st = F.when(m == 0, "engine_error").when(m == 1, "constraint_violation").when(m == 2, "pruned").otherwise("ok")
    price = F.col("p_retailprice").cast("double")
    return t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("trial_id"), F.col("p_size").cast("long").alias("size"), F.col("p_brand").alias("brand"), price.alias("price"), st.alias("status"), (m > 2).alias("feasible"), F.when(m != 0, price).alias("objective")
    )


def studies(spark, sf_dir):
    """window (year), trial_id, vector, value, reason, size: a trial is a part in a year, its value that of its vector (brand and size)."""
    line = t(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("window"), F.col("l_partkey").alias("trial_id"), F.col("l_quantity").cast("long").alias("q")).groupBy("window", "trial_id").agg(F.sum("q").alias("q"))
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("vector"), F.col("p_size").cast("long").alias("size"))
    j = line.join(p, "trial_id")
    value = j.groupBy("window", "vector").agg(F.sum("q").alias("value"))
    return j.join(value, ["window", "vector"]).select("window", "trial_id", "vector", "value", F.when(F.col("trial_id") % 7 == 0, "status_engine_error").alias("reason"), "size")


STUDIES = """l AS (SELECT CAST(year(l_shipdate) AS INT) AS window, l_partkey AS trial_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
p AS (SELECT p_partkey AS trial_id, concat_ws('|', p_brand, CAST(p_size AS VARCHAR)) AS vector, CAST(p_size AS BIGINT) AS size FROM part),
s AS (SELECT l.window, l.trial_id, p.vector, CAST(sum(l.q) OVER (PARTITION BY l.window, p.vector) AS BIGINT) AS value,
      CASE WHEN l.trial_id % 7 = 0 THEN 'status_engine_error' END AS reason, p.size FROM l JOIN p USING (trial_id)),
v AS (SELECT window, vector, min(trial_id) AS trial_id, arg_min(value, trial_id) AS value FROM s WHERE reason IS NULL GROUP BY 1, 2)"""
SELECTION, HOLDOUT = 1996, 1997


# ---- Sources -----------------------------------------------------------------


@query(f"""WITH {HOURLY}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS k FROM b), x AS (SELECT symbol, timestamp, k, k + CASE k % 7 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS record, CASE WHEN k % 50 = 9 THEN -1 ELSE volume END AS volume FROM o),
y AS (SELECT *, lag(timestamp) OVER (PARTITION BY symbol ORDER BY record, k) AS prior FROM x) SELECT symbol, timestamp, CASE WHEN volume < 0 THEN 'volume' ELSE 'order' END AS reason FROM y WHERE volume < 0 OR timestamp <= prior""")
def src3_bar_invariants(spark, sf_dir):
    """Every seventh pair of bars changes places, every fiftieth bar has a volume below 0."""
    b = numbered(hourly(spark, sf_dir).withColumn("_b", F.floor(F.col("timestamp") / (30 * DAY))), ["symbol"], "_b", ["timestamp"], "k").drop("_b")
    moved = F.when(F.col("k") % 7 == 2, 1).when(F.col("k") % 7 == 3, -1).otherwise(0)
    b = b.withColumns({"record": 2 * (F.col("k") + moved) + F.when(moved < 0, 1).otherwise(0), "volume": F.when(F.col("k") % 50 == 9, -1.0).otherwise(F.col("volume"))})
    return bars_.violations(b, ["symbol"], "record").select("symbol", "timestamp", "reason")


@query(f"WITH {HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS k FROM b) SELECT symbol, timestamp, open, high, low, close, volume FROM n WHERE k >= 24 AND k < 72")
def src4_bar_slice(spark, sf_dir):
    return bars_.sliced(hourly(spark, sf_dir), ["symbol"], 24, 48).select("symbol", "timestamp", "open", "high", "low", "close", "volume")


@query(f"WITH {HOURLY} SELECT symbol, timestamp, timestamp + 3600000 AS time_close, (timestamp < timestamp + 3600000) AND coalesce(timestamp + 3600000 <= lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp), TRUE) AS ok FROM b")
def src6_symbol_feed(spark, sf_dir):
    return bars_.feed_checks(hourly(spark, sf_dir), "60").select("symbol", "timestamp", "time_close", "ok")


@query(f"WITH {TRIALS_SQL} SELECT status, count(*) AS n, CAST(sum(CAST(feasible <> (status = 'ok') AS INT)) AS BIGINT) AS defects FROM tr GROUP BY 1")
def src10_row_validation(spark, sf_dir):
    tr = trials(spark, sf_dir)
    bad = rows.row_defects(tr).groupBy("status").agg(F.count("*").alias("d"))
    return tr.groupBy("status").agg(F.count("*").alias("n")).join(bad, "status", "left").select("status", "n", F.coalesce("d", F.lit(0)).alias("defects"))


@query("SELECT l_partkey AS trial_id, CAST(0 AS INT) AS source_index, count(*) AS times FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def src11_repeated_ids(spark, sf_dir):
    return rows.repeated_ids(t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("trial_id"), F.lit(0).alias("source_index")))


@query(f"WITH {TRIALS_SQL}, ok AS (SELECT * FROM tr WHERE status = 'ok'), f AS (SELECT arg_min(brand, trial_id) AS b FROM ok) SELECT trial_id, brand FROM ok, f WHERE brand IS DISTINCT FROM b")
def src12_context_check(spark, sf_dir):
    return rows.context_mismatches(trials(spark, sf_dir).withColumn("source_index", F.lit(0)), ["brand"]).select("trial_id", "brand")


@query(f"WITH {HOURLY}, c AS (SELECT * FROM (VALUES ('click', 1), ('view', 2), ('purchase', 3)) x(symbol, dataset_id)) SELECT b.symbol, CAST(c.dataset_id AS INT) AS dataset_id, count(*) AS bars FROM b LEFT JOIN c USING (symbol) GROUP BY 1, 2")
def src19_symbol_catalogue(spark, sf_dir):
    catalogue = spark.createDataFrame([("click", 1), ("view", 2), ("purchase", 3)], "choice string, dataset_id int")
    return evaluate.routed(hourly(spark, sf_dir), catalogue, "symbol").groupBy("symbol", "dataset_id").agg(F.count("*").alias("bars"))


# ---- Expressions -------------------------------------------------------------

OBJECTIVE = "price - 0.5 * size + max(size, 20) / (size - 10)"


@query(f"""WITH {TRIALS_SQL} SELECT trial_id, CASE WHEN size <> 10 THEN round(price - 0.5 * size + greatest(size, 20)::DOUBLE / (size - 10), 6) END AS value,
CASE WHEN size = 10 THEN 'division_by_zero' END AS error FROM tr""")
def exp4_division_policy(spark, sf_dir):
    tr = trials(spark, sf_dir)
    value, error = Expression(OBJECTIVE).compile(columns(tr.columns))
    return tr.select("trial_id", r(value).alias("value"), error.alias("error"))


@query(f"WITH {TRIALS_SQL} SELECT trial_id, CASE WHEN (CASE WHEN 5 < size THEN 1.0 ELSE 0.0 END) < price / 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM tr")
def exp2_chained_comparison(spark, sf_dir):
    tr = trials(spark, sf_dir)
    value, _ = Expression("5 < size < price / 1000").compile(columns(tr.columns))
    return tr.select("trial_id", value.alias("value"))


@query(f"""WITH {TRIALS_SQL} SELECT trial_id, CASE WHEN objective IS NULL THEN 'missing_metric' WHEN size = 7 THEN 'division_by_zero' END AS error,
CASE WHEN objective IS NOT NULL AND size <> 7 THEN round(abs(objective) / (size - 7) + least(size, 3), 6) END AS value FROM tr""")
def exp7_first_error(spark, sf_dir):
    tr = trials(spark, sf_dir)
    value, error = Expression("abs(objective) / (size - 7) + min(size, 3)").compile(columns(tr.columns))
    return tr.select("trial_id", error.alias("error"), r(value).alias("value"))


@query(f"""WITH {TRIALS_SQL} SELECT trial_id, CASE WHEN size = 7 THEN 'infinite' ELSE 'finite' END AS kind FROM tr""")
def exp5_ieee_results(spark, sf_dir):
    tr = trials(spark, sf_dir)
    value, _ = Expression("price / (size - 7)").compile(columns(tr.columns), Policy(False, False))
    return tr.select("trial_id", F.when(F.abs(value) == F.lit(float("inf")), "infinite").otherwise("finite").alias("kind"))


@query(f"""WITH {TRIALS_SQL} SELECT CASE WHEN objective IS NULL THEN 'objective_error' WHEN size = 10 THEN 'constraint_error' WHEN NOT (20 / (size - 10) <> 1.5) OR NOT size >= 5 THEN 'constraint_violation' ELSE 'ok' END AS status, count(*) AS n FROM tr GROUP BY 1""")
def exp9_constraint_status(spark, sf_dir):
    tr = trials(spark, sf_dir)
    m = columns(tr.columns)
    st = status(Expression("objective * 2").compile(m), [Expression("20 / (size - 10) != 1.5").compile(m), Expression("size >= 5").compile(m)])
    return tr.groupBy(st.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {TRIALS_SQL} SELECT trial_id, round(greatest(0.0, price - 1000 - 0.5), 6)::DOUBLE AS over, coalesce(price <> 0, FALSE) AS met FROM tr")
def exp10_violation(spark, sf_dir):
    tr = trials(spark, sf_dir)
    return tr.select("trial_id", r(violation(F.col("price"), "<=", 1000.0, 0.5)).alias("over"), F.coalesce(satisfied(*Expression("price").compile(columns(tr.columns))), F.lit(False)).alias("met"))


@query(f"""WITH {TRIALS_SQL}, x AS (SELECT trial_id, CASE WHEN status <> 'ok' THEN 'status_' || status WHEN size % 5 = 0 THEN 'metric_not_recorded' WHEN size % 7 = 0 THEN 'metric_unavailable' END AS reason FROM tr)
SELECT reason, count(*) AS n, min(trial_id) AS first_id, max(trial_id) AS last_id FROM x WHERE reason IS NOT NULL GROUP BY 1""")
def exp13_eligibility(spark, sf_dir):
    metrics = F.when(F.col("size") % 5 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("m"), F.when(F.col("size") % 7 != 0, F.col("price"))))
    return rows.exclusions(trials(spark, sf_dir).withColumn("metrics", metrics), rows.exclusion(["m"]))


@query(f"WITH {TRIALS_SQL} SELECT trial_id, objective FROM tr WHERE status = 'ok' ORDER BY objective DESC, trial_id LIMIT 25")
def snk3_best_k(spark, sf_dir):
    return rows.best(trials(spark, sf_dir), 25).select("trial_id", "objective")


@query(f"WITH {TRIALS_SQL} SELECT trial_id, objective FROM tr WHERE status = 'ok' ORDER BY objective, trial_id LIMIT 1")
def evl8_best_trial(spark, sf_dir):
    return rows.best(trials(spark, sf_dir), 1, minimize=True).select("trial_id", "objective")


@query("WITH g AS (SELECT p_partkey - row_number() OVER (ORDER BY p_partkey) AS i, p_partkey FROM part WHERE p_partkey % 10 < 3) SELECT min(p_partkey) AS first, max(p_partkey) AS last FROM g GROUP BY i")
def snk7_list_coverage(spark, sf_dir):
    listed = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"))
    return list_coverage(listed.where("trial_id % 10 >= 3"), listed)


# ---- Spaces and samplers -----------------------------------------------------

SPACE = Space((Integer("size", 1, 50), Categorical("mode", ("ema", "sma", "wma")), Boolean("flag"), Real("x", 0.0, 0.3, 0.1)))
GRID = "SELECT p_partkey AS trial_id, 1 + (range // 24) % 50 AS size, ['ema','sma','wma'][1 + (range // 8) % 3] AS mode, (range // 4) % 2 = 1 AS flag, list_extract(CAST([0.0, 0.1, 0.2, 0.3] AS DOUBLE[]), 1 + range % 4) AS x FROM (SELECT p_partkey, p_partkey % 1200 AS range FROM part)"


@query(GRID)
def smp1_grid(spark, sf_dir):
    """The grid's vectors, dealt to the parts by their keys."""
    return SPACE.decode(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"), (F.col("p_partkey") % 1200).alias("_o")), "_o").drop("_o")


@query("SELECT p_partkey AS trial_id, p_partkey % 1200 AS ordinal FROM part")
def spc5_encode(spark, sf_dir):
    return SPACE.encode(smp1_grid(spark, sf_dir)).select("trial_id", "ordinal")


@query(f"WITH {TRIALS_SQL} SELECT trial_id, CASE WHEN size % 2 = 0 OR size > 31 THEN 'size: off grid' END AS issue FROM tr WHERE size % 2 = 0 OR size > 31")
def spc6_membership(spark, sf_dir):
    return Space((Integer("size", 1, 31, 2),)).issues(trials(spark, sf_dir)).select("trial_id", "issue")


BRANDS = tuple(f"Brand#{i}" for i in range(1, 26))
PART_SPACE = Space((Integer("size", 1, 50), Categorical("brand", BRANDS)))


@query(f"WITH {TRIALS_SQL}, x AS (SELECT count(DISTINCT (size, brand)) AS tried, max(trial_id) + 1 AS next_id FROM tr) SELECT CAST(1250 AS INT) AS cardinality, tried, 1250 - tried AS remaining, next_id FROM x")
def spc10_space_info(spark, sf_dir):
    return PART_SPACE.info(trials(spark, sf_dir))


@query(f"WITH {TRIALS_SQL}, g AS (SELECT range AS ordinal, 1 + range // 25 AS size, 'Brand#' || (1 + range % 25) AS brand FROM range(1250)) SELECT ordinal, size, brand FROM g ANTI JOIN tr USING (size, brand)")
def smp2_grid_continuation(spark, sf_dir):
    return PART_SPACE.continued(spark, trials(spark, sf_dir)).select("ordinal", "size", "brand")


def _sobol_sql(column: int, bits: int, shift: int = 0) -> str:
    out = f"{shift}::UBIGINT"
    for k, v in enumerate(samplers.direction_words(column)[:bits]):
        out = f"xor({out}, CASE WHEN (xor(range, range >> 1) >> {k}) & 1 = 1 THEN {v}::UBIGINT ELSE 0::UBIGINT END)"
    return out


def _part_ids(spark, sf_dir):
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"))


SOBOL_SPACE = Space((Integer("a", 0, 999), Real("b", 0.0, 1.0), Categorical("c", tuple(range(7))), Integer("d", 1, 100)))


@query(f"""WITH w AS (SELECT range AS trial_id, {", ".join(f"{_sobol_sql(c, 25, samplers.shift_word(42, c))} AS w{c}" for c in range(4))} FROM (SELECT p_partkey AS range FROM part))
SELECT trial_id, CAST((w0::HUGEINT * 1000) >> 64 AS BIGINT) AS a, round(CAST(w1 >> 11 AS DOUBLE) * pow(2.0, -53), 9) AS b, CAST((w2::HUGEINT * 7) >> 64 AS INT) AS c, 1 + CAST((w3::HUGEINT * 100) >> 64 AS BIGINT) AS d FROM w""")
def smp4_sobol(spark, sf_dir):
    """Each part's point by its key."""
    return samplers.sobol_at(_part_ids(spark, sf_dir), SOBOL_SPACE, 42).withColumn("b", r(F.col("b"), 9))


@query(None)
def smp3_random(spark, sf_dir):
    return samplers.random_at(_part_ids(spark, sf_dir), SOBOL_SPACE, 7)


@query(f"""WITH {TRIALS_SQL}, ok AS (SELECT *, row_number() OVER (ORDER BY objective DESC, trial_id) AS rank, count(*) OVER () AS n FROM tr WHERE status = 'ok')
SELECT trial_id, rank <= least(greatest(1, ceil(0.1 * n)), 25, n - 1) AS good FROM ok""")
def smp9_good_bad_split(spark, sf_dir):
    return tpe.split_rows(trials(spark, sf_dir).where("status = 'ok'")).select("trial_id", "good")


@query(f"WITH {TRIALS_SQL}, c AS (SELECT brand, count(*) AS w, sum(count(*)) OVER () AS n FROM tr WHERE status = 'ok' GROUP BY 1) SELECT brand, round(((w + n * (1.0 / (n + 1))) / ((1.0 + n) * (1 + 25.0 / (n + 1)))) + (1.0 / (1.0 + n)) / 25, 9)::DOUBLE AS mass FROM c")
def smp14_choice_mass(spark, sf_dir):
    return tpe.choice_masses(trials(spark, sf_dir).where("status = 'ok'").withColumn("weight", F.lit(1.0)), "brand", BRANDS).where("n > 0").select("brand", r(F.col("mass"), 9).alias("mass"))


# ---- Evaluation --------------------------------------------------------------

EVAL_SPACE = Space((Integer("entry", 12, 20, 2), Integer("exit", 2, 8, 2)))
STUDY = Study(EVAL_SPACE, "net_profit - 0.25 * max_equity_drawdown", evaluate.THRESHOLD_METRICS, ("num_trades >= 1",))
SIGNALS = EVERY_HOUR + """, g AS (SELECT range AS trial_id, 12 + 2 * (range // 4) AS entry, 2 + 2 * (range % 4) AS exit FROM range(20)),
k AS (SELECT trial_id, entry, exit, timestamp, close, CASE WHEN close >= entry THEN 1 WHEN close <= exit THEN 0 END AS s FROM g, b),
h AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 0) AS held FROM k),
i AS (SELECT *, lag(held, 1, 0) OVER w AS was, coalesce(lag(held) OVER w * (close - lag(close) OVER w), 0) AS gain FROM h WINDOW w AS (PARTITION BY trial_id ORDER BY timestamp)),
q AS (SELECT *, 1000 + sum(gain) OVER (PARTITION BY trial_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS equity FROM i),
d AS (SELECT *, max(equity) OVER (PARTITION BY trial_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) - equity AS down FROM q),
m AS (SELECT trial_id, any_value(entry) AS entry, any_value(exit) AS exit, sum(gain) AS net, sum(CAST(held = 1 AND was = 0 AS INT)) AS trades, max(down) AS dd FROM d GROUP BY 1)"""


@query(f"WITH {SIGNALS} SELECT trial_id, entry, exit, CASE WHEN trades >= 1 THEN 'ok' ELSE 'constraint_violation' END AS status, round(net - 0.25 * dd, 6) AS objective, CAST(trades AS DOUBLE) AS trades FROM m")
def evl1_grid_study(spark, sf_dir):
    b = evaluate.bars_of(every_hour(spark, sf_dir), ("timestamp", "close"))
    out = STUDY.run(EVAL_SPACE.grid(spark), b, evaluate.threshold)
    return out.select("trial_id", "entry", "exit", "status", r(F.col("objective")).alias("objective"), F.col("metrics")["num_trades"].alias("trades"))


@query(f"""WITH {STUDIES}, x AS (SELECT CAST(window AS INT) AS rung, trial_id, value AS score, row_number() OVER (PARTITION BY window ORDER BY trial_id DESC) AS recent FROM s WHERE reason IS NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY score DESC, trial_id) AS place, count(*) OVER (PARTITION BY rung) AS n FROM x WHERE recent <= 1024)
SELECT rung, score AS cut FROM y WHERE place = ceil(n / 3.0)""")
def evl4_pruner_cut(spark, sf_dir):
    return evaluate.cut(studies(spark, sf_dir).where("reason is null").select(F.col("window").alias("rung"), "trial_id", F.col("value").alias("score")), 3)


@query(f"WITH {HOURLY} SELECT symbol, timestamp - timestamp % 14400000 AS timestamp, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume) AS volume, count(*) AS bars FROM b GROUP BY 1, 2")
def evl9_resample(spark, sf_dir):
    return bars_.resample(hourly(spark, sf_dir), ["symbol"], 4 * 3_600_000)


START = 1_704_067_200_000 + 10 * DAY


@query(f"""WITH {HOURLY}, c AS (SELECT *, timestamp // 14400000 AS bucket, timestamp < {START} AS before FROM b WHERE timestamp >= {START - 5 * DAY} AND timestamp < {START + 5 * DAY}),
g AS (SELECT symbol, bucket, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS k FROM (SELECT DISTINCT symbol, bucket FROM c WHERE before)),
f AS (SELECT symbol, min(bucket) AS first_bucket, count(*) AS pre FROM g WHERE k <= 12 GROUP BY 1),
q AS (SELECT c.*, f.pre FROM c LEFT JOIN f USING (symbol) WHERE NOT before OR bucket >= first_bucket)
SELECT symbol, count(*) AS fed_bars, CAST(sum(before::INT) AS BIGINT) AS pre_bars, CAST(sum((NOT before)::INT) AS BIGINT) AS window_bars, count(DISTINCT bucket) AS script_bars,
       coalesce(max(pre), 0) AS pre_groups, coalesce(max(pre), 0) < 12 AS short, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM q GROUP BY 1""")
def evl10_window_plan(spark, sf_dir):
    return bars_.window_plan(hourly(spark, sf_dir), ["symbol"], START, START + 5 * DAY, START - 5 * DAY, 4 * 3_600_000, 12)


# ---- Curves ------------------------------------------------------------------


@query(f"WITH {CURVE}{RETURNS} SELECT key, idx, round(r, 9) AS r, skipped FROM ret")
def agg1_bar_returns(spark, sf_dir):
    return curves.bar_returns(user_curve(spark, sf_dir)).select("key", "idx", r(F.col("r"), 9).alias("r"), "skipped")


@query(f"""WITH {ORDER_CURVE}, m AS (SELECT key, year(make_timestamp(time_ms * 1000)) * 12 + month(make_timestamp(time_ms * 1000)) - 1 AS month, arg_max(equity, idx) AS equity FROM c GROUP BY 1, 2)
SELECT key, CAST(month AS INT) AS month, round(equity / lag(equity) OVER (PARTITION BY key ORDER BY month) - 1, 9) AS r FROM m QUALIFY lag(equity) OVER (PARTITION BY key ORDER BY month) IS NOT NULL""")
def agg2_monthly_returns(spark, sf_dir):
    return curves.monthly_returns(order_curve(spark, sf_dir)).select("key", F.col("month").cast("int").alias("month"), r(F.col("r"), 9).alias("r"))


STATS = RETURNS + """, a AS (SELECT key, count(*) AS points, (max(time_ms) - min(time_ms)) / 31557600000.0::DOUBLE AS span FROM c GROUP BY 1),
f AS (SELECT key, count(r) AS n, avg(r) AS mean, sum(skipped::INT) AS skips FROM ret GROUP BY 1),
z AS (SELECT ret.key, sum(pow(r - mean, 2)) AS s2, sum(pow(r - mean, 3)) AS s3, sum(pow(r - mean, 4)) AS s4 FROM ret JOIN f USING (key) WHERE r IS NOT NULL GROUP BY 1),
st AS (SELECT a.key, f.n, f.skips, (points - 1) / span AS periods, mean, sqrt(s2 / (n - 1)) AS std, (s3 / n) / pow(s2 / n, 1.5) AS skew, (s4 / n) / pow(s2 / n, 2) AS kurt FROM a JOIN f USING (key) JOIN z USING (key) WHERE points >= 5)"""


@query(f"WITH {CURVE}{STATS} SELECT key, n AS count, CAST(skips AS BIGINT) AS skipped, round(periods, 6) AS periods_per_year, round(mean, 9) AS mean, round(std, 9) AS std, round((mean - 0.02 / periods) / std, 6) AS sharpe_per_period, round(skew, 6) AS skew, round(kurt, 6) AS kurt_raw, CAST(0 AS INT) AS status FROM st")
def agg4_return_stats(spark, sf_dir):
    s = curves.return_stats(user_curve(spark, sf_dir)).where("count >= 4")
    return s.select("key", "count", "skipped", r(F.col("periods_per_year")).alias("periods_per_year"), r(F.col("mean"), 9).alias("mean"), r(F.col("std"), 9).alias("std"), *(r(F.col(c)).alias(c) for c in ("sharpe_per_period", "skew", "kurt_raw")), "status")


BLOCKS = RETURNS + """, z AS (SELECT key, count(*) - 1 AS k FROM c GROUP BY 1),
y AS (SELECT ret.*, CAST(((idx - 1) * 6) // k AS INT) AS block FROM ret JOIN z USING (key) WHERE k >= 6 AND floor(k / 6) * 3 >= 2),
f AS (SELECT key, block, count(r) AS n, sum(r) AS s FROM y GROUP BY 1, 2),
bm AS (SELECT key, block, any_value(n) AS n, any_value(s) AS s, CASE WHEN any_value(n) = 1 THEN 0.0 ELSE sum(pow(r - s / n, 2)) END AS m2 FROM y JOIN f USING (key, block) GROUP BY 1, 2)"""


@query(f"WITH {CURVE}{BLOCKS} SELECT key, block, n, round(s, 9) AS s, round(m2, 9) AS m2 FROM bm")
def agg8_block_moments(spark, sf_dir):
    return curves.block_moments(user_curve(spark, sf_dir), 6).select("key", "block", "n", r(F.col("s"), 9).alias("s"), r(F.col("m2"), 9).alias("m2"))


@query(f"WITH {TRIALS_SQL} SELECT count(*) AS trials, count(DISTINCT (size, brand)) AS vectors, CAST(sum((status = 'ok')::INT) AS BIGINT) AS ok, CAST(sum((status = 'pruned')::INT) AS BIGINT) AS pruned FROM tr")
def agg10_coverage(spark, sf_dir):
    return rows.coverage(trials(spark, sf_dir), ["size", "brand"]).select("trials", "vectors", "ok", "pruned")


# ---- Analyses ----------------------------------------------------------------

AXES = {"price": "maximize", "size": "minimize"}


@query(f"WITH {TRIALS_SQL}, ok AS (SELECT * FROM tr WHERE status = 'ok') SELECT trial_id, price, size FROM ok x WHERE NOT EXISTS (SELECT 1 FROM ok y WHERE y.price >= x.price AND y.size <= x.size AND (y.price > x.price OR y.size < x.size))")
def par2_pareto_front(spark, sf_dir):
    return pareto.front(trials(spark, sf_dir).where("status = 'ok'"), AXES).select("trial_id", "price", "size")


@query("""WITH v AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT * FROM v x WHERE NOT EXISTS (SELECT 1 FROM v y WHERE y.a + 40 * y.b >= x.a + 40 * x.b AND y.b <= x.b AND y.c >= x.c AND (y.a + 40 * y.b > x.a + 40 * x.b OR y.b < x.b OR y.c > x.c)))
SELECT l_orderkey AS trial_id, l_linenumber AS line FROM lineitem JOIN f ON l_quantity = a AND l_discount = b AND l_tax = c""")
def par2_pareto_front_3_axes(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") + 40 * F.col("l_discount")).alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"))
    return pareto.front(s, {"a": "maximize", "b": "minimize", "c": "maximize"}).select("trial_id", "line")


@query("""WITH v AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT x.a, x.b, x.c, any_value(x.n) AS rows, CAST(coalesce(sum(y.n) FILTER (y.a > x.a OR y.b < x.b OR y.c > x.c), 0) AS BIGINT) AS dominated_by FROM v x JOIN v y ON y.a >= x.a AND y.b <= x.b AND y.c >= x.c GROUP BY 1, 2, 3)
SELECT a, b, c, dominated_by, CAST(rows AS BIGINT) AS rows FROM k""")
def par3_domination_counts_3_axes(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"))
    return pareto.domination_counts(s, {"a": "maximize", "b": "minimize", "c": "maximize"}).groupBy("a", "b", "c", "dominated_by").agg(F.count("*").alias("rows"))


@query("""WITH s AS (SELECT s_suppkey AS trial_id, s_nationkey AS b, s_suppkey % 17 AS c FROM supplier)
SELECT x.trial_id, CAST(sum((y.b >= x.b AND y.c >= x.c AND (y.b > x.b OR y.c > x.c))::INT) AS BIGINT) AS dominated_by FROM s x, s y GROUP BY 1""")
def par3_domination_counts(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("trial_id"), F.col("s_nationkey").alias("b"), (F.col("s_suppkey") % 17).alias("c"))
    return pareto.domination_counts(s, dict.fromkeys("bc", "maximize"), max_work=1_000_000).select("trial_id", "dominated_by")


def _moments(spark, sf_dir):
    return cut_lineage(curves.block_moments(user_curve(spark, sf_dir), 6).select("key", "block", "n", "s", "m2"))


BLOCK_PAIRS = BLOCKS + """, sp AS (SELECT row_number() OVER (ORDER BY (m & 1) = 0, l) - 1 AS split, m FROM (SELECT range AS m, array_to_string(list_filter([0, 1, 2, 3, 4, 5], lambda b: (range >> b) & 1 = CASE WHEN range & 1 = 1 THEN 1 ELSE 0 END), '') AS l FROM range(64)) WHERE bit_count(m::BIGINT) = 3),
hv AS (SELECT sp.split, y.key, (sp.m >> y.block) & 1 = 1 AS train, round(avg(r) / stddev_samp(r), 12) AS stat FROM sp, y WHERE r IS NOT NULL GROUP BY 1, 2, 3),
tp AS (SELECT split, key AS winner FROM hv WHERE train QUALIFY stat = max(stat) OVER (PARTITION BY split)), wn AS (SELECT split, winner, count(*) OVER (PARTITION BY split) AS ties FROM tp),
rk AS (SELECT wn.split, wn.winner, wn.ties, CAST(2 * sum((h.stat < o.stat)::INT) + sum((h.stat = o.stat)::INT) + 1 AS BIGINT) AS rank2, count(*) AS trials
       FROM wn JOIN hv o ON o.split = wn.split AND o.key = wn.winner AND NOT o.train JOIN hv h ON h.split = wn.split AND NOT h.train GROUP BY ALL)"""


@query(f"WITH {CURVE}{BLOCK_PAIRS} SELECT CAST(split AS INT) AS split, winner, ties, rank2, trials, CAST(sign(rank2 - (trials + 1)) AS INT) AS side FROM rk")
def pbo5_split_results(spark, sf_dir):
    return pbo.split_results(_moments(spark, sf_dir), 6)


@query(f"""WITH {CURVE}{BLOCK_PAIRS}, si AS (SELECT sum(CASE WHEN rank2 < trials + 1 THEN 1.0::DOUBLE / ties ELSE 0 END) AS lt, sum(CASE WHEN rank2 = trials + 1 THEN 1.0::DOUBLE / ties ELSE 0 END) AS eq, sum(CASE WHEN rank2 > trials + 1 THEN 1.0::DOUBLE / ties ELSE 0 END) AS gt, any_value(trials) AS n FROM rk)
SELECT 20 AS n_splits, lt AS n_lt0, eq AS n_eq0, gt AS n_gt0, (lt + eq) / 20 AS pbo, lt / 20 AS strict_rate, CAST(10 * n * 4 + 40 * n AS BIGINT) AS work FROM si""")
def pbo6_probability(spark, sf_dir):
    return spark.createDataFrame([pbo.pbo(_moments(spark, sf_dir), 6)])


@query(f"""WITH {CURVE}{BLOCKS}, m AS (SELECT range AS m, array_to_string(list_filter([0, 1, 2, 3, 4, 5], lambda b: (range >> b) & 1 = CASE WHEN range & 1 = 1 THEN 1 ELSE 0 END), '') AS l FROM range(64) WHERE bit_count(range::BIGINT) = 3),
n AS (SELECT m, row_number() OVER (ORDER BY (m & 1) = 0, l) - 1 AS split FROM m)
SELECT CAST(split AS INT) AS split, CAST(block AS INT) AS block, (m >> block) & 1 = 1 AS train, count(*) AS trials, CAST(sum(n) AS BIGINT) AS returns FROM n n0(m, split), bm GROUP BY ALL""")
def pbo2_splits(spark, sf_dir):
    """The blocks of every split, with the trials and returns that they hold."""
    j = curves.block_moments(user_curve(spark, sf_dir), 6).join(F.broadcast(pbo.splits_table(spark, 6)), "block")
    return j.groupBy("split", "block", "train").agg(F.count("*").alias("trials"), F.sum("n").alias("returns"))


def _phi_sql(x: str) -> str:
    """The normal distribution function by its series around 0."""
    return f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(150), lambda k: sign({x}) * exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))))"


@query(f"""WITH RECURSIVE {CURVE}{STATS}, sh AS (SELECT key, n, (mean - 0.02 / periods) / std AS sr, skew, kurt FROM st),
al AS (SELECT var_samp(sr) AS v, count(*) AS m FROM sh), pick AS (SELECT * FROM sh ORDER BY sr DESC, key LIMIT 1),
qu(i, part, p, lo, hi) AS (SELECT 0, part, 1 - 1 / (m * CASE part WHEN 0 THEN 1 ELSE exp(1) END), 0.0::DOUBLE, 8.0::DOUBLE FROM al, range(2) t(part)
  UNION ALL SELECT i + 1, part, p, CASE WHEN {_phi_sql('(lo + hi) / 2')} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_phi_sql('(lo + hi) / 2')} < p THEN hi ELSE (lo + hi) / 2 END FROM qu WHERE i < 50),
dx AS (SELECT max(lo) FILTER (part = 0) AS a, max(lo) FILTER (part = 1) AS b FROM qu WHERE i = 50),
dy AS (SELECT v, m, sr, n, sqrt(v) * ((1 - 0.57721566490153286) * a + 0.57721566490153286 * b) AS sr0, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS den FROM al, dx, pick),
dz AS (SELECT *, (sr - sr0) * sqrt(n - 1) / sqrt(den) AS z FROM dy)
SELECT round(v, 6) AS variance, round(sr0, 6) AS sr0, round(den, 6) AS den, round(z, 5) AS z, round({_phi_sql('z')}, 6) AS dsr, m AS trials, m AS eligible, TRUE AS selected_is_max FROM dz""")
def dsr3_deflated_sharpe(spark, sf_dir):
    stats = cut_lineage(curves.return_stats(user_curve(spark, sf_dir)))
    top = stats.where("status = 0").orderBy(F.col("sharpe_per_period").desc(), "key").first()["key"]
    found = dsr(stats, top)
    digits = {"variance": 6, "sr0": 6, "den": 6, "z": 5, "dsr": 6}
    return spark.createDataFrame([{k: round(v, digits[k]) if k in digits else v for k, v in found.items()}])


def _two(spark, sf_dir):
    s = studies(spark, sf_dir)
    return s.where(F.col("window") == SELECTION), s.where(F.col("window") == HOLDOUT)


POOL = STUDIES + f""", sel AS (SELECT * FROM v WHERE window = {SELECTION}), hol AS (SELECT * FROM v WHERE window = {HOLDOUT}),
po AS (SELECT hol.vector, hol.value, sel.value AS selected_value, 2 * (rank() OVER (ORDER BY hol.value DESC) - 1) + count(*) OVER (PARTITION BY hol.value) + 1 AS rank2 FROM hol JOIN sel USING (vector))"""


@query(f"WITH {STUDIES} SELECT vector, trial_id, value FROM v WHERE window = {SELECTION}")
def hld1_vector_dedupe(spark, sf_dir):
    return holdout.by_vector(_two(spark, sf_dir)[0])


@query(f"WITH {POOL} SELECT vector, value, selected_value, rank2 FROM po")
def hld5_pool_mid_ranks(spark, sf_dir):
    return holdout.pool(*_two(spark, sf_dir)).select("vector", "value", "selected_value", "rank2")


@query(f"""WITH {POOL}, f AS (SELECT *, row_number() OVER (ORDER BY value DESC, trial_id) AS place FROM sel QUALIFY place <= 50), n AS (SELECT count(*) AS m FROM po),
w AS (SELECT vector, arg_min(coalesce(reason, ''), trial_id) AS why FROM s WHERE window = {HOLDOUT} GROUP BY 1)
SELECT CAST(place AS INT) AS place, f.vector, f.value, po.value AS holdout_value, po.value - f.value AS difference, po.value > f.value AS improved, rank2, rank2 <= m + 1 AS better_half,
       CASE WHEN po.value IS NULL THEN coalesce(why, 'no_row') END AS reason FROM f LEFT JOIN po USING (vector) LEFT JOIN w USING (vector), n""")
def hld6_holdout_compare(spark, sf_dir):
    return holdout.compare(*_two(spark, sf_dir), 50).select("place", "vector", "value", "holdout_value", "difference", "improved", "rank2", "better_half", "reason")


@query(f"""WITH {POOL}, x AS (SELECT rank2 AS y, 2 * (rank() OVER (ORDER BY selected_value DESC) - 1) + count(*) OVER (PARTITION BY selected_value) + 1 AS x FROM po)
SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM x""")
def hld7_spearman(spark, sf_dir):
    found = holdout.spearman(*_two(spark, sf_dir))
    return spark.createDataFrame([(found["n"], round(found["rho"], 6))], "n bigint, rho double")


@query(f"WITH {POOL} SELECT vector, value FROM hol ANTI JOIN sel USING (vector)")
def hld8_holdout_only(spark, sf_dir):
    return holdout.holdout_only(*_two(spark, sf_dir)).select("vector", "value")


@query(f"WITH {STUDIES} SELECT DISTINCT a.trial_id FROM s a SEMI JOIN (SELECT trial_id FROM s WHERE window = {HOLDOUT}) b USING (trial_id) WHERE a.window = {SELECTION}")
def hld9_ancestor_overlap(spark, sf_dir):
    return holdout.ancestors(*_two(spark, sf_dir))


WALK = STUDIES + """, ch AS (SELECT window, arg_min(struct_pack(t := trial_id, v := vector, x := value), (-value, trial_id)) AS b FROM s WHERE reason IS NULL GROUP BY 1),
sel AS (SELECT window, b.t AS trial_id, b.v AS vector, b.x AS value FROM ch)"""


@query(f"WITH {WALK} SELECT window, trial_id, vector, value FROM sel")
def wfw1_selections(spark, sf_dir):
    return holdout.selections(studies(spark, sf_dir))


@query(f"""WITH {WALK}, sw AS (SELECT DISTINCT window FROM s), cn AS (SELECT window, lead(window) OVER (ORDER BY window) AS nx FROM sw),
a AS (SELECT sel.window, cn.nx AS next_window, sel.trial_id, sel.vector FROM sel JOIN cn USING (window) WHERE nx = window + 1),
o AS (SELECT a.next_window, min(s.trial_id) FILTER (s.reason IS NULL) AS u, arg_min(s.value, s.trial_id) FILTER (s.reason IS NULL) AS nv, arg_min(coalesce(s.reason, ''), s.trial_id) AS why FROM a JOIN s ON s.window = a.next_window AND s.vector = a.vector GROUP BY 1),
g AS (SELECT a.*, o.nv AS next_value, o.why FROM a LEFT JOIN o USING (next_window))
SELECT g.window, g.next_window, g.trial_id, g.vector, g.next_value,
  CASE WHEN next_value IS NOT NULL THEN CAST((SELECT 2 * sum((s.value > g.next_value)::INT) + sum((s.value = g.next_value)::INT) + 1 FROM s WHERE s.window = g.next_window AND s.reason IS NULL) AS BIGINT) END AS rank2,
  CASE WHEN next_value IS NULL THEN coalesce(why, 'no_row') END AS reason FROM g""")
def wfw3_carry_over(spark, sf_dir):
    return holdout.carried(studies(spark, sf_dir))


@query(f"WITH {WALK} SELECT 'size' AS dimension, count(DISTINCT size) AS values, min(size)::DOUBLE AS smallest, max(size)::DOUBLE AS largest FROM (SELECT sel.window, p.size FROM sel JOIN p USING (trial_id))")
def wfw4_stability(spark, sf_dir):
    s = studies(spark, sf_dir)
    chosen = holdout.selections(s).join(s.select("window", "trial_id", "size"), ["window", "trial_id"])
    return holdout.stability(chosen, ["size"])


@query(f"WITH {STUDIES} SELECT CAST(range AS INT) AS window FROM range(1990, 2005) WHERE range NOT IN (SELECT window FROM s)")
def wfw5_never_run(spark, sf_dir):
    return holdout.never_run(studies(spark, sf_dir), spark.range(1990, 2005).select(F.col("id").cast("int").alias("window")))


def _nbh(spark, sf_dir):
    """One row per vector of (size, brand): the part with the lowest key stands for it."""
    tr = trials(spark, sf_dir)
    first = tr.groupBy("size", "brand").agg(F.min("trial_id").alias("trial_id"))
    return tr.join(first, ["size", "brand", "trial_id"])


BRAND_LIST = "[" + ", ".join(f"'{b}'" for b in BRANDS) + "]"
NBH = TRIALS_SQL + f""", u AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY size, brand ORDER BY trial_id) = 1),
ce AS (SELECT row_number() OVER (ORDER BY objective DESC, trial_id) AS centre, size, brand FROM u WHERE status = 'ok' QUALIFY centre <= 5),
nb AS (SELECT centre, 'size' AS dimension, size + d AS size, brand FROM ce, (VALUES (-1), (1)) x(d) WHERE size + d BETWEEN 1 AND 50
       UNION ALL SELECT centre, 'brand', size, y.brand FROM ce, (SELECT unnest({BRAND_LIST}) AS brand) y WHERE y.brand <> ce.brand),
lk AS (SELECT nb.*, CASE WHEN u.trial_id IS NULL THEN 'never_evaluated' WHEN status NOT IN ('ok', 'constraint_violation') OR objective IS NULL THEN 'unscorable' WHEN status = 'ok' THEN 'scored_ok' ELSE 'scored_infeasible' END AS cell, objective
       FROM nb LEFT JOIN u USING (size, brand)), be AS (SELECT max(objective) AS best FROM u WHERE status = 'ok')"""


@query(f"""WITH {NBH} SELECT CAST(centre AS INT) AS centre, count(*) AS geometric, CAST(sum((cell = 'scored_ok')::INT) AS BIGINT) AS ok, CAST(sum((cell = 'scored_infeasible')::INT) AS BIGINT) AS infeasible,
CAST(sum((cell = 'unscorable')::INT) AS BIGINT) AS unscorable, CAST(sum((cell = 'never_evaluated')::INT) AS BIGINT) AS never, CAST(sum((cell = 'scored_ok' AND best - objective <= 50)::INT) AS BIGINT) AS near,
round((count(*) - sum((cell = 'never_evaluated')::INT)) / count(*), 6)::DOUBLE AS coverage FROM lk, be GROUP BY 1""")
def nbh4_neighbourhood(spark, sf_dir):
    u = _nbh(spark, sf_dir)
    found = neighbourhood.profile(u, PART_SPACE, neighbourhood.top(u, PART_SPACE, 5), 50.0)
    return found.select("centre", "geometric", "ok", "infeasible", "unscorable", "never", "near", r(F.col("coverage")).alias("coverage"))


@query(f"WITH {NBH} SELECT CAST(centre AS INT) AS centre, size, brand FROM ce")
def nbh6_top_vectors(spark, sf_dir):
    return neighbourhood.top(_nbh(spark, sf_dir), PART_SPACE, 5).select("centre", "size", "brand")


@query(f"WITH {NBH} SELECT DISTINCT size, brand FROM lk WHERE cell = 'never_evaluated'")
def nbh7_missing_vectors(spark, sf_dir):
    u = _nbh(spark, sf_dir)
    return neighbourhood.missing(u, PART_SPACE, neighbourhood.top(u, PART_SPACE, 5))


@query(f"WITH {TRIALS_SQL} SELECT size, brand, count(DISTINCT (status, coalesce(objective, 'NaN'::DOUBLE))) AS k, min(trial_id) AS trial_id FROM tr GROUP BY 1, 2 HAVING k > 1")
def nbh5_disagreeing_vectors(spark, sf_dir):
    return neighbourhood.disagreeing(trials(spark, sf_dir), PART_SPACE)


THREE = Space((Integer("size", 1, 50), Categorical("brand", BRANDS), Categorical("kind", (0, 1, 2)), Boolean("flag")))
FAR = TRIALS_SQL + f""", t4 AS (SELECT *, CAST(trial_id % 3 AS INT) AS kind, trial_id % 4 < 2 AS flag FROM tr), u AS (SELECT * FROM t4 QUALIFY row_number() OVER (PARTITION BY size, brand, kind, flag ORDER BY trial_id) = 1),
ce AS (SELECT row_number() OVER (ORDER BY objective DESC, trial_id) AS centre, size, brand, kind, flag FROM u WHERE status = 'ok' QUALIFY centre <= 20),
nb AS (SELECT 'size' AS dimension, size + d AS size, brand, kind, flag FROM ce, (VALUES (-1), (1)) x(d) WHERE size + d BETWEEN 1 AND 50 UNION ALL SELECT 'brand', size, y.brand, kind, flag FROM ce, (SELECT unnest({BRAND_LIST}) AS brand) y WHERE y.brand <> ce.brand
       UNION ALL SELECT 'kind', size, brand, z.kind, flag FROM ce, (VALUES (0), (1), (2)) z(kind) WHERE z.kind <> ce.kind UNION ALL SELECT 'flag', size, brand, kind, NOT flag FROM ce),
be AS (SELECT max(objective) AS best FROM u WHERE status = 'ok'),
f AS (SELECT dimension, CAST(coalesce(sum((status IN ('ok', 'constraint_violation') AND objective IS NOT NULL AND NOT (status = 'ok' AND best - objective <= 50))::INT), 0) AS BIGINT) AS far FROM nb LEFT JOIN u USING (size, brand, kind, flag), be GROUP BY 1)"""


@query(f"WITH {FAR} SELECT a.dimension AS first, b.dimension AS second, a.far + b.far AS score FROM f a JOIN f b ON a.dimension < b.dimension ORDER BY score DESC, first, second LIMIT 4")
def sen1_pair_ranking(spark, sf_dir):
    """The four of six pairs of dimensions with most neighbours that are far from the best; equal scores go by name."""
    tr = trials(spark, sf_dir).withColumns({"kind": (F.col("trial_id") % 3).cast("int"), "flag": F.col("trial_id") % 4 < 2})
    first = tr.groupBy(*THREE.names).agg(F.min("trial_id").alias("trial_id"))
    u = cut_lineage(tr.join(first, [*THREE.names, "trial_id"]))
    return neighbourhood.pair_ranking(u, THREE, neighbourhood.top(u, THREE, 20), 50.0, 4)


@query(f"""WITH {NBH}, a AS (SELECT centre, size AS c_size, brand AS c_brand, unnest([size - 1, size, size + 1]) AS size FROM ce), ab AS (SELECT a.centre, a.size, y.brand, (a.size <> c_size)::INT + (y.brand <> c_brand)::INT AS moved FROM a, (SELECT unnest({BRAND_LIST}) AS brand) y WHERE a.size BETWEEN 1 AND 50)
SELECT CAST(centre AS INT) AS centre, ab.size, ab.brand, CASE moved WHEN 0 THEN 'centre' WHEN 1 THEN 'axis' ELSE 'diagonal' END AS role,
CASE WHEN u.trial_id IS NULL THEN 'never_evaluated' WHEN status NOT IN ('ok', 'constraint_violation') OR objective IS NULL THEN 'unscorable' WHEN status = 'ok' THEN 'scored_ok' ELSE 'scored_infeasible' END AS cell, objective
FROM ab LEFT JOIN u USING (size, brand)""")
def sen2_pair_map(spark, sf_dir):
    u = _nbh(spark, sf_dir)
    return neighbourhood.pair_map(u, PART_SPACE, neighbourhood.top(u, PART_SPACE, 5), "size", "brand")


# ---- Emission ----------------------------------------------------------------


def _emitted(spark, sf_dir):
    """study, trial_id, status, feasible, objective: lines of parts as trials, some ids missing"""
    p = trials(spark, sf_dir).where("trial_id % 97 != 50")
    return p.select((F.col("trial_id") % 3).alias("study"), F.floor(F.col("trial_id") / 3).alias("trial_id"), "status", "feasible", "objective")


EMITTED = TRIALS_SQL + ", em AS (SELECT trial_id % 3 AS study, trial_id // 3 AS trial_id, status, feasible, objective FROM tr WHERE trial_id % 97 <> 50)"


@query(f"WITH {EMITTED}, i AS (SELECT study, trial_id, trial_id - row_number() OVER (PARTITION BY study ORDER BY trial_id) AS k FROM em WHERE trial_id >= 1), f AS (SELECT study, max(trial_id) AS w FROM i WHERE k = 0 GROUP BY 1) SELECT study, coalesce(w, 0) AS watermark FROM (SELECT DISTINCT study FROM em) LEFT JOIN f USING (study)")
def str3_watermark(spark, sf_dir):
    return emission.watermark(_emitted(spark, sf_dir), 1)


@query(f"WITH {EMITTED}, g AS (SELECT study, max(trial_id) AS last, count(DISTINCT trial_id) FILTER (trial_id >= 1) AS emitted, CAST(sum((trial_id < 1)::INT) AS BIGINT) AS rejected FROM em GROUP BY 1) SELECT study, last AS projected, emitted, rejected, last - emitted AS gaps FROM g")
def str5_accounting(spark, sf_dir):
    return emission.accounting(_emitted(spark, sf_dir), 1)


@query(f"""WITH {EMITTED}, v AS (SELECT *, CASE WHEN feasible THEN objective END AS v, row_number() OVER w AS n FROM em WINDOW w AS (PARTITION BY study ORDER BY trial_id)),
b AS (SELECT *, max(v) OVER (PARTITION BY study ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v),
l AS (SELECT *, max(CASE WHEN v IS NOT NULL AND (best IS NULL OR v > best) THEN n END) OVER (PARTITION BY study ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS last FROM b),
h AS (SELECT study, min(trial_id) AS stops_at FROM l WHERE n - last >= 100 GROUP BY 1) SELECT study, stops_at FROM (SELECT DISTINCT study FROM em) LEFT JOIN h USING (study)""")
def str10_patience(spark, sf_dir):
    return emission.patience(_emitted(spark, sf_dir), 100)


from stratamill import queries_detail  # noqa: E402, F401  the rest of the inventory, registered on import
