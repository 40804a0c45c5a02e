"""Entries of the inventory that are a contract more than an operator: admissions, identities, states and codes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from stratamill.operators import evaluate
from stratamill.plans import continuation
from stratamill.plans.space import Integer, Real, Space
from stratamill.plans.study import Study, with_space
from stratamill.plans.tpe import encoded
from stratamill.queries import EVAL_SPACE, EVERY_HOUR, HOURLY, PART_SPACE, SIGNALS, TRIALS_SQL, every_hour, hourly, query, trials
from stratamill.queries_detail import _scratch
from stratamill.sources import bars as bars_
from stratamill.sources import catalogue
from stratamill.storage import cut_lineage, put
from stratamill.types import Refusal


def _double(x: str) -> str:
    return f"hex(({x})::DOUBLE::BIT::BLOB)"


def _little(hexed: str) -> str:
    """The bytes of a hexadecimal word the other way round."""
    return "".join(f" || substr({hexed}, {i}, 2)" for i in range(15, 0, -2))[4:]


def _long(x: str) -> str:
    return f"lpad(hex(CAST({x} AS BIGINT)), 16, '0')"


def refusal(make) -> str:
    """The code by which a call is refused, or ok."""
    try:
        make()
        return "ok"
    except Refusal as e:
        return e.code


# ---- Sources and sinks -------------------------------------------------------


BAR_BYTES = " || ".join(_little(_double(c)) for c in ("open", "high", "low", "close", "volume"))


@query(f"""WITH {HOURLY}, x AS (SELECT symbol, timestamp, {BAR_BYTES} || {_little(_long('timestamp'))} || {_little(_long('timestamp + 3600000'))} AS h FROM b)
SELECT symbol, count(*) AS bars, sha256(unhex('{catalogue.FEED.hex()}' || string_agg(h, '' ORDER BY timestamp))) AS sha256 FROM x GROUP BY 1""")
def src6_feed_digests(spark, sf_dir):
    """The digest of each symbol's hours: their values in order, as the machine's bytes."""
    return catalogue.feed_digests(hourly(spark, sf_dir), "60")


SETS = f"""WITH {HOURLY}, s AS (SELECT CASE symbol WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 2 ELSE 3 END AS dataset_id, symbol, min(timestamp) AS _ FROM b GROUP BY 1, 2),
o AS (SELECT * FROM b JOIN (SELECT dataset_id, min(symbol) AS symbol FROM s GROUP BY 1) USING (symbol)), x AS (SELECT dataset_id, timestamp, timestamp // {bars_.BLOCK_MS} AS block, {BAR_BYTES} || {_little(_long('timestamp'))} AS h FROM o),
d AS (SELECT dataset_id, block, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi, sha256(unhex('{catalogue.DATASET.hex()}' || string_agg(h, '' ORDER BY timestamp))) AS h FROM x GROUP BY 1, 2),
c AS (SELECT dataset_id, CAST(sum(n) AS BIGINT) AS bars, min(lo) AS first_ts, max(hi) AS last_ts, sha256(string_agg(h, '' ORDER BY block)) AS values_sha256 FROM d GROUP BY 1),
k AS (SELECT CAST(c.dataset_id AS INT) AS dataset_id, list_sort(list(symbol)) AS choices, bars, first_ts, last_ts, values_sha256 FROM c JOIN s USING (dataset_id) GROUP BY ALL)"""


def _sets(spark, sf_dir):
    """Symbols bound to three data sets, each the bars of its first symbol."""
    symbols = hourly(spark, sf_dir).select("symbol").distinct()
    of = F.when(F.col("symbol") == "click", 1).when(F.col("symbol").isin("view", "purchase"), 2).otherwise(3)
    bound = symbols.select(F.col("symbol").alias("choice"), of.alias("dataset_id"))
    owner = bound.groupBy("dataset_id").agg(F.min("choice").alias("symbol"))
    return catalogue.catalogue(hourly(spark, sf_dir).join(owner, "symbol"), bound)


@query(f"{SETS} SELECT dataset_id, array_to_string(choices, ',') AS choices, bars, first_ts, last_ts, values_sha256 FROM k")
def src19_data_sets(spark, sf_dir):
    return _sets(spark, sf_dir).withColumn("choices", F.array_join("choices", ","))


@query(f"""{SETS}, j AS (SELECT '[' || string_agg('{{"dataset_id":' || dataset_id || ',"choices":["' || array_to_string(choices, '","') || '"],"bars":' || bars || ',"first_ts":' || first_ts || ',"last_ts":' || last_ts || ',"values_sha256":"' || values_sha256 || '"}}', ',' ORDER BY dataset_id) || ']' AS descriptor FROM k)
SELECT descriptor, sha256(unhex('{catalogue.CATALOGUE.hex()}' || hex(descriptor))) AS sha256 FROM j""")
def src19_descriptor(spark, sf_dir):
    return catalogue.descriptor(_sets(spark, sf_dir))


@query(f"WITH {EVERY_HOUR} SELECT timestamp, open, high, low, close, volume FROM b")
def src2_binary_bars(spark, sf_dir):
    rows = every_hour(spark, sf_dir).orderBy("timestamp").select("open", "high", "low", "close", "volume", "timestamp").collect()  # hours of a month
    content = b"".join(bars_.RECORD.pack(*x) for x in rows)
    path = _scratch(spark, "bars.bin")
    put(spark, path, content)
    return bars_.read_binary(spark, path, bars_.sidecar_of(content, "all", "60")).drop("record")


@query(f"""WITH {EVERY_HOUR}, n AS (SELECT count(*) AS n FROM b) SELECT what, outcome, CASE WHEN outcome = 'ok' THEN n END AS bars FROM (VALUES ('again', 'ok'), ('another byte', 'sidecar_sha256'), ('another count', 'sidecar_count'), ('half a record', 'fails')) t(what, outcome), n""")
def src2_sidecar(spark, sf_dir):
    """The hours' bars as a file, whole and damaged."""
    rows = every_hour(spark, sf_dir).orderBy("timestamp").select("open", "high", "low", "close", "volume", "timestamp").collect()  # hours of a month
    content = b"".join(bars_.RECORD.pack(*x) for x in rows)
    sidecar = bars_.sidecar_of(content, "s", "60")

    def outcome(data: bytes, side: dict) -> tuple:
        path = _scratch(spark, "bars.bin")
        put(spark, path, data)
        try:
            return "ok", bars_.read_binary(spark, path, side).count()
        except Refusal as e:
            return e.code, None
        except Exception:  # a refusal inside a task
            return "fails", None

    made = {"again": (content, sidecar), "another byte": (b"\1" + content[1:], sidecar), "another count": (content, sidecar | {"count": 6}), "half a record": (content[:-20], {k: v for k, v in sidecar.items() if k != "sha256"})}
    return spark.createDataFrame([(k, *outcome(*v)) for k, v in made.items()], "what string, outcome string, bars bigint")


@query(f"WITH {HOURLY}, n AS (SELECT count(DISTINCT symbol) AS files FROM b) SELECT what, outcome, files FROM (VALUES ('unchanged', 'ok'), ('grown', 'input_changed')) t(what, outcome), n")
def src5_input_unchanged(spark, sf_dir):
    """A file of bars for each symbol, of which one grows."""
    path = _scratch(spark, "input")
    hourly(spark, sf_dir).repartition("symbol").write.partitionBy("symbol").option("header", True).csv(path)
    files = f"{path}/*/*.csv"
    before = bars_.snapshot(spark, files)
    same = refusal(lambda: bars_.verify_unchanged(spark, files, before))
    put(spark, before[0][0], b"1,2\n")
    grown = refusal(lambda: bars_.verify_unchanged(spark, files, before))
    return spark.createDataFrame([("unchanged", same, len(before)), ("grown", grown, len(before))], "what string, outcome string, files bigint")


@query(f"WITH {HOURLY} SELECT DISTINCT symbol, '60' AS timeframe, '/i/' || symbol || '.csv' AS path, (length(symbol) / 100.0)::DOUBLE AS mintick FROM b UNION ALL SELECT DISTINCT symbol, '1D', '/d/' || symbol || '.csv', (length(symbol) / 100.0)::DOUBLE FROM b")
def src7_feed_index(spark, sf_dir):
    """An index of the symbols that there are bars of."""
    symbols = [x["symbol"] for x in hourly(spark, sf_dir).select("symbol").distinct().collect()]
    index = {s: {"syminfo": {"tickerid": s, "mintick": len(s) / 100, "other": 1}, "feeds": {"60": f"{s}.csv", "1D": f"/d/{s}.csv"}} for s in symbols}
    found = bars_.load_index(json.dumps(index), "/i")
    return spark.createDataFrame([(e["symbol"], e["timeframe"], e["path"], e["syminfo"].get("mintick")) for e in found], "symbol string, timeframe string, path string, mintick double")


@query("WITH c AS (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1) SELECT brand, CASE WHEN n > 256 THEN 'feeds' WHEN CAST(substr(brand, 7) AS INT) % 4 = 1 THEN 'feeds' WHEN CAST(substr(brand, 7) AS INT) % 4 = 2 THEN 'timeframe' WHEN CAST(substr(brand, 7) AS INT) % 4 = 3 THEN 'syminfo' ELSE 'ok' END AS outcome FROM c")
def src7_feed_index_refusals(spark, sf_dir):
    """An index for each brand, whose symbols are its parts: more than 256, a field, a time frame or a tick that isn't one."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("symbol"))
    some = parts.groupBy("brand").agg(F.slice(F.array_sort(F.collect_set("symbol")), 1, 257).alias("symbols"))  # a symbol more than an index may have

    def outcome(brand, symbols):
        k = int(brand[6:]) % 4
        index = {s: {"feeds": {"0" if k == 2 else "60": "x"}} | ({"x": 1} if k == 1 else {"syminfo": {"mintick": -1}} if k == 3 else {}) for s in symbols}
        return refusal(lambda: bars_.load_index(json.dumps(index))) if len(index) <= 256 else refusal(lambda: bars_.load_index(json.dumps({s: {"feeds": {"60": "x"}} for s in symbols})))

    return some.select("brand", F.udf(outcome, "string")("brand", "symbols").alias("outcome"))


@query("SELECT p_partkey AS trial_id, CASE WHEN p_size % 5 = 0 THEN 'syminfo' WHEN p_size % 7 = 0 THEN 'mintick,series_origin_ms,session' ELSE 'mintick,session' END AS facts FROM part")
def src20_symbol_info(spark, sf_dir):
    """Each part as an instrument, flat or below a field, with a tick of 0 where its size is a multiple of five."""

    def facts(text):
        try:
            return ",".join(sorted(bars_.symbol_info(text)))
        except Refusal as e:
            return e.code

    size, name = F.col("p_size"), F.col("p_name")
    flat = F.struct(F.when(size % 5 == 0, 0.0).otherwise(size / 100).alias("mintick"), name.alias("session"), name.alias("color"), F.when(size % 7 == 0, F.col("p_partkey")).alias("series_origin_ms"))
    text = F.when(size % 2 == 0, F.to_json(flat)).otherwise(F.to_json(F.struct(flat.alias("syminfo"))))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("trial_id"), F.udf(facts, "string")(text).alias("facts"))


@query(f"""WITH {TRIALS_SQL}, h AS (SELECT trial_id, CASE WHEN size = 3 THEN 'odd' ELSE status END AS status, feasible <> (size = 5) AS feasible, CASE WHEN size = 7 THEN NULL ELSE objective END AS objective, CASE WHEN size = 9 THEN 99 ELSE size END AS size, size = 11 AS score, trial_id % 50 = 2 AS twice FROM tr),
d AS (SELECT trial_id, CASE WHEN twice THEN 'repeated' WHEN status = 'odd' THEN 'status' WHEN feasible <> (status = 'ok') THEN 'feasible' WHEN status = 'ok' AND objective IS NULL THEN 'objective' WHEN size > 50 THEN 'vector' WHEN score THEN 'rung_score' END AS defect FROM h)
SELECT trial_id, defect FROM d WHERE defect IS NOT NULL""")
def src14_warm_history(spark, sf_dir):
    size = F.col("size")
    h = trials(spark, sf_dir).select(
        "trial_id", F.when(size == 3, "odd").otherwise(F.col("status")).alias("status"), (F.col("feasible") != (size == 5)).alias("feasible"), F.when(size != 7, F.col("objective")).alias("objective"),
        F.when(size == 9, 99).otherwise(size).alias("size"), "brand", F.when(size == 11, F.array(F.lit(float("nan")))).otherwise(F.array(F.lit(1.0))).alias("rung_scores"),
    )
    return continuation.history_defects(h.union(h.where("trial_id % 50 = 2")), PART_SPACE)


@query("SELECT mode, columns, CASE WHEN mode = 'none' THEN 0 ELSE n END AS named FROM (VALUES ('full', 'space,space_hash,space_hash_version,trial_id'), ('hash', 'space_hash,space_hash_version,trial_id'), ('none', 'trial_id')) t(mode, columns), (SELECT count(*) AS n FROM part)")
def snk5_row_space(spark, sf_dir):
    rows = trials(spark, sf_dir).select("trial_id")
    made = {m: with_space(rows, PART_SPACE, m) for m in ("full", "hash", "none")}
    named = {m: d.where(F.col("space_hash") == PART_SPACE.hash()).count() if m != "none" else 0 for m, d in made.items()}
    return spark.createDataFrame([(m, ",".join(sorted(d.columns)), named[m]) for m, d in made.items()], "mode string, columns string, named bigint")


# ---- Parzen estimation -------------------------------------------------------


@query(f"""WITH {TRIALS_SQL} SELECT trial_id, round((size - 0.5) / 50, 9)::DOUBLE AS plain, round(ln(1 + (size - 0.5) / 0.5) / ln(101), 9)::DOUBLE AS logged FROM tr""")
def smp18_encodings(spark, sf_dir):
    plain, logged = Integer("n", 1, 50), Integer("n", 1, 50, log=True)
    rows = trials(spark, sf_dir)
    return rows.select("trial_id", F.round(encoded(plain, F.col("size")), 9).alias("plain"), F.round(encoded(logged, F.col("size")), 9).alias("logged"))


LINE_SPACE = Space((Integer("quantity", 1, 50), Real("discount", 0.0, 0.1, 0.01)))
KEPT = """WITH h AS (SELECT 9 * l_orderkey + l_linenumber AS trial_id, any_value(l_extendedprice) AS objective FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1) GROUP BY 1),
e AS (SELECT *, 'elite' AS role FROM h ORDER BY objective DESC, trial_id LIMIT 25), r0 AS (SELECT * FROM h ANTI JOIN e USING (trial_id)), n AS (SELECT *, 'recent' AS role FROM r0 ORDER BY trial_id DESC LIMIT 64),
r1 AS (SELECT *, 'reservoir' AS role FROM r0 ANTI JOIN n USING (trial_id) ORDER BY md5('9:' || trial_id) LIMIT 448), kept AS (SELECT * FROM e UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r1)"""


def _lines(spark, sf_dir):
    """Each line of an order as an observation; lines that share their number are left out, as ids are unique."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((9 * F.col("l_orderkey") + F.col("l_linenumber")).alias("trial_id"), F.col("l_extendedprice").alias("objective"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_discount").alias("discount"))
    once = rows.groupBy("trial_id").agg(F.count("*").alias("n")).where("n = 1").select("trial_id")
    return cut_lineage(rows.join(once, "trial_id"))


@query(f"{KEPT} SELECT trial_id, role FROM kept")
def smp19_checkpoint(spark, sf_dir):
    """A bounded sampler that has seen all lines, after it was saved and restored."""
    again = continuation.load_state(LINE_SPACE, continuation.save_state(continuation.BoundedTpe(LINE_SPACE, 9).warm(_lines(spark, sf_dir))))
    return spark.createDataFrame(list(again.roles().items()), "trial_id bigint, role string")


@query(f"{KEPT} SELECT trial_id, objective, role FROM kept")
def smp17_bounded_history(spark, sf_dir):
    """The lines' best, newest and a uniform sample of the others."""
    return continuation.bounded_history(_lines(spark, sf_dir), 9).select("trial_id", "objective", "role")


# ---- Studies -----------------------------------------------------------------


@query(f"WITH {SIGNALS} SELECT CASE WHEN trades >= 8 THEN 'told' ELSE 'abandoned' END AS outcome, count(*) AS n FROM m GROUP BY 1")
def lif3_told_or_abandoned(spark, sf_dir):
    """A sampler over the whole grid, told of feasible trials only."""
    told: list = []

    class Listed:
        left = [{"entry": e, "exit": x} for e in range(12, 21, 2) for x in range(2, 9, 2)]

        def __init__(self):
            self.left = list(self.left)

        def ask(self):
            return self.left.pop(0) if self.left else None

        def tell(self, c, objective):
            told.append("told")

        def abandon(self, c):
            told.append("abandoned")

    study = Study(EVAL_SPACE, "net_profit", evaluate.THRESHOLD_METRICS, ("num_trades >= 8",))
    study.run_adaptive(spark, Listed(), evaluate.bars_of(every_hour(spark, sf_dir), ("timestamp", "close")), evaluate.threshold, 20, batch=20)
    return spark.createDataFrame([(k, told.count(k)) for k in sorted(set(told))], "outcome string, n bigint")


