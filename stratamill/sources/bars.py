"""Bars: CSV and fixed-width binary readers, invariants, slices, resampling and window plans."""

from __future__ import annotations

import hashlib
import math
import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.operators.ordered import lag_within, lead_within, numbered
from stratamill.sources.trials import loads_strict
from stratamill.types import BAR, Refusal

COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")
#: One binary record: five little-endian doubles and the bar's opening time in ms.
RECORD = struct.Struct("<5dq")
#: Bars that follow each other are dealt out by blocks of so many ms, or so many records.
BLOCK_MS, BLOCK_RECORDS = 1 << 31, 1 << 16
_UNIT_MS = {"D": 86_400_000, "W": 7 * 86_400_000, "S": 1000}
_TIMEFRAME = re.compile(r"([1-9][0-9]{0,4})$|([1-9][0-9]{0,3})([DWMS])$")


def timeframe(token: str) -> tuple[int, str]:
    """(n, unit) of `15`, `4D`, `1M` ...; a bare number is minutes."""
    m = _TIMEFRAME.match(token)
    if not m:
        raise Refusal("timeframe", token)
    return (int(m[1]), "m") if m[1] else (int(m[2]), m[3])


def bar_close(ts: Column, token: str) -> Column:
    """Closing time of a bar that opens at ts (ms). Months are calendar months, UTC, the day held within the month."""
    n, unit = timeframe(token)
    if unit == "M":
        at = F.timestamp_millis(ts)
        day = F.add_months(at.cast("date"), n)
        within = F.unix_millis(at) - F.unix_millis(F.date_trunc("day", at))
        return F.unix_millis(day.cast("timestamp")) + within
    return ts + n * (60_000 if unit == "m" else _UNIT_MS[unit])


def read_csv(spark: SparkSession, path: str, extra: tuple[str, ...] = (), optional: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """Bars of a CSV file with a header in any case; further columns are allowed. Rows that don't parse are refused, and so is a file without rows.

    placed: add `place` (file, start, line), which rises with the rows' order in the file.
    """
    raw = spark.read.option("header", False).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).text(path)
    head = raw.where(F.trim("value") != "").first()
    if head is None:
        raise Refusal("csv_empty", path)
    names = [x.strip().lower() for x in head["value"].lstrip("﻿").split(",")]
    if "" in names or len(set(names)) != len(names):
        raise Refusal("csv_header", str(names))
    wanted = [c for c in (*COLUMNS, *extra) if c in names or c not in optional]
    if missing := [c for c in wanted if c not in names]:
        raise Refusal("csv_columns", ", ".join(missing))
    parts = F.split(F.regexp_replace("value", "^﻿", ""), ",", -1)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    rows = raw.select("value", *([place.alias("place")] if placed else [])).where((F.trim("value") != "") & (F.col("value") != head["value"])).select(parts.alias("p"), *(["place"] if placed else []))
    kind = {"timestamp": "bigint", "time_close": "bigint"}
    cells = {c: F.trim(F.get("p", F.lit(names.index(c)))) for c in wanted}
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    typed = rows.select(F.size("p").alias("_n"), *(F.when(cells[c].rlike(number), cells[c].try_cast(kind.get(c, "double"))).alias(c) for c in wanted), *(["place"] if placed else []))
    bad = (F.col("_n") < len(names)) | F.greatest(*(F.col(c).isNull().cast("int") for c in wanted), F.lit(0)).cast("boolean")
    seen = typed.agg(F.count("*").alias("n"), F.any_value(F.when(bad, F.struct(*wanted)), ignoreNulls=True).alias("bad")).first()
    if seen["bad"] is not None:
        raise Refusal("csv_row", str(seen["bad"].asDict()))
    if not seen["n"]:
        raise Refusal("csv_empty", path)
    return typed.drop("_n")


def read_binary(spark: SparkSession, path: str, sidecar: dict | None = None) -> DataFrame:
    """Bars of 48-byte records, with `record` as their place in the file; a sidecar's count and ends are checked."""

    def records(batches):
        import numpy as np
        import pyarrow as pa

        kind = np.dtype([*((c, "<f8") for c in COLUMNS[1:]), ("timestamp", "<i8")])
        for batch in batches:
            for content, name in zip(batch.column("content").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if len(content) % kind.itemsize:
                    raise Refusal("binary_size", f"{name}: {len(content)}")
                x = np.frombuffer(content, kind)
                yield pa.record_batch({"record": pa.array(np.arange(len(x)), pa.int64())} | {c: pa.array(x[c]) for c in COLUMNS})

    schema = "record bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BAR.fields)
    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(records, schema)
    if sidecar:
        if sidecar.get("record_size") != RECORD.size:
            raise Refusal("sidecar_record_size", str(sidecar.get("record_size")))
        seen = out.agg(F.count("*").alias("count"), F.min_by("timestamp", "record").alias("first_ts"), F.max_by("timestamp", "record").alias("last_ts")).first().asDict()
        digests = {r["d"] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).limit(2).collect()}
        if "sha256" in sidecar and digests != {sidecar["sha256"]}:
            raise Refusal("sidecar_sha256", path)
        for k, v in seen.items():
            if sidecar.get(k) != v:
                raise Refusal("sidecar_" + k, f"{sidecar.get(k)} is {v}")
    return out


def sidecar_of(content: bytes, symbol: str, tf: str) -> dict:
    rows = list(RECORD.iter_unpack(content))
    return {"record_size": RECORD.size, "symbol": symbol, "tf": tf, "count": len(rows), "first_ts": rows[0][5], "last_ts": rows[-1][5], "sha256": hashlib.sha256(content).hexdigest()}


def violations(bars: DataFrame, keys: list[str], order: str, binary: bool = False) -> DataFrame:
    """Rows that break an invariant, with the first reason: prices that aren't finite, volume (a missing one passes in binary bars), times that don't rise.

    order: what the rows follow each other by: `record` of binary bars, `place` of CSV rows, or a time.
    """

    def odd(c):
        return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))

    if order == "place":
        block, inside = F.struct("place.file", "place.start"), "place"
    else:
        block, inside = F.floor(F.col(order) / (BLOCK_MS if order == "timestamp" else BLOCK_RECORDS)), order
    bars = lag_within(bars.withColumn("_block", block), keys, "_block", [inside], "timestamp", "_prior").drop("_block")
    volume = (F.col("volume") < 0) | (F.abs("volume") == F.lit(float("inf")))
    reason = (
        F.when(odd("open") | odd("high") | odd("low") | odd("close"), "price")
        .when(volume if binary else volume | odd("volume"), "volume")
        .when(F.col("timestamp") <= F.col("_prior"), "order")
    )
    return bars.withColumn("reason", reason).where("reason is not null").drop("_prior")


def sliced(bars: DataFrame, keys: list[str], begin: int, length: int) -> DataFrame:
    """The `length` bars from number `begin` on, by key."""
    n = numbered(bars.withColumn("_block", F.floor(F.col("timestamp") / BLOCK_MS)), keys, "_block", ["timestamp"], "_n")
    return n.where((F.col("_n") >= begin) & (F.col("_n") < begin + length)).drop("_n", "_block")


def between(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Bars with start <= timestamp < end: a predicate that reaches the scan."""
    return bars.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))


def resample(bars: DataFrame, keys: list[str], ms: int) -> DataFrame:
    """Bars of `ms`, put together from shorter ones by partial aggregation."""
    bucket = F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(ms))
    return bars.groupBy(*keys, bucket.alias("bucket")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars")
    ).withColumnRenamed("bucket", "timestamp")


def feed_checks(feed: DataFrame, token: str) -> DataFrame:
    """timestamp, time_close, ok of another symbol's feed: each bar closes after it opens, and before or when the next opens."""
    close = F.coalesce("time_close", bar_close(F.col("timestamp"), token)) if "time_close" in feed.columns else bar_close(F.col("timestamp"), token)
    rows = lead_within(feed.withColumn("time_close", close), ["symbol"], "timestamp", BLOCK_MS, "_next")
    return rows.withColumn("ok", (F.col("timestamp") < F.col("time_close")) & F.coalesce(F.col("time_close") <= F.col("_next"), F.lit(True))).drop("_next")


def window_plan(bars: DataFrame, keys: list[str], start: int, end: int, floor: int, script_ms: int, pre_roll: int) -> DataFrame:
    """keys and how the bars of a selected window [start, end) are fed: `pre_roll` script bars before it as far as there are, none before `floor`."""
    bucket = F.floor(F.col("timestamp") / script_ms)
    cut = bars.where((F.col("timestamp") >= floor) & (F.col("timestamp") < end)).withColumn("bucket", bucket).withColumn("before", F.col("timestamp") < start)
    groups = cut.where("before").select(*keys, "bucket").distinct()
    kept = groups.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("bucket").desc()))).where(F.col("_r") <= pre_roll)
    first = kept.groupBy(*keys).agg(F.min("bucket").alias("first_bucket"), F.count("*").alias("pre_groups"))
    rows = cut.join(first, keys, "left").where(~F.col("before") | (F.col("bucket") >= F.col("first_bucket")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("fed_bars"),
        F.sum(F.col("before").cast("long")).alias("pre_bars"),
        F.sum((~F.col("before")).cast("long")).alias("window_bars"),
        F.count_distinct("bucket").alias("script_bars"),
        F.coalesce(F.max("pre_groups"), F.lit(0)).alias("pre_groups"),
        (F.coalesce(F.max("pre_groups"), F.lit(0)) < pre_roll).alias("short"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def plan_defect(floor: int, end: int) -> Column:
    """The first identity that a row of window_plan() breaks: its parts make up its bars, and no bar lies before the floor or at the end; null if none."""
    return (
        F.when(F.col("fed_bars") != F.col("pre_bars") + F.col("window_bars"), "sum")
        .when(F.col("first_ts") < floor, "first")
        .when((F.col("last_ts") >= end) | (F.col("last_ts") < F.col("first_ts")), "last")
    )


def snapshot(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, modified) of the input's files, to be compared after a run."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_millis("modificationTime").alias("at"))
    return sorted(tuple(r) for r in files.collect())


def verify_unchanged(spark: SparkSession, path: str, before: list) -> None:
    if snapshot(spark, path) != before:
        raise Refusal("input_changed", path)


#: Symbols, and feeds in all, that an index may name.
MOST_SYMBOLS, MOST_FEEDS = 256, 256
#: Facts of an instrument that are read (fixed names): texts, numbers, and one whole number.
FACT_TEXTS, FACT_NUMBERS, FACT_WHOLE = ("tickerid", "type", "timezone", "session", "currency"), ("mincontract", "mintick", "pointvalue"), "series_origin_ms"


def symbol_info(raw) -> dict:
    """An instrument's facts from JSON text or an object, flat or below `syminfo`; unknown facts and null are passed over."""
    raw = loads_strict(raw) if isinstance(raw, str) else raw
    if isinstance(raw, dict) and isinstance(raw.get("syminfo"), dict):
        raw = raw["syminfo"]
    if raw is None:
        return {}
    if not isinstance(raw, dict):
        raise Refusal("syminfo", "not an object")
    out = {}
    for name, v in raw.items():
        if v is None:
            continue
        number = type(v) in (int, float)
        if name in FACT_TEXTS:
            good = isinstance(v, str) and 0 < len(v) <= 256 and all(ord(c) >= 32 for c in v)
        elif name in FACT_NUMBERS:
            good = number and math.isfinite(v) and v > 0
        elif name == FACT_WHOLE:
            good = type(v) is int
        else:
            continue
        if not good:
            raise Refusal("syminfo", name)
        out[name] = v
    return out


def load_index(text: str, base: str = "") -> list[dict]:
    """symbol, syminfo, timeframe, path of every feed that an index names; paths are relative to `base`, the index's folder."""
    raw, out = loads_strict(text), []
    if "feeds" in raw and isinstance(raw["feeds"], list):
        out = [{"symbol": e["symbol"], "syminfo": {}, "timeframe": e["timeframe"], "path": e["path"]} for e in raw["feeds"]]
    else:
        for symbol, entry in raw.items():
            if set(entry) - {"syminfo", "feeds"}:
                raise Refusal("feeds", f"{symbol}: {sorted(set(entry) - {'syminfo', 'feeds'})}")
            facts = symbol_info(entry.get("syminfo"))
            out += [{"symbol": symbol, "syminfo": facts, "timeframe": t, "path": p} for t, p in (entry.get("feeds") or {}).items()]
    if len(out) > MOST_FEEDS or len({e["symbol"] for e in out}) > MOST_SYMBOLS or len(raw) > MOST_SYMBOLS:
        raise Refusal("feeds", f"{len(out)} feeds")
    for e in out:
        timeframe(e["timeframe"])
        if base and not re.match(r"([a-z0-9]+:)?/", e["path"]):
            e["path"] = f"{base.rstrip('/')}/{e['path']}"
    return out
