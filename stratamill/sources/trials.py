"""Trial rows and candidate lists from JSON, with strict admission before anything is typed."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.plans.space import Categorical, Space
from stratamill.storage import cut_lineage
from stratamill.types import TRIAL, Refusal

#: Limits of one candidate list (fixed values).
MOST_LINES, MOST_BYTES, MOST_LINE_BYTES = 50_000, 32 << 20, 64 << 10


def loads_strict(text: str):
    """JSON without repeated keys, NaN, infinities and numbers out of range."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise Refusal("json_repeated_key", str([k for k, _ in items]))
        return out

    def constant(name):
        raise Refusal("json_constant", name)

    def number(s):
        v = float(s)
        if not math.isfinite(v):
            raise Refusal("json_range", s)
        return v

    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
    except json.JSONDecodeError as e:
        raise Refusal("json_syntax", str(e)) from e


def as_row(raw) -> tuple:
    """A parsed trial as a TRIAL row."""
    if type(raw) is not dict:
        raise Refusal("row_object")
    for k in ("parameters", "metrics", "backtest", "space"):
        if raw.get(k) is not None and type(raw[k]) is not dict:
            raise Refusal(f"row_{k}")
    if type(raw.get("trial_id")) is not int or not 0 <= raw["trial_id"] < 1 << 63:
        raise Refusal("row_trial_id", str(raw.get("trial_id")))
    if type(raw.get("status")) is not str or type(raw.get("feasible")) is not bool:
        raise Refusal("row_status", str(raw.get("status")))
    objective = raw.get("objective")
    if objective is not None and type(objective) not in (int, float):
        raise Refusal("row_objective", str(objective))
    numbers = {k: float(v) if type(v) in (int, float) else None for k, v in (raw.get("metrics") or {}).items()}
    parameters = {k: json.dumps(v) for k, v in (raw.get("parameters") or {}).items()}
    counters = {k: v for k, v in (raw.get("backtest") or {}).items() if type(v) is int}
    return raw["trial_id"], raw["status"], raw["feasible"], None if objective is None else float(objective), parameters, numbers, counters, raw.get("space_hash")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """TRIAL rows of JSON lines, parsed where the lines are; blank lines are skipped, a bad line ends the read with its reason."""

    def parse(batches: Iterator):
        import pandas as pd

        for batch in batches:
            rows = [as_row(loads_strict(x)) for x in batch["value"] if x.strip()]
            yield pd.DataFrame(rows, columns=[f.name for f in TRIAL.fields])

    return spark.read.text(path).mapInPandas(parse, TRIAL)


def read_result(spark: SparkSession, text: str, source_index: int = 0) -> DataFrame:
    """TRIAL rows and source_index of a result document: ancestors first, then its own trials; a document that kept only some of them is refused."""
    doc = loads_strict(text)
    if type(doc) is list:
        rows = doc
    elif "trials" in doc:
        if doc.get("trials_out", "all") != "all":
            raise Refusal("result_incomplete", str(doc["trials_out"]))
        if "completed" in doc and doc["completed"] != len(doc["trials"]):
            raise Refusal("result_count", f"{doc['completed']} and {len(doc['trials'])}")
        rows = [*doc.get("warm_start_trials", []), *doc["trials"]]
    else:
        rows = [doc]
    return spark.createDataFrame([as_row(r) for r in rows], TRIAL).withColumn("source_index", F.lit(source_index))


def _typed(d, v):
    """v as the dimension's column holds it; a value of another type is refused."""
    if isinstance(d, Categorical):
        if v is None or type(v) in map(type, d.choices):
            return v
        if type(v) is int and float in map(type, d.choices):
            return float(v)
    elif type(v) is {"Integer": int, "Real": float, "Boolean": bool}[type(d).__name__] and (type(v) is not int or -(1 << 63) <= v < 1 << 63):
        return v
    raise Refusal("candidates_type", d.name)


def _kind(d) -> str:
    value = d.choices[0] if isinstance(d, Categorical) else {"Integer": 0, "Real": 0.0, "Boolean": False}[type(d).__name__]
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")


def _admitted(space: Space):
    """The lines of each list: its path, their places, values and faults. A list with too many lines is one fault."""
    fields = [f"_{i}" for i in range(len(space.dimensions))]

    def lines(content: bytes) -> Iterator[tuple]:
        found = content.split(b"\n")
        if not found[-1]:
            found.pop()
        if len(found) > MOST_LINES:
            yield 0, (None,) * len(fields), "candidates_lines", str(len(found))
            return
        for i, line in enumerate(found):
            try:
                if len(line) > MOST_LINE_BYTES:
                    raise Refusal("candidates_line")
                try:
                    raw = loads_strict(line.decode())
                except UnicodeDecodeError as e:
                    raise Refusal("candidates_utf8", e.reason) from e
                if type(raw) is not dict or set(raw) != set(space.names):
                    raise Refusal("candidates_keys")
                yield i, tuple(_typed(d, raw[d.name]) for d in space.dimensions), None, None
            except Refusal as e:
                yield i, (None,) * len(fields), e.code, e.detail

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                at, values, codes, details = zip(*lines(bytes(content)), strict=True)
                columns = dict(zip(fields, (pd.Series(v, dtype=object) for v in zip(*values, strict=True)), strict=True))
                yield pd.DataFrame({"_path": path, "_at": at, **columns, "_code": pd.Series(codes, dtype=object), "_detail": pd.Series(details, dtype=object)})

    return run, "_path string, _at bigint, " + ", ".join(f"{f} {_kind(d)}" for f, d in zip(fields, space.dimensions, strict=True)) + ", _code string, _detail string"


def write_candidates(vectors: DataFrame, order: str, path: str) -> None:
    """vectors (order and the dimensions) as candidate lists under path: in that order, as many as their limit of lines asks for."""
    names = [c for c in vectors.columns if c != order]
    vectors.orderBy(order).select(*names).write.option("maxRecordsPerFile", MOST_LINES).json(path)


def read_candidates(spark: SparkSession, path: str, space: Space) -> DataFrame:
    """trial_id (the line's place) and the dimensions; repeated vectors stay. path may stand for any number of lists: they follow each other by their paths, and the limits are each one's. All lists are admitted or none of them; a list is one task's."""
    files = spark.read.format("binaryFile").load(path)
    if long := files.where(F.col("length") > MOST_BYTES).select("length").head():
        raise Refusal("candidates_bytes", str(long[0]))
    run, schema = _admitted(space)
    rows = cut_lineage(files.where("length > 0").select("path", "content").mapInPandas(run, schema))
    counts = rows.groupBy("_path").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1))  # a row for each list
    first = counts.select("_path", F.coalesce(before, F.lit(0)).alias("_first"))
    placed = rows.join(first, "_path").withColumn("trial_id", F.col("_first") + F.col("_at"))
    if bad := placed.where("_code is not null").orderBy("trial_id").select("trial_id", "_code", "_detail").head():
        raise Refusal(bad["_code"], f"{bad['trial_id']}: {bad['_detail']}" if bad["_detail"] else str(bad["trial_id"]))
    frame = placed.select("trial_id", *(F.col(f"_{i}").alias(n) for i, n in enumerate(space.names)))
    if not rows.head(1):
        raise Refusal("candidates_empty")
    if bad := space.issues(frame).orderBy("trial_id").head():
        raise Refusal("candidates_value", f"{bad['trial_id']}: {bad['issue']}")
    return frame


def common_space(sources: DataFrame) -> str:
    """The one space hash that all sources recorded."""
    found = [r[0] for r in sources.select("space_hash").distinct().limit(2).collect()]
    if len(found) != 1 or found[0] is None:
        raise Refusal("space_differs", str(found))
    return found[0]


def common_spaces(rows: DataFrame) -> DataFrame:
    """source, common, space_hash: whether the rows (source, space_hash) of each set of sources recorded one space."""
    g = rows.groupBy("source").agg(F.min("space_hash").alias("low"), F.max("space_hash").alias("high"), F.max(F.col("space_hash").isNull()).alias("none"))
    common = (F.col("low") == F.col("high")) & ~F.col("none")
    return g.select("source", F.coalesce(common, F.lit(False)).alias("common"), F.when(common, F.col("low")).alias("space_hash"))
