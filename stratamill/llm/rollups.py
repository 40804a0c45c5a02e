"""Token counts as delta-maintained rollups.

A batch of changes inserts, deletes or revises the token counts of documents. It's
reduced to signed sums by source, language and tokenizer version (partial sums come
before the shuffle, so a source that holds a third of all rows costs nothing extra)
and committed as one folder of a ledger under the batch's name. Committing a batch again
changes nothing, also after it was folded: a job that is run twice, or that died and is run
again, counts once. Totals are the sums over all folders that were published, none for a
ledger without any, and the cost of a batch follows the batch and not the corpus. fold()
puts old folders together.

Defined results: a null source, language or version is a group of its own; a null
count is 0; a change with an unknown kind is refused; repeated rows are repeated
changes; an empty batch commits nothing but its name; groups whose documents and
tokens both come to 0 aren't reported; other input columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.llm.store import session_dir, stage, table
from stratamill.llm.tokens import encode_column, encoder, tokenizer_path
from stratamill.llm.words import pieces

BY = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs bigint, tokens bigint"


def signed(changes: DataFrame) -> DataFrame:
    """source, lang, version, docs, tokens: what a batch adds.

    changes: source, lang, version, kind (insert, delete, revise), tokens, and for
    revise old_tokens. delete takes away `tokens`.
    """
    zero = F.lit(0).cast("long")
    tokens = F.coalesce("tokens", zero)
    old = F.coalesce("old_tokens", zero) if "old_tokens" in changes.columns else zero
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))))
    by = F.when(F.col("kind") == "insert", tokens).when(F.col("kind") == "delete", -tokens).otherwise(tokens - old)
    return changes.groupBy(*BY).agg(F.sum(docs).cast("long").alias("docs"), F.sum(by).cast("long").alias("tokens"))


class Ledger:
    """A folder of signed sums (`data`), and one of names (`names`), a small file for each committed batch.

    A batch's sums are written to a folder of their own that nobody reads, and count from
    the moment when the file with the batch's name appears, which one rename brings about. A
    batch whose name is there, or was folded, isn't added again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._made = hadoop.Path
        self._store = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._store.mkdirs(hadoop.Path(f"{self.path}/names"))

    def _names(self) -> dict[str, dict]:
        """What each name's file says: its folder, and the batches that it stands for."""
        files = self._store.listStatus(self._made(f"{self.path}/names"))
        found = [f.getPath() for f in files if f.getPath().getName().endswith(".json")]
        if not found:
            return {}
        rows = self.spark.read.schema("name string, folder string, batches array<string>").json([p.toString() for p in found]).collect()  # a row for each name
        return {r["name"]: r.asDict() for r in rows}

    def _publish(self, name: str, folder: str, batches: list[str]) -> None:
        made, at = self._made(f"{self.path}/names/{folder}.tmp"), self._made(f"{self.path}/names/{name}.json")
        out = self._store.create(made, True)
        out.write(bytearray(json.dumps({"name": name, "folder": folder, "batches": batches}).encode()))
        out.close()
        if not self._store.exists(at):
            self._store.rename(made, at)

    @staticmethod
    def _plain(name: str) -> str:
        if not name or any(not (c.isalnum() or c in "-_.") for c in name):
            raise ValueError(f"a batch needs a plain name: {name!r}")
        return name

    def batches(self) -> set[str]:
        """Names of all batches that were committed, those that were folded too."""
        known = self._names()
        return set(known) | {b for k in known.values() for b in k["batches"]}

    def _live(self) -> dict[str, dict]:
        known = self._names()
        gone = {b for k in known.values() for b in k["batches"]}
        return {n: k for n, k in known.items() if n not in gone}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch, unless it was added before; whether it was added now."""
        if self._plain(batch) in self.batches():
            return False
        folder = uuid.uuid4().hex
        signed(changes).write.parquet(f"{self.path}/data/{folder}")
        self._publish(batch, folder, [])
        return True

    def deltas(self, names: Iterable[str] | None = None) -> DataFrame:
        """The sums of the batches that count, or of some of them."""
        folders = [k["folder"] for n, k in self._live().items() if names is None or n in names]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def totals(self) -> DataFrame:
        sums = self.deltas().groupBy(*BY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 or tokens != 0")

    def fold(self, batches: list[str], name: str) -> None:
        """Put the sums of some batches together as one, `name`, from one moment to the next. The batches' names stay known, so none of them can be added again."""
        if self._plain(name) in self.batches():
            return
        folded = sorted(set(batches) & set(self._live()))
        folder = uuid.uuid4().hex
        sums = self.deltas(folded).groupBy(*BY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{self.path}/data/{folder}")
        self._publish(name, folder, folded)


WORD_1 = r"[^\x20\x09-\x0D]+"
WORD_2 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def counted_by(docs: DataFrame, version: str, path: str, column: str = "tokens") -> DataFrame:
    """docs (with a column text) with version and the number of ids that a public tokenizer's file makes of each text. Columns of those names are replaced."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("version", column.lower())))

    def run(batches):
        for batch in pieces(batches):
            col, held = batch.column(batch.schema.names.index("text")), encoder(path)
            if held.drops_space:
                n = encode_column(col, path)[1]
            else:
                n = [len(e.ids) for e in held.tokenizer.encode_batch_fast([t or "" for t in col.to_pylist()], add_special_tokens=False)]
            yield pa.record_batch([*batch.columns, pa.array([version] * batch.num_rows, pa.string()), pa.array(n, pa.int64())], names=[*batch.schema.names, "version", column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, version string, `{column}` bigint")


def _batches(spark, sf_dir, counted: DataFrame, versions: tuple[str, str]) -> DataFrame:
    """Three batches over counted (doc_id, source, lang, a, b): the counts a and b by two versions, a recount of the first that also counts each text's end, and the removal of what `labels` calls toxic. One is given twice, and two are folded."""
    first, second = versions
    both = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.col(c).alias("tokens")) for v, c in ((first, "a"), (second, "b")))))
    ledger = Ledger(spark, f"{session_dir(spark)}/{uuid.uuid4().hex}/rollups")
    ledger.commit("load", counted.select("source", "lang", both.alias("v"), F.lit("insert").alias("kind")).select("source", "lang", "v.*", "kind"))
    recount = counted.select("source", "lang", F.lit(first).alias("version"), F.lit("revise").alias("kind"), (F.col("a") + 1).alias("tokens"), F.col("a").alias("old_tokens"))
    ledger.commit("recount", recount)
    ledger.fold(["load", "recount"], "first-two")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = counted.withColumn("a", F.col("a") + 1).join(toxic, "doc_id", "left_semi")
    gone = gone.select("source", "lang", both.alias("v"), F.lit("delete").alias("kind")).select("source", "lang", "v.*", "kind")
    ledger.commit("takedown", gone)
    ledger.commit("takedown", gone)  # a replay
    ledger.commit("recount", recount)  # another, of what was folded
    return ledger.totals()


#: A public tokenizer's file, whose name is a version.
VERSION = "word_bpe_49k"


def op7_token_rollups(spark, sf_dir):
    """Counts of a public tokenizer's ids, and of words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = counted_by(docs, VERSION, tokenizer_path(f"{VERSION}.json"), "a")
    counted = stage(counted.select("doc_id", "source", "lang", "a", count(F.col("text"), WORD_2).alias("b")), "rollup_counts")
    return _batches(spark, sf_dir, counted, (VERSION, "words-2"))


def rollups_of_words(spark, sf_dir):
    """The same ledger with two counts that SQL can express."""
    docs = table(spark, sf_dir, "documents")
    counted = stage(docs.select("doc_id", "source", "lang", count(F.col("text"), WORD_1).alias("a"), count(F.col("text"), WORD_2).alias("b")), "rollup_counts")
    return _batches(spark, sf_dir, counted, ("words-1", "words-2"))


ORACLE_WORDS = """
WITH d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS a,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS b
  FROM documents),
k AS (SELECT * FROM d WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
v AS (SELECT source, lang, 'words-1' AS version, a + 1 AS tokens FROM k UNION ALL SELECT source, lang, 'words-2', b FROM k)
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens
FROM v GROUP BY ALL"""
