"""From raw documents to token blocks, stage by stage.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before it
kept and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.llm import decontam, langid, mixing, neardup, tokens
from stratamill.llm.store import bound_batches, free_name, stage, table

#: A language that is less likely than this is no decision.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages stay. Where there is no label to learn from, all do.

    A text that is null, empty or without a letter has no language and goes, as do texts of
    which no language is more likely than SURE; repeated rows go or stay together; an empty table gives an empty one.
    """
    bound_batches(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    pred, score = (free_name(c, docs.columns) for c in ("_lang_pred", "_lang_score"))
    found = langid.predict(model, docs, pred, score)
    return found.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= SURE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest doc_id (of equal ones that with the smaller text hash).

    Null and empty texts are one class. A null doc_id comes last. Of repeated rows that whose
    columns have the smallest hash stays, once; an empty table gives an empty one.
    """
    bound_batches(spark)
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay, those without a text too. Repeated rows go or stay together; without items or documents nothing goes."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A row without words adds none; a null source is a source; ties at a threshold go by hash; an empty table gives an empty one."""
    return mixing.take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks are written and read back: place, length and checksum of every document's ids. A null text is the end id alone, a null doc_id comes first, repeated rows follow each other by text; an empty table gives no rows."""
    bound_batches(spark)
    return tokens.token_ids(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: Language models and singular vectors have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
