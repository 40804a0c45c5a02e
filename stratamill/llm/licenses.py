"""Licence scan by a positional rare-token index (DataFrame functions only).

A template is a licence text with mandatory key phrases, whose places in the text are
known. Inverse document frequencies of the phrases' words come from all documents. A
file is looked up by its own licence words of the highest inverse frequency: of each
phrase the ANCHORS rarest, as far as the file holds them. A file's positional index
holds where those words stand; shifting each list by the word's place in the phrase
gives candidate starts, the lists of one phrase are intersected, and a start that
survives is verified against the whole phrase.

Between phrases the postings are intersected by relative position: a phrase found at s
that stands at q in the template puts the template's beginning at s - q, and phrases
belong together if their beginnings lie no further apart than the template is long, as
names, shortening and insertions shift them. A template's score is the largest share
of its phrases that belong together, and its label is given when that is all of them.

Every place of a phrase holds the phrase's rarest word, so the lookup loses none.

Defined results: null text counts as empty (no words, null first and last, empty
labels, score 0); a null doc_id is kept; repeated rows each get a row; an empty
table gives an empty result; texts are read whole; other input columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm import license_texts as texts
from stratamill.llm.store import table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many of a phrase's rarest words are looked up; each costs one list per file.
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    """phrases stand in text in that order; a template without a text of its own is its only phrase."""

    label: str
    phrases: tuple[str, ...]
    text: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(SEPARATORS, (self.text or self.phrases[0]).lower()) if w]

    @property
    def places(self) -> list[int]:
        """Where each phrase begins in the text."""
        ws, out = self.words, []
        for phrase in self.phrases:
            p = phrase.split()
            out.append(next(i for i in range(out[-1] + 1 if out else 0, len(ws)) if ws[i : i + len(p)] == p))
        return out


TEMPLATES = (
    Template("cc-by", ("cc by",), base=True),
    Template("gpl", ("general public license",), base=True),
    Template("reserved", ("all rights reserved",), base=True),
    Template("mit", ("permission is hereby granted free of charge", "the software is provided as is"), texts.MIT),
    Template("apache", ("licensed under the apache license",), texts.APACHE),
    Template("apache-notice", ("licensed under the apache license", "in compliance with the license", "unless required by applicable law or agreed to in writing"), texts.APACHE),
    Template("bsd", ("redistribution and use in source and binary forms", "this software is provided by the copyright holders"), texts.BSD),
    Template("mpl", ("subject to the terms of the mozilla public license",), texts.MPL),
    Template("isc", ("permission to use copy modify and or distribute this software",), texts.ISC),
    Template("isc-text", ("permission to use copy modify and or distribute this software", "this permission notice appear in all copies", "the author disclaims all warranties"), texts.ISC),
    Template("unlicense", ("free and unencumbered software released into the public domain",), texts.UNLICENSE),
    Template("zlib", ("in no event will the authors be held liable", "the origin of this software must not be misrepresented", "this notice may not be removed or altered"), texts.ZLIB),
    Template("cc0", ("cc0 1 0 universal",)),
)


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, SEPARATORS, -1), lambda w: w != "")


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in templates for p in t.phrases for w in p.split()})


def idf(docs: DataFrame, words: list[str]) -> dict[str, float]:
    """Inverse document frequency of the given words over all of docs. The result is as long as the templates' vocabulary."""
    known = F.array(*map(F.lit, words))
    held = docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col("text")), known), F.lit(""))).alias("w"))
    df = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) for w in words}


def anchors(phrase: list[str], rarity: dict[str, float], most: int = ANCHORS) -> list[tuple[str, int]]:
    """(word, place) of the phrase's rarest words, the rarest first."""
    return sorted(((w, i) for i, w in enumerate(phrase)), key=lambda x: (-rarity[x[0]], x[1]))[:most]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, and places: array<struct<label,phrase,start>> of every verified phrase."""
    docs = docs.select("doc_id", "text")
    rarity = idf(docs, vocabulary(templates))
    phrases = [(t, i, p.split()) for t in templates for i, p in enumerate(t.phrases)]
    looked_up = sorted({w for _, _, p in phrases for w, _ in anchors(p, rarity)})
    rarest = sorted({anchors(p, rarity)[0][0] for _, _, p in phrases})
    words = F.col("words")
    hit = "array<struct<w:string,at:int>>"
    index = F.when(
        F.arrays_overlap(words, F.array(*map(F.lit, rarest))),
        F.filter(F.transform(words, lambda w, i: F.when(w.isin(looked_up), F.struct(w.alias("w"), i.alias("at")))), lambda h: h.isNotNull()),
    ).otherwise(F.array().cast(hit))
    places = "array<struct<label:string,phrase:int,start:int>>"

    def shifted_list(word: str, place: int) -> Column:
        return F.transform(F.filter("index", lambda h: h["w"] == word), lambda h: h["at"] - place)

    def found(t: Template, i: int, phrase: list[str]) -> Column:
        starts = None
        for w, place in anchors(phrase, rarity):
            shifted = shifted_list(w, place)
            starts = shifted if starts is None else F.array_intersect(starts, shifted)
        starts = F.array_distinct(starts)
        real = F.filter(starts, lambda s: (s >= 0) & (F.slice(words, F.greatest(s + 1, F.lit(1)), len(phrase)) == F.array(*map(F.lit, phrase))))
        return F.transform(real, lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(i).alias("phrase"), s.alias("start")))

    rows = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("index", index)
    every = F.when(F.size("index") > 0, F.concat(*(found(*p) for p in phrases))).otherwise(F.array().cast(places))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), every.alias("places"))


def digest(scanned: DataFrame, templates=TEMPLATES) -> DataFrame:
    base = [t.label for t in templates if t.base]
    of_base = F.transform(F.filter("places", lambda p: p["label"].isin(base)), lambda p: p["start"])

    def together(t):
        """The largest share of the template's phrases whose places agree."""
        own = F.filter("places", lambda p: p["label"] == t.label)
        if len(t.phrases) == 1:
            return F.when(F.size(own) > 0, 1.0).otherwise(0.0)
        at = F.array(*map(F.lit, t.places))
        begins = F.transform(own, lambda p: F.struct(p["phrase"].alias("phrase"), (p["start"] - F.element_at(at, p["phrase"] + 1)).alias("begin")))

        def agreeing(x):
            return F.size(F.array_distinct(F.transform(F.filter(begins, lambda y: F.abs(y["begin"] - x["begin"]) <= len(t.words)), lambda y: y["phrase"])))

        return F.coalesce(F.array_max(F.transform(begins, agreeing)), F.lit(0)) / F.lit(float(len(t.phrases)))

    share = {t.label: together(t) for t in templates}

    def labels(ts):
        given = F.array(*(F.when(share[t.label] == 1.0, F.lit(t.label)) for t in ts))
        return F.array_join(F.array_sort(F.filter(given, lambda x: x.isNotNull())), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(of_base).cast("long").alias("first_word"),
        F.array_max(of_base).cast("long").alias("last_word"),
        labels([t for t in templates if t.base]).alias("base_labels"),
        labels(templates).alias("labels"),
        F.greatest(*share.values()).alias("score"),
    )


def op5_license_scan(spark, sf_dir):
    return digest(scan(table(spark, sf_dir, "documents")))


def _oracle(templates=TEMPLATES) -> str:
    def places(phrase):
        p = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p, 1))
        return f"[i FOR i IN range(0, greatest(len(w) - {len(p) - 1}, 0)) IF {same}]"

    cols, shares, labels, base_labels, base = [], [], [], [], []
    for t in templates:
        mine = []
        for i, p in enumerate(t.phrases):
            name = f"p_{t.label.replace('-', '_')}_{i}"
            cols.append(f"{places(p)} AS {name}")
            mine.append(name)
        if len(mine) == 1:
            share = f"CAST(len({mine[0]}) > 0 AS INT) / 1.0::DOUBLE"
        else:
            q = t.places
            near = [
                f"list_transform({m}, lambda s: " + " + ".join(f"CAST(len(list_filter({o}, lambda y: abs((y - {q[j]}) - (s - {q[i]})) <= {len(t.words)})) > 0 AS INT)" for j, o in enumerate(mine)) + ")"
                for i, m in enumerate(mine)
            ]
            share = f"coalesce(list_max(list_concat({', '.join(near)})), 0) / {float(len(mine))}::DOUBLE"
        shares.append(share)
        label = f"CASE WHEN {share} = 1 THEN '{t.label}' END"
        labels.append(label)
        if t.base:
            base_labels.append(label)
            base += mine
    every = "list_concat(" + ", ".join(base) + ")"

    def joined(xs):
        return f"coalesce(array_to_string(list_sort(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)), ','), '')"

    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {', '.join(cols)} FROM w),
b AS (SELECT *, {every} AS base FROM p)
SELECT doc_id, n_words, CAST(len(base) AS BIGINT) AS n_base, CAST(list_min(base) AS BIGINT) AS first_word, CAST(list_max(base) AS BIGINT) AS last_word,
       {joined(base_labels)} AS base_labels, {joined(labels)} AS labels, greatest({', '.join(shares)}) AS score
FROM b"""


ORACLE_OP5 = _oracle()
