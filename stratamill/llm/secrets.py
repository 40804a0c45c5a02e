"""Secret scan over a trigram inverted index (DataFrame functions only).

A rule is a regular expression with an optional length test on one group. From
every regex a Boolean query over lower-cased trigrams is derived: whatever the
regex matches must contain those trigrams. The index keeps, for each block of
documents and each trigram that some rule asks for, the posting list of row keys.
AND intersects posting lists, OR unites them; only rows that come out are verified
with the regex. A rule from which no mandatory trigram follows is run on all rows.

Defined results: null text counts as empty (no spans); a null doc_id is kept;
repeated rows each get their own result row (they share an index key, which is
harmless because the key only selects candidates); an empty table gives an empty
result; further columns of the input are ignored. Texts are always searched whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm.store import stage

#: Postings of one list never exceed about this many rows: a block holds so many documents on average.
BLOCK_ROWS = 512
#: Sets of literal strings larger than this are not enumerated when a query is derived.
MAX_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """kind: label in the spans; pattern: Java regex; group/min_len: a match stays if that group has so many characters; base: belongs to the contract."""

    kind: str
    pattern: str
    group: int = 0
    min_len: int = 0
    base: bool = False


#: `[0-9a-f]+` of 24 characters or more is written with its bound: both take the same maximal runs.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


# ---- Boolean trigram queries -------------------------------------------------
# A query is None (every row), a trigram, or ("and" | "or", frozenset of queries).


def _combine(op: str, parts):
    parts = list(parts)
    if op == "or" and any(p is None for p in parts):
        return None
    flat = set()
    for p in parts:
        if p is None:
            continue
        flat |= p[1] if isinstance(p, tuple) and p[0] == op else {p}
    if not flat:
        return None
    if op == "or":  # what another alternative already implies goes
        own = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset({q}) for q in flat}
        flat = {q for q in flat if not any(own[o] < own[q] for o in flat)}
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _of_strings(strings):
    return _combine("or", (_combine("and", {s[i : i + 3] for i in range(len(s) - 2)}) for s in strings))


def _walk(nodes):
    """(exact strings or None, query of what isn't in them)."""
    query, run, whole = None, {""}, True
    for op, arg in nodes:
        exact, q = _node(op, arg)
        query = _combine("and", (query, q))
        if exact is not None and len(run) * len(exact) <= MAX_EXACT:
            run = {a + b for a in run for b in exact}
        else:
            query = _combine("and", (query, _of_strings(run)))
            run, whole = exact or {""}, False
    return (run, query) if whole else (None, _combine("and", (query, _of_strings(run))))


def _node(op, arg):
    if op == rc.LITERAL:
        return {chr(arg).lower()}, None
    if op == rc.IN:
        if all(o == rc.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}, None
        return None, None
    if op == rc.AT:
        return {""}, None
    if op == rc.SUBPATTERN:
        return _walk(list(arg[3]))
    if op == rc.BRANCH:
        found = [_walk(list(x)) for x in arg[1]]
        if all(e is not None and q is None for e, q in found) and sum(len(e) for e, _ in found) <= MAX_EXACT:
            return set().union(*(e for e, _ in found)), None
        return None, _combine("or", (_combine("and", (q, _of_strings(e) if e is not None else None)) for e, q in found))
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, sub = arg
        exact, q = _walk(list(sub))
        if exact is not None and q is None and high != rc.MAXREPEAT and high <= 5:
            out = set()
            for n in range(low, high + 1):
                power = {""}
                for _ in range(n):
                    power = {a + b for a in power for b in exact}
                    if len(power) > MAX_EXACT:
                        return None, None
                out |= power
            if len(out) <= MAX_EXACT:
                return out, None
        return None, (_combine("and", (q, _of_strings(exact) if exact is not None else None)) if low else None)
    return None, None


def trigram_query(pattern: str):
    """The Boolean query over lower-cased trigrams that every match of the pattern fulfils; None if there is none."""
    exact, query = _walk(list(rp.parse(pattern)))
    return query if exact is None else _combine("and", (query, _of_strings(exact)))


def trigrams(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


# ---- Index and candidates ----------------------------------------------------


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, vocabulary: list[str], blocks: int) -> DataFrame:
    """(block, trigram, postings): the rows of each block whose lower-cased text contains the trigram."""
    # a text is lowered once, in a projection of its own; array_except drops the nulls in generated code
    low = docs.select(row_key().alias("k"), F.lower("text").alias("low"))
    held = F.array_except(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in vocabulary)), F.array(F.lit(None).cast("string")))
    return (
        low.select("k", F.explode(held).alias("trigram"))
        .groupBy(F.pmod("k", F.lit(blocks)).alias("block"), "trigram")
        .agg(F.collect_set("k").alias("postings"))
    )


def _postings(query, of: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(of[query], F.array().cast("array<bigint>"))
    parts = [_postings(q, of) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def candidates(docs: DataFrame, rules=RULES) -> DataFrame | None:
    """(k, kinds): for each row key the rules whose trigram query its postings fulfil."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    if not asked:
        return None
    blocks = max(1, docs.count() // BLOCK_ROWS)
    index = build_index(docs, sorted(set().union(*map(trigrams, asked.values()))), blocks)
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("of"))
    found = lists.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), _postings(q, F.col("of")).alias("ks")) for k, q in asked.items()))).alias("c"))
    return found.select(F.explode("c.ks").alias("k"), F.col("c.kind").alias("kind")).groupBy("k").agg(F.collect_set("kind").alias("kinds"))


# ---- Verification ------------------------------------------------------------

#: Matches are folded in groups of this size, so that texts with very many stay cheap.
FOLD = 256


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,ord,kind,end>> of the leftmost non-overlapping matches that pass the length test, in code points.

    The pieces between matches and the matches themselves alternate, so that
    running sums of their lengths are the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.zip_with(
        F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, w: F.struct(F.length(g).alias("g"), F.length(w).alias("w"))),
        value,
        lambda x, v: F.struct(x["g"].alias("g"), x["w"].alias("w"), F.length(v).alias("v")),
    )
    n = F.size(whole)
    kind = "array<struct<start:int,ord:int,kind:string,end:int,v:int>>"

    def step(acc, x):
        start = acc["at"] + x["g"]
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (start + x["w"]).alias("end"), x["v"].alias("v"))
        return F.struct((start + x["w"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def group(g):
        before = F.aggregate(F.slice(parts, 1, g * FOLD), F.lit(0), lambda a, x: a + x["g"] + x["w"])
        return F.aggregate(F.slice(parts, g * FOLD + 1, FOLD), F.struct(before.alias("at"), F.array().cast(kind).alias("out")), step)["out"]

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int")), group))
    return F.when(n > 0, F.filter(every, lambda s: s["v"] >= rule.min_len)).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: doc_id, spans array<struct<start,ord,kind,end,v>> sorted by start, then rule."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = candidates(docs, rules)
    kinds = F.col("kinds")
    rows = docs.withColumn("k", row_key())
    if found is None:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    else:  # staged: a small candidate table is broadcast by its real size, a large one is joined by key
        rows = rows.join(stage(found, "secret_candidates"), "k", "left")
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,v:int>>")
    per_rule = []
    for i, r in enumerate(rules):
        listed = F.lit(True) if trigram_query(r.pattern) is None else F.coalesce(F.array_contains(kinds, r.kind), F.lit(False))
        per_rule.append(F.when(listed & F.col("text").rlike(r.pattern), spans(F.col("text"), r, i)).otherwise(empty))
    return rows.select("doc_id", F.sort_array(F.concat(*per_rule)).alias("spans"))


def digest(found: DataFrame, rules=RULES) -> DataFrame:
    """The columns of the contract, from scan()."""
    base = [r.kind for r in rules if r.base]

    def joined(col):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(kept), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op1_secret_scan(spark, sf_dir):
    from stratamill.llm.store import table

    return digest(scan(table(spark, sf_dir, "documents")))


def _oracle(rules=RULES) -> str:
    parts = []
    for i, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
  [{{'start': CAST(coalesce(list_sum(list_transform(s{i}[1:j], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m{i}[1:j - 1], lambda x: len(x))), 0) AS BIGINT),
     'ord': {i}, 'kind': '{r.kind}', 'len': len(m{i}[j])}} FOR j IN range(1, len(m{i}) + 1) IF len(v{i}[j]) >= {r.min_len}]""")
        rules_sql = f"string_split_regex(t, '{pattern}') AS s{i}, regexp_extract_all(t, '{pattern}', 0) AS m{i}, regexp_extract_all(t, '{pattern}', {r.group}) AS v{i}"
        parts[-1] = (parts[-1], rules_sql)
    every = "list_concat(" + ",".join(p for p, _ in parts) + ")"
    base = [r.kind for r in rules if r.base]
    joined = "coalesce(array_to_string(list_transform({}, lambda x: concat(x.kind, ':', x.start, ':', x.start + x.len)), ','), '')"
    kept = "list_filter(a, lambda x: x.kind IN (" + ", ".join(f"'{k}'" for k in base) + "))"
    counts = ", ".join(f"CAST(len(list_filter(a, lambda x: x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, {", ".join(x for _, x in parts)} FROM d),
q AS (SELECT doc_id, list_sort({every}) AS a FROM p)
SELECT doc_id, {counts}, sha256({joined.format(kept)}) AS base_sha256, {joined.format('a')} AS spans FROM q"""


ORACLE_OP1 = _oracle()
