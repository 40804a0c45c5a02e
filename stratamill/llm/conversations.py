"""Conversation structure repair by composition of weighted finite-state machines.

A conversation's rows in order are an acceptor: a chain whose symbols are a row's role
initial and its first fault. The edit transducer keeps, reroles or deletes a row or
inserts an empty one; the grammar accepts the role initials `(s?(ua)+)?`. Their
composition isn't built: a state (rows read, insertions since, grammar state) is made when
an arc leads to it. More than two insertions in a row end where fewer do, so the
transducer counts to two and the composition has no cycle. Weights are (cost, labels of
the edits), compared in that order. To put a label before two strings keeps their
order, to put one behind them doesn't, so shortest paths are sought from the end. A
state holds its cost and the rank of its string among the states of its layer, not the
string itself: work and memory grow with the number of rows.

On Spark: rows are sorted within partitions by conversation and turn. One pass over
(role, fault, order), without texts, gives each conversation's cheapest edits, some
20 bytes a row; a second one streams the texts past these edits. A conversation's texts
are never held together. One conversation is one partition's, as its audit is one value
and a chain is read in order; the sort spills.

Defined results: a null role or text is one space, a null turn comes first; rows of one
turn are ordered by role and by the text's SHA-256; a null conv_id is a conversation of
its own; a role that begins with none of s, u, a has to be reroled or deleted, an
empty one too; a row is a duplicate if its role and text stand in an earlier row of the
conversation; repeated rows are duplicates; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamill.llm.store import bound_batches, stage, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
ROLES = {"u": "user", "a": "assistant"}
#: The grammar's states: nothing read, after s, after u, after a. A conversation may end in the first and the last.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")
BLANK_SPACE = " \t\n\x0b\f\r"
#: A row's first fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INSERTIONS = 2
#: Conversations of up to so many rows are remembered by their symbols.
SHORT = 24
LABELS = "\0" + DELETE + INSERT + KEEP + REROLE


def edits(initial: str, fault: int, inserted: int) -> Iterator[tuple[int, str, str, bool]]:
    """The transducer's arcs (cost, label, role initial written, whether a row is read) before a row; initial "" is the end."""
    if inserted < INSERTIONS:
        yield from ((COSTS[INSERT], INSERT, role, False) for role in ROLES)
    if initial:
        yield COSTS[DELETE], DELETE, "", True
        if fault in (SOUND, TRUNCATED):
            more = TRUNCATED_COST * (fault == TRUNCATED)
            yield COSTS[KEEP] + more, KEEP, initial, True
            yield from ((COSTS[REROLE] + more, REROLE, role, True) for role in ROLES if role != initial)


@functools.cache
def arcs(initial: str, fault: int, inserted: int, state: int) -> tuple[tuple[int, str, bool, int], ...]:
    """Arcs (cost, label, whether a row is read, next grammar state) of the composition with the grammar."""
    out = []
    for cost, label, written, reads in edits(initial, fault, inserted):
        to = GRAMMAR[state].get(written) if written else state
        if to is not None:
            out.append((cost, label, reads, to))
    return tuple(out)


def cheapest(symbols: str) -> tuple[int, str]:
    """(cost, labels) of the cheapest edits; a row is two characters of symbols: its initial (`-` for any other than s, u, a) and its fault."""
    n, width = len(symbols) // 2, INSERTIONS + 1

    def row(i: int) -> tuple[str, int]:
        return (symbols[2 * i], int(symbols[2 * i + 1])) if i < n else ("", SOUND)

    reached = bytearray((n + 1) * width)  # a bit for each grammar state
    reached[0] = 1
    for at in range((n + 1) * width):
        i, inserted = divmod(at, width)
        for state in range(4):
            if reached[at] >> state & 1:
                for _, _, reads, to in arcs(*row(i), inserted, state):
                    reached[(i + 1) * width if reads else at + 1] |= 1 << to
    choice = bytearray((n + 1) * width * 4)
    after: dict[int, tuple[int, int]] = {}  # of the layer that the next row begins: state -> (cost, rank)
    for i in range(n, -1, -1):
        later: dict[int, tuple[int, int]] = {}  # of the layer with one insertion more
        for inserted in range(INSERTIONS, -1, -1):
            best = {}
            at = i * width + inserted
            for state in range(4):
                if reached[at] >> state & 1:
                    found = [(0, "", 0)] if i == n and state in FINAL else []
                    for cost, label, reads, to in arcs(*row(i), inserted, state):
                        rest = (after if reads else later).get(to)
                        if rest:
                            found.append((cost + rest[0], label, rest[1]))
                    if found:
                        best[state] = min(found)
                        choice[at * 4 + state] = LABELS.index(best[state][1] or "\0")
            # One label leads to one layer, so (label, rank there) orders this layer's strings.
            order = {s: k for k, s in enumerate(sorted({b[1:] for b in best.values()}))}
            later = {state: (b[0], order[b[1:]]) for state, b in best.items()}
        after = later
    audit, i, inserted, state = [], 0, 0, 0
    while label := choice[(i * width + inserted) * 4 + state]:
        label = LABELS[label]
        audit.append(label)
        reads, state = next((reads, to) for _, x, reads, to in arcs(*row(i), inserted, state) if x == label)
        i, inserted = (i + 1, 0) if reads else (i, inserted + 1)
    return after[0][0], "".join(audit)


_remembered = functools.lru_cache(100_000)(cheapest)


class Conversation:
    """What the first pass gathers of a conversation, row by row."""

    def __init__(self):
        self.symbols, self.faults, self.illegal, self.turns = [], [0] * 4, 0, 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.faults[fault] += 1
        self.symbols.append((initial if initial in ("s", "u", "a") else "-") + str(fault))
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1

    def row(self) -> tuple:
        n = len(self.symbols)
        cost, audit = (_remembered if n <= SHORT else cheapest)("".join(self.symbols))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, cost, audit


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's edits, from its rows in order."""
    out, now, key = [], None, None

    def made(kind) -> pa.RecordBatch:
        ids, *rest = zip(*out, strict=True)
        columns = [pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in rest[:-1]), pa.array(rest[-1], pa.string())]
        return pa.record_batch(columns, names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    kind = None
    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault")), strict=True):
            if now is None or conv != key:
                if now:
                    out.append((key, *now.row()))
                now, key = Conversation(), conv
            now.add(*row)
        if len(out) > 1000:
            yield made(kind)
            out.clear()
    if now:
        out.append((key, *now.row()))
        yield made(kind)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _faultless(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest), without nulls in role and text."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text")).withColumn(
        "digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    )


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    bare = F.rtrim(F.col("text"), F.lit(BLANK_SPACE))
    narrow = _faultless(rows).select("conv_id", "turn", "role", "digest", (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(SOUND)
    faults = narrow.select("conv_id", "turn", "role", "digest", fault.alias("fault"))
    sorted_ = faults.repartition("conv_id").sortWithinPartitions("conv_id", *_order(), F.col("fault") == DUPLICATE)
    return sorted_.select("conv_id", "turn", "role", "fault").mapInArrow(
        _audits, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's first row holds its edits; its rows follow in order."""
    audit, at, state, place, key = "", 0, 0, 0, None
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == INSERT:
            initial = next(r for r in GRAMMAR[state] if r in ROLES)
            out.append((key, place, INSERT, ROLES[initial], ""))
            state, at, place = GRAMMAR[state][initial], at + 1, place + 1

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, edits_, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if edits_ is not None:
                audit, at, state, place, key = edits_, 0, 0, 0, conv
                inserted()
                continue
            edit = audit[at]
            at += 1
            if edit != DELETE:
                initial = role[:1] if edit == KEEP else next(r for r in GRAMMAR[state] if r in ROLES)
                out.append((key, place, edit, role if edit == KEEP else ROLES[initial], text))
                state, place = GRAMMAR[state][initial], place + 1
            inserted()
        if out:
            ids, places, labels, roles, texts = zip(*out, strict=True)
            yield pa.record_batch(
                [pa.array(ids, kind), pa.array(places, pa.int64()), pa.array(labels), pa.array(roles), pa.array(texts)], names=["conv_id", "place", "edit", "role", "text"]
            )
            out.clear()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, place from 0, edit, role, text); found: audits(rows). A conversation's rows are one partition's, together and in order."""
    bound_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = F.lit(None).cast("string")
    heads = found.select("conv_id", "audit", F.lit(None).cast("bigint").alias("turn"), none.alias("role"), none.alias("text"), F.lit(None).cast("binary").alias("digest"))
    texts = _faultless(rows).select("conv_id", none.alias("audit"), "turn", "role", "text", "digest")
    sorted_ = heads.unionAll(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").asc_nulls_last(), *_order())
    return sorted_.select("conv_id", "audit", "role", "text").mapInArrow(_apply, f"conv_id {kind}, place bigint, edit string, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's `role:text`, newline-joined; rows come together and in order."""
    key, h, kind = None, None, None

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key], kind), pa.array([h.hexdigest()])], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if h:
                    yield made()
                key, h = conv, hashlib.sha256()
            h.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
    if h:
        yield made()


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of repaired(), without another shuffle; conversations of which nothing is left have no row."""
    kind = fixed.schema["conv_id"].dataType.simpleString()
    return fixed.select("conv_id", "place", "role", "text").mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the query's own faults, chosen by a hash of conv_id and turn; nulls count as one space."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20).alias("hit"))
    hit = F.col("hit")
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def op11_conversation_repair(spark, sf_dir):
    """Every original conv_id, its faults after damage, its cheapest edits and the hash of what they make of it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hurt = damaged(rows)
    found = stage(audits(hurt), "audits")
    made = digests(repaired(hurt, found))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    both = ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    out = both.join(made, both["id"].eqNullSafe(made["conv_id"]), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """The same paths by a recursion from the last row to the first, with whole strings as weights."""
    step = {g: max(arcs.items(), key=lambda x: x[0]) for g, arcs in GRAMMAR.items()}  # the user or assistant that a state wants

    def weight(cost, label, v, written="''"):
        t = "v.t" if written == "''" else f"{written} || CASE WHEN v.t = '' THEN '' ELSE chr(10) || v.t END"
        return f"{{'c': v.c + {cost}, 's': '{label}' || v.s, 't': {t}}}".replace("v.", f"{v}.")

    def before(g):
        want, to = step[g]
        more = f"{TRUNCATED_COST} * (fault = {TRUNCATED})::INT"
        free = f"fault IN ({SOUND}, {TRUNCATED})"
        kept = [f"CASE WHEN {free} AND ini = '{i}' THEN {weight(more, KEEP, f'v{x}', 'role || chr(58) || text')} END" for i, x in GRAMMAR[g].items()]
        other = f"CASE WHEN {free} AND ini <> '{want}' THEN {weight(f'{COSTS[REROLE]} + {more}', REROLE, f'v{to}', repr(ROLES[want]) + ' || chr(58) || text')} END"
        return f"list_aggregate([{', '.join([weight(COSTS[DELETE], DELETE, f'v{g}'), *kept, other])}], 'min') AS b{g}"

    def inserted(g):
        (a, to), (b, end) = step[g], step[step[g][1]]
        one = weight(COSTS[INSERT], INSERT, f"b{to}", f"'{ROLES[a]}:'")
        two = weight(2 * COSTS[INSERT], INSERT * 2, f"b{end}", f"'{ROLES[a]}:' || chr(10) || '{ROLES[b]}:'")
        return f"list_aggregate([b{g}, CASE WHEN b{to} IS NOT NULL THEN {one} END, CASE WHEN b{end} IS NOT NULL THEN {two} END], 'min') AS v{g}"

    end = ", ".join("{'c': 0::BIGINT, 's': '', 't': ''} AS b" + str(g) if g in FINAL else f"NULL::STRUCT(c BIGINT, s VARCHAR, t VARCHAR) AS b{g}" for g in GRAMMAR)
    ends, befores = ", ".join(map(inserted, GRAMMAR)), ", ".join(map(before, GRAMMAR))
    return f"""
    WITH RECURSIVE whole AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    hashed AS (SELECT *, xor(list_reduce([4294967295] || flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(name, '')]),
        lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) % 20 AS hit FROM whole),
    hurt AS (SELECT id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
        CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS k FROM hashed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, sha256(text), k) AS pos, substr(role, 1, 1) AS ini,
        rtrim(text, {' || '.join(f'chr({ord(c)})' for c in BLANK_SPACE)}) AS bare FROM hurt),
    faulty AS (SELECT *, CASE WHEN bare = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY pos) > 1 THEN {DUPLICATE}
        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {SOUND} END AS fault,
        lag(ini) OVER (PARTITION BY id ORDER BY pos) || ini AS pair FROM placed),
    sums AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = {BLANK}) AS blank,
        count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated,
        count(*) FILTER (pair NOT IN {LEGAL}) AS illegal FROM faulty GROUP BY 1),
    path AS (SELECT id, n + 1 AS pos, {ends} FROM (SELECT id, n, {end} FROM sums)
      UNION ALL
      SELECT id, pos, {ends} FROM (SELECT f.id, f.pos, {befores} FROM path JOIN faulty f ON f.id = path.id AND f.pos = path.pos - 1)),
    best AS (SELECT id, v0 FROM path WHERE pos = 1)
    SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.s, '') AS audit, sha256(coalesce(v0.t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, id FROM whole) w LEFT JOIN sums USING (id) LEFT JOIN best USING (id)"""


ORACLE_OP11 = _oracle()
