"""Repair of conversation structure: generalised LR parsing of the role sequence with weighted edits.

The roles of a conversation have to follow ``(s?(ua)+)?``. A parser of that grammar reads the rows and may delete, keep or rerole
each one and insert turns anywhere. All cheapest ways are followed side by side on a graph-structured stack; stacks with equal tops
are merged, the least (cost, audit) stays. Long conversations are parsed in segments side by side: a segment says what each way of
entering and leaving it costs, and the segments of a conversation are then joined in order.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# Costs of the edits, roles, ends of sentences, white space.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
ENDS = (".", "!", "?")
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

#: The role grammar. Terminals are role initials.
GRAMMAR = (("dialogue", ()), ("dialogue", ("pairs",)), ("dialogue", ("s", "pairs")), ("pairs", ("u", "a")), ("pairs", ("pairs", "u", "a")))

SEGMENT_ROWS, SEGMENT_CHARS = 256, 1 << 16


# --- automaton -------------------------------------------------------------

def _closed(items: frozenset) -> frozenset:
    """An LR(0) item is (rule, dot); rules of a symbol after a dot join in."""
    found, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        for new in [(r, 0) for r, (head, _) in enumerate(GRAMMAR) if GRAMMAR[rule][1][dot:dot + 1] == (head,)]:
            if new not in found:
                found.add(new)
                todo.append(new)
    return frozenset(found)


@lru_cache(None)
def _goto(items: frozenset, symbol: str) -> frozenset | None:
    moved = frozenset((r, d + 1) for r, d in items if GRAMMAR[r][1][d:d + 1] == (symbol,))
    return _closed(moved) if moved else None


class Stack(NamedTuple):
    """A stack's top: a parser state and a link to what is below. Stacks share what is below them."""
    state: frozenset
    below: Stack | None

    @property
    def accepts(self) -> bool:
        return any(GRAMMAR[r][0] == "dialogue" and d == len(GRAMMAR[r][1]) for r, d in self.state)


BOTTOM = Stack(_closed(frozenset((r, 0) for r, (head, _) in enumerate(GRAMMAR) if head == "dialogue")), None)


@lru_cache(None)
def shift(stack: Stack, symbol: str) -> Stack | None:
    """Push a terminal, then reduce finished pairs at once: they need no look-ahead. None if the grammar has no such place."""
    state = _goto(stack.state, symbol)
    if state is None:
        return None
    stack = Stack(state, stack)
    while done := [r for r, d in stack.state if GRAMMAR[r][0] != "dialogue" and d == len(GRAMMAR[r][1])]:
        head, body = GRAMMAR[done[0]]
        for _ in body:
            stack = stack.below
        stack = Stack(_goto(stack.state, head), stack)
    return stack


def _tops() -> list[Stack]:
    """One stack for each state that can be on top after reductions; the first is the empty one."""
    found = {BOTTOM.state: BOTTOM}
    for stack in (todo := [BOTTOM]):
        for symbol in "sua":
            new = shift(stack, symbol)
            if new and new.state not in found:
                found[new.state] = new
                todo.append(new)
    return list(found.values())


TOPS = _tops()
TOP_OF = {t.state: i for i, t in enumerate(TOPS)}
ACCEPTING = [i for i, t in enumerate(TOPS) if t.accepts]
# a table of shifts between tops; what lies below an equal top makes no difference to what can follow
AFTER = [{symbol: TOP_OF[new.state] for symbol in "sua" if (new := shift(t, symbol))} for t in TOPS]
NEXT_ROLE = ["a" if "a" in after else "u" for after in AFTER]

Frontier = dict[int, tuple[int, str]]       # top: least (cost, audit)


def _offer(tops: Frontier, top: int | None, cost: int, audit: str) -> bool:
    if top is None or (top in tops and tops[top] <= (cost, audit)):
        return False
    tops[top] = (cost, audit)
    return True


def _with_inserts(tops: Frontier) -> Frontier:
    tops = dict(tops)
    todo = list(tops)
    for top in todo:
        cost, audit = tops[top]
        for symbol in ROLES:
            new = AFTER[top].get(symbol)
            if _offer(tops, new, cost + INSERT, audit + "I"):
                todo.append(new)
    return tops


def parse(rows: list[tuple[str, bool, bool]], entry: int = 0) -> Frontier:
    """Rows are (role initial, has to go, truncated). Least (cost, audit) for each top that the rows can lead to from ``entry``."""
    tops = _with_inserts({entry: (0, "")})
    for initial, goes, truncated in rows:
        new: Frontier = {}
        extra = TRUNCATED if truncated else 0
        for top, (cost, audit) in tops.items():
            _offer(new, top, cost + DELETE, audit + "D")
            if not goes:
                _offer(new, AFTER[top].get(initial), cost + KEEP + extra, audit + "K")
                for symbol in ROLES:
                    _offer(new, AFTER[top].get(symbol), cost + REROLE + extra, audit + "R")
        tops = _with_inserts(new)
    return tops


def repaired(roles: list[str], texts: list[str], audit: str, entry: int = 0) -> list[str]:
    """The ``role:text`` lines that an audit makes of the rows."""
    lines, due, i = [], NEXT_ROLE[entry], 0
    for edit in audit:
        if edit != "D":
            role = roles[i] if edit == "K" else ROLES[due]
            lines.append(f"{role}:{'' if edit == 'I' else texts[i]}")
            due = "a" if role[:1] == "u" else "u"
        i += edit != "I"
    return lines


# --- rows and faults -------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """The fixed damage: every row gets ``copies`` (0 to 2), and its role and text afterwards. Nulls become one space."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    code = F.crc32(named.cast("binary")) % 20
    text = F.coalesce(F.col("text"), space)
    return conversations.select(
        "conv_id", "turn",
        F.when(code == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def _key(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def repeats(rows: DataFrame) -> DataFrame:
    """(key, turn, row) of rows whose role and text came earlier in their conversation. Firsts are pre-aggregated in each task;
    copies that a third of all rows hold are split in the join, whose other side has one row for each repeated text."""
    held = rows.where("copies > 0").where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        "key", "turn", "row", F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256).alias("digest"))
    held = stage(held, "repair-digests")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    firsts = held.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(place)["row"].alias("first")).where("n > 1")
    firsts = stage(firsts.select("key", "digest", "first"), "repair-firsts")
    return held.join(firsts.hint("merge"), ["key", "digest"]).where("row <> first").select("key", "turn", "row")


SEGMENT = ("key string, conv_id long, at_turn long, at_row long, n int, blank long, duplicate long, truncated long, illegal long, "
           "first_initial string, last_initial string, low long, high long, turns long, "
           "ways array<struct<entry:int,exit:int,cost:long,audit:string>>, roles array<string>, texts array<string>")
_WAY = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_LONGS = ("conv_id", "at_turn", "at_row", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns")
_NAMES = [c.strip().split(" ")[0] for c in SEGMENT.split("ways")[0].split(",") if c.strip()] + ["ways", "roles", "texts"]


class _Segment:
    """Rows of one conversation that follow each other, and their counts."""

    def __init__(self, key: str, conv_id: int | None, turn: int | None, row: int, opens: bool):
        self.key, self.conv_id, self.at_turn, self.at_row, self.opens = key, conv_id, turn, row, opens
        self.roles, self.texts, self.parsed, self.chars = [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        body = text.rstrip(BLANKS)
        blank = not body
        duplicate = repeated and not blank
        truncated = not blank and not duplicate and not body.endswith(ENDS)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.roles:
            self.illegal += (self.roles[-1][:1], role[:1]) not in LEGAL
        if turn is not None and turn != self.high:          # rows come by turn
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.roles.append(role)
        self.texts.append("" if blank or duplicate else text)
        self.parsed.append((role[:1], blank or duplicate, truncated))
        self.chars += len(text)

    def full(self, most_rows: int, copies: int) -> bool:
        """Whether the next row's copies have no room. A row's copies stay together, also where they are more than ``most_rows``."""
        return bool(self.roles) and (len(self.roles) + max(1, copies) > most_rows or self.chars >= SEGMENT_CHARS)

    def row(self) -> tuple:
        ways = [{"entry": e, "exit": x, "cost": c, "audit": a} for e in range(1 if self.opens else len(TOPS))
                for x, (c, a) in parse(self.parsed, e).items()]
        return (self.key, self.conv_id, self.at_turn, self.at_row, len(self.roles), self.blank, self.duplicate, self.truncated, self.illegal,
                self.roles[0][:1] if self.roles else None, self.roles[-1][:1] if self.roles else None, self.low, self.high, self.turns,
                ways, self.roles, self.texts)


def _segments(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place become segments. The first of a partition may continue a conversation, all ways of
    entering it are parsed; the other conversations begin here."""
    types = {c: pa.int64() for c in _LONGS} | {"n": pa.int32(), "ways": pa.list_(_WAY), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}
    done, now, marked = [], None, None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), types.get(n, pa.string())) for n, c in zip(_NAMES, zip(*rows))], names=_NAMES)

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            for key, conv_id, turn, row, role, text, copies, marker in zip(*whole.slice(at, 512).to_pydict().values()):
                if marker:                       # says that the next row's role and text came earlier
                    marked = row
                    continue
                if now is None or now.key != key or now.full(most_rows, copies):
                    if now is not None:
                        done.append(now.row())
                        if len(done) >= 64:
                            yield batch_of(done)
                            done = []
                    now = _Segment(key, conv_id, turn, row, now is not None and now.key != key)
                for copy in range(copies):
                    now.add(turn, role, text, copy > 0 or marked == row)
    if now is not None:
        done.append(now.row())
        yield batch_of(done)


# --- joining segments ------------------------------------------------------

class _Way(NamedTuple):
    """A way through a conversation's first segments: what it costs, its audit as a chain of pieces, its text hashed so far."""
    cost: int
    piece: str
    before: _Way | None
    digest: object
    lines: int

    def pieces(self) -> list[str]:
        out, way = [], self
        while way:
            out.append(way.piece)
            way = way.before
        return out[::-1]


def _less(a: _Way | None, a_piece: str, b: _Way | None, b_piece: str) -> bool:
    """Whether one audit comes before another of equal cost: only what follows the last common piece is compared."""
    left, right = [a_piece], [b_piece]
    while a is not b:
        left.append(a.piece)
        right.append(b.piece)
        a, b = a.before, b.before
    return "".join(left[::-1]) < "".join(right[::-1])


class _Joined:
    """The segments of one conversation, in order."""

    def __init__(self, first: dict):
        self.key, self.conv_id, self.ways, self.held = first["key"], first["conv_id"], None, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last_initial = None

    def _advance(self, exits: list[int]) -> dict[int, _Way]:
        """Follow the held segment to these exits; of several entries the least (cost, audit) stays."""
        best: dict[int, tuple] = {}
        for way in self.held["ways"]:
            entry, leave = way["entry"], way["exit"]
            before = self.ways.get(entry) if self.ways is not None else None
            if leave not in exits or (before is None and (self.ways is not None or entry)):
                continue
            cost = way["cost"] + (before.cost if before else 0)
            had = best.get(leave)
            if had is None or cost < had[0] or (cost == had[0] and _less(before, way["audit"], had[1], had[2])):
                best[leave] = (cost, before, way["audit"], entry)
        return {leave: self._written(*b) for leave, b in best.items()}

    def _written(self, cost: int, before: _Way | None, audit: str, entry: int) -> _Way:
        digest, count = (before.digest.copy(), before.lines) if before else (hashlib.sha256(), 0)
        lines = repaired(self.held["roles"], self.held["texts"], audit, entry)
        if lines:
            digest.update((("\n" if count else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return _Way(cost, audit, before, digest, count + len(lines))

    def add(self, segment: dict) -> None:
        if self.held is not None:
            self.ways = self._advance(list(range(len(TOPS))))
        self.held = segment
        for name in self.counts:
            self.counts[name] += segment[name]
        if segment["n"]:
            if self.last_initial is not None:
                self.counts["illegal"] += (self.last_initial, segment["first_initial"]) not in LEGAL
            self.last_initial = segment["last_initial"]
        if segment["low"] is not None:
            self.counts["turns"] -= segment["low"] == self.high           # a turn on both sides of the cut
            self.low, self.high = segment["low"] if self.low is None else self.low, segment["high"]

    def result(self) -> tuple:
        whole = self._advance(ACCEPTING)
        top = None
        for i in whole:
            if top is None or whole[i].cost < whole[top].cost or (
                    whole[i].cost == whole[top].cost and _less(whole[i].before, whole[i].piece, whole[top].before, whole[top].piece)):
                top = i
        c = self.counts
        gaps = self.high - self.low + 1 - c["turns"] if self.low is not None else 0
        way = whole[top]
        return (self.conv_id, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], way.cost, "".join(way.pieces()), way.digest.hexdigest())


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
_RESULT_NAMES = [c.strip().split(" ")[0] for c in RESULT.split(",")]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, now = [], None

    def batch_of(rows):
        kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in _RESULT_NAMES]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=_RESULT_NAMES)

    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            for segment in whole.slice(at, 64).to_pylist():
                if now is None or now.key != segment["key"]:
                    if now is not None:
                        done.append(now.result())
                        if len(done) >= 512:
                            yield batch_of(done)
                            done = []
                    now = _Joined(segment)
                now.add(segment)
    if now is not None:
        done.append(now.result())
        yield batch_of(done)


def segments_of(rows: DataFrame, most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of all conversations from rows (conv_id, turn, role, text, copies), in the order of turn (nulls first; equal turns by
    their place in the table). Rows are dealt out by ranges of (conversation, turn), so the longest conversation is spread over
    as many tasks as its rows need."""
    spark = rows.sparkSession
    rows = stage(rows.select(_key().alias("key"), "conv_id", "turn", F.monotonically_increasing_id().alias("row"), "role", "text", "copies"), "repair-rows")
    marks = stage(repeats(rows), "repair-repeats")
    none = F.lit(None).cast("string")
    both = rows.withColumn("marker", F.lit(False)).unionByName(marks.select(
        "key", F.lit(None).cast("long").alias("conv_id"), "turn", "row", none.alias("role"), none.alias("text"), F.lit(0).alias("copies"), F.lit(True).alias("marker")))
    place = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("row")]
    dealt = both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place, F.col("marker").desc())
    return dealt.mapInArrow(lambda batches: _segments(batches, most_rows), SEGMENT)


def repair(rows: DataFrame, most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """What is wrong with every conversation and its cheapest repair.

    ``rows``: conv_id, turn, role, text, copies (how often the row stands there; with 0 only its conversation is told). Returns conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A null conv_id is a conversation of its own; rows of
    equal turns come in the order of the table; repeated rows are duplicates. Nulls in role and text have to be replaced first (as ``damage``
    does). A conversation without rows has zeros, an empty audit and the hash of an empty text. Empty tables give an empty
    result; other columns are ignored.

    Only the digest of a repaired text has to be made in order: it reads a conversation's segments as a stream.
    """
    spark = rows.sparkSession
    segments = stage(segments_of(rows, most_rows), "repair-segments")
    ordered = segments.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions(
        F.col("key"), F.col("at_turn").asc_nulls_first(), F.col("at_row"))
    return ordered.mapInArrow(_joined, RESULT)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The cheapest edits by a fold over a conversation's rows that keeps four ends (nothing yet, after s, after u, after a pair), each
#: with the least (cost, audit); the repaired text by a fold over the audit. Equal turns come by role and text.
SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
        list_concat([4294967295], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
          lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END)) % 20 AS code FROM conversations),
d AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM r WHERE code <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM d),
f AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
        lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM n),
g AS (SELECT *, body <> '' AND NOT duplicate AND body[-1:] NOT IN ('.', '!', '?') AS truncated FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank,
        count(*) FILTER (duplicate)::BIGINT AS duplicate, count(*) FILTER (truncated)::BIGINT AS truncated,
        count(*) FILTER (prev IS NOT NULL AND prev || role[1:1] NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal,
        list({'i': role[1:1], 'g': blank OR duplicate, 't': CASE WHEN truncated THEN 3 ELSE 0 END} ORDER BY i) AS seq,
        list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts FROM g GROUP BY conv_id),
folded AS (SELECT *, list_reduce(list_transform(list_concat([{'i': 'first', 'g': false, 't': 0}], seq), lambda x: {
          'row': x, 'o': {'c': 0, 'a': ''}, 's': {'c': 1000000000, 'a': ''}, 'u': {'c': 1000000000, 'a': ''}, 'p': {'c': 1000000000, 'a': ''}}),
        lambda z, y: list_transform([{
            'o': z.o, 's': z.s,
            'u': list_sort([z.u, {'c': z.o.c + 3, 'a': z.o.a || 'I'}, {'c': z.s.c + 3, 'a': z.s.a || 'I'}, {'c': z.p.c + 3, 'a': z.p.a || 'I'}])[1],
            'p': list_sort([z.p, {'c': z.u.c + 3, 'a': z.u.a || 'I'}, {'c': z.o.c + 6, 'a': z.o.a || 'II'}, {'c': z.s.c + 6, 'a': z.s.a || 'II'}])[1]}],
          lambda w: {'row': y.row, 'o': {'c': w.o.c + 4, 'a': w.o.a || 'D'},
            's': list_sort([{'c': w.s.c + 4, 'a': w.s.a || 'D'}, {'c': w.o.c + CASE WHEN y.row.g OR y.row.i <> 's' THEN 1000000000 ELSE y.row.t END, 'a': w.o.a || 'K'}])[1],
            'u': list_sort([{'c': w.u.c + 4, 'a': w.u.a || 'D'}, list_transform([list_sort([w.o, w.s, w.p])[1]], lambda b: {
                   'c': b.c + y.row.t + CASE WHEN y.row.g THEN 1000000000 WHEN y.row.i = 'u' THEN 0 ELSE 3 END, 'a': b.a || CASE y.row.i WHEN 'u' THEN 'K' ELSE 'R' END})[1]])[1],
            'p': list_sort([{'c': w.p.c + 4, 'a': w.p.a || 'D'}, {'c': w.u.c + y.row.t + CASE WHEN y.row.g THEN 1000000000 WHEN y.row.i = 'a' THEN 0 ELSE 3 END,
                   'a': w.u.a || CASE y.row.i WHEN 'a' THEN 'K' ELSE 'R' END}])[1]})[1]) AS z FROM c),
best AS (SELECT *, list_sort([z.o, z.p, {'c': z.u.c + 3, 'a': z.u.a || 'I'}, {'c': z.s.c + 6, 'a': z.s.a || 'II'}])[1] AS b FROM folded),
written AS (SELECT *, list_reduce(list_concat([{'e': '', 'i': 1, 'd': 'u', 'n': 0, 't': ''}],
          list_transform(string_split(b.a, ''), lambda e: {'e': e, 'i': 0, 'd': '', 'n': 0, 't': ''})),
        lambda x, y: list_transform([CASE WHEN y.e = 'K' THEN roles[x.i] WHEN x.d = 'u' THEN 'user' ELSE 'assistant' END], lambda role: {
          'e': '', 'i': x.i + CASE WHEN y.e IN ('I', '') THEN 0 ELSE 1 END,
          'd': CASE WHEN y.e IN ('D', '') THEN x.d WHEN role[1:1] = 'u' THEN 'a' ELSE 'u' END,
          'n': x.n + CASE WHEN y.e IN ('D', '') THEN 0 ELSE 1 END,
          't': CASE WHEN y.e IN ('D', '') THEN x.t ELSE x.t || CASE WHEN x.n > 0 THEN chr(10) ELSE '' END || role || ':' || CASE y.e WHEN 'I' THEN '' ELSE texts[x.i] END END})[1]).t AS t
      FROM best)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM k.conv_id
"""
