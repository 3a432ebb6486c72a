"""Operator 11: conversation structure repair by weighted interval parsing.

A repaired conversation's role initials are ``(s?(ua)+)?``. The grammar is in Chomsky normal form over the four places of that pattern:
``X_pq -> X_pr X_rq`` for every r, and ``X_pq`` is a row with one edit (Keep, Rerole, Delete) that leads from place p to q. A span's chart
cell has for each (p, q) the least (cost, audit); it is closed under insertions before and after. Equal costs never leave one audit a prefix of another (an
insertion costs something), so the order of audits survives concatenation and a cell may be combined from either side. As the rules hold for every r, each
split of a span gives the same cell; so the chart is filled bottom-up for spans of 1, 2, 4, ... rows, not for all pairs of ends (tests hold it against
the chart with all spans and splits, and against a search over edits). Cells of short spans are remembered by their rows' classes.

Plan: rows become thin (place, hash of what is said, class), exact copies are counted before they are shuffled, repeats at another turn are found by a
small join; thin rows are range-partitioned by (conversation, turn), so that a conversation of any length is parsed in pieces. A piece that ends with its
partition sends its cell; the cells of a conversation (at most one a partition) are combined. Then the texts meet their audit in one
sorted stream. Memory: one byte a row of a piece, an audit; a digest is one sequential hash by its definition, so a conversation's texts stream through one task.

Defined results: a null role or text is one space; rows of one turn follow each other in the order of the hash of what they say, null turns first; a null conv_id is a
conversation; a conversation whose rows are all dropped has zeros, an empty audit and the empty string's hash; repeated rows are duplicates; no rows
give no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

# Fixed values of the contract: costs, and the pattern of role initials as steps between its places.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PLACES, ACCEPTED = range(4), (0, 3)
SPACES = " \t\n\x0b\x0c\r"
GONE = "D"  # class of a row that must be deleted; others: the initial, upper case if truncated, or one of these
OTHER, OTHER_CUT = "-", "="
SHORT = 16  # rows of a remembered span

Cell = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in PLACES:
            more = right.get((r, q))
            if more:
                new = cost + more[0], audit + more[1]
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def _least(options: list[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    out: Cell = {}
    for at, value in options:
        out[at] = min(value, out.get(at, value))
    return out


@functools.cache
def insertions() -> Cell:
    """The cell of no rows: what insertions alone can do."""
    one = [((p, q), (INSERT, "I")) for (p, initial), q in STEPS.items() if initial != "s"]
    closure = _least([((p, p), (0, "")) for p in PLACES])
    while True:
        more = _least([*closure.items(), *combined(closure, _least(one)).items()])
        if more == closure:
            return closure
        closure = more


@functools.lru_cache(1 << 16)
def short_cell(rows: str) -> Cell:
    """The cell of a span of few rows, given their classes."""
    if len(rows) > 1:
        half = 1 << (len(rows) - 1).bit_length() - 1
        return combined(short_cell(rows[:half]), short_cell(rows[half:]))
    edits = [((p, p), (DELETE, "D")) for p in PLACES]
    if rows != GONE:
        extra, initial = (TRUNCATED if rows.isupper() or rows == OTHER_CUT else 0), rows.lower()
        edits += [((p, q), (extra, "K")) for (p, x), q in STEPS.items() if x == initial]
        edits += [((p, q), (REROLE + extra, "R")) for (p, x), q in STEPS.items() if x != "s"]
    return combined(combined(insertions(), _least(edits)), insertions())


def cell(rows: str) -> Cell:
    """The cell of any span, bottom-up by its length."""
    level = [short_cell(rows[i : i + SHORT]) for i in range(0, len(rows), SHORT)] or [insertions()]
    while len(level) > 1:
        level = [combined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def best(c: Cell) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    return min(c[0, q] for q in ACCEPTED if (0, q) in c)


class Piece:
    """Part of a conversation: its faults and its rows' classes, then its cell."""

    FIELDS = ("lo", "hi", "first", "last", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail")

    def __init__(self):
        self.lo = self.hi = self.first = self.last = self.head = self.tail = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.rows: list[str] = []

    def add(self, turn: int | None, initial: str, blank: bool, cut: bool, copies: int, again: bool) -> None:
        """So many equal rows at a turn; again: an earlier turn says the same."""
        if turn is not None and (not self.turns or turn != self.hi):
            self.turns += 1
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        fresh = 0 if blank or again else 1
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - fresh
        self.truncated += fresh and cut
        known = initial in ("s", "u", "a")
        self.rows.append((((initial.upper() if cut else initial) if known else OTHER_CUT if cut else OTHER) if fresh else "") + GONE * (copies - fresh))
        pair = initial + initial
        self.illegal += (copies - 1) * (pair not in LEGAL) + (self.tail is not None and self.tail + initial not in LEGAL)
        self.head, self.tail = initial if self.head is None else self.head, initial

    def row(self, conv: int | None, at: tuple) -> dict:
        found = cell("".join(self.rows))
        cells = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in found.items()]
        return {"conv_id": conv, "at": at[0], "said": at[1], "cells": cells} | {k: getattr(self, k) for k in ("lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail")}


LEGAL = ("su", "ua", "au")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECE = "conv_id long, at long, said string, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, cells array<struct<p: int, q: int, cost: long, audit: string>>"
_FOUND = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", *COUNTS, "cost")], ("audit", pa.string())])
_CELL = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PIECE = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("said", pa.string()), *[(c, pa.int64()) for c in ("lo", "hi", "turns", *COUNTS)], ("head", pa.string()), ("tail", pa.string()), ("cells", _CELL)])
_BOTH = pa.schema([("whole", pa.struct(list(_FOUND))), ("part", pa.struct(list(_PIECE)))])


def merged(parts: list[dict]) -> dict:
    """The conversation of its pieces in order."""
    total = dict.fromkeys(COUNTS, 0)
    cells, lo, hi, turns, tail = [], None, None, 0, None
    for p in parts:
        for k in COUNTS:
            total[k] += p[k]
        if p["head"] is not None:
            total["illegal"] += tail is not None and tail + p["head"] not in LEGAL
            tail = p["tail"]
        if p["turns"]:
            turns += p["turns"] - (hi is not None and hi == p["lo"])
            lo, hi = p["lo"] if lo is None else lo, p["hi"]
        cells.append({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in p["cells"]})
    while len(cells) > 1:
        cells = [combined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    cost, audit = best(cells[0])
    return {"conv_id": parts[0]["conv_id"], "gaps": hi - lo + 1 - turns if turns else 0, **total, "cost": cost, "audit": audit}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted thin rows to conversations that end within the partition, and pieces of those at its two ends."""
    out: list[dict] = []
    piece, conv, at, first = None, None, None, True
    for batch in batches:
        for c, when, said, turn, initial, blank, cut, copies, again in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if piece is None or c != conv:
                if piece is not None:
                    done = piece.row(conv, at)
                    out.append({"part": done} if first else {"whole": merged([done])})
                    first = False
                piece, conv, at = Piece(), c, (when, said)
            if copies:
                piece.add(turn, initial, blank, cut, copies, again)
        if len(out) > 2000:
            yield pa.RecordBatch.from_pylist(out, _BOTH)
            out = []
    if piece is not None:
        out.append({"part": piece.row(conv, at)})
    yield pa.RecordBatch.from_pylist(out, _BOTH)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([merged(p) for p in batch.column(0).to_pylist()], _FOUND)


def rows_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text of any table of turns, with copies = 1."""
    space = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    return turns.select(turns[conv_id].cast("long").alias("conv_id"), turns[turn].cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage; a dropped row stays with copies = 0, a repeated one has 2."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(name) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(F.col("copies")).alias("copies"))


def _said() -> Column:
    return F.md5(F.concat(F.md5("role"), "text"))


def _thin(rows: DataFrame) -> DataFrame:
    """A row for each distinct (conversation, turn, role, text), without the text; dropped rows of a conversation make one row."""
    left = F.rtrim(F.col("text"), F.lit(SPACES))
    here = F.col("copies") > 0
    marked = rows.select(
        "conv_id", F.when(here, F.col("turn")).alias("turn"), F.when(here, _said()).otherwise("").alias("said"), F.substring("role", 1, 1).alias("initial"),
        (left == "").alias("blank"), (~F.right(left, F.lit(1)).isin(".", "!", "?")).alias("cut"), "copies",
    )
    same = marked.groupBy("conv_id", "turn", "said").agg(*[F.min(c).alias(c) for c in ("initial", "blank", "cut")], F.sum("copies").alias("copies"))
    return same.withColumn("at", F.coalesce("turn", F.lit(-(1 << 63))))


def repairs(rows: DataFrame) -> DataFrame:
    """FOUND for each conversation of rows(conv_id, turn, role, text, copies)."""
    thin = stored(_thin(rows), "repair-rows")
    said = thin.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    told = thin.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    told = told.select("conv_id", "at", "said", "turn", "initial", "blank", "cut", "copies", F.coalesce(F.col("earliest") < F.col("at"), F.lit(False)).alias("again"))
    small_batches(rows.sparkSession)
    ranged = told.repartitionByRange("conv_id", "at", "said").sortWithinPartitions("conv_id", "at", "said")
    found = stored(ranged.mapInArrow(_pieces, f"whole struct<{_typed(FOUND)}>, part struct<{_typed(PIECE)}>"), "repair-pieces")
    parts = found.where("part IS NOT NULL").select("part.*")
    listed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "said", *[c for c in parts.columns if c not in ("at", "said")]))).alias("pieces"))
    return found.where("whole IS NOT NULL").select("whole.*").union(listed.select("pieces").mapInArrow(_merged, FOUND))


def _typed(ddl: str) -> str:
    """A list of columns as the fields of a struct."""
    depth, out, name = 0, "", True
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if depth == 0 and name and ch == " ":
            out, name = out + ": ", False
        elif not (name and ch == " "):
            out += ch
        if depth == 0 and ch == ",":
            name = True
            out += " "
    return out.replace(",  ", ", ").replace(", : ", ", ")


class Replay:
    """One conversation's edits, applied to its rows as they come."""

    def __init__(self, found: dict):
        self.found, self.audit, self.k, self.place, self.system = found, found["audit"], 0, 0, 0

    def _role(self) -> str:
        return ("user", "assistant")[(self.place - self.system) % 2]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the insertions that are due."""
        while self.audit[self.k : self.k + 1] == "I":
            yield "I", self._role(), ""
            self.k, self.place = self.k + 1, self.place + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What one row becomes, with the insertions before it."""
        yield from self.inserted()
        edit = self.audit[self.k]
        self.k += 1
        if edit == "D":
            return
        if edit == "K" and role[:1] == "s":
            self.system = 1
        yield edit, role if edit == "K" else self._role(), text
        self.place += 1


def _together(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one sorted stream: (found, at, said, role, text, copies)."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    heads = found.select("conv_id", F.struct(*names).alias("found"), F.lit(None).cast("long").alias("at"), F.lit("").alias("said"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"))
    lines = rows.where("copies > 0").select("conv_id", F.lit(None).alias("found"), F.coalesce("turn", F.lit(-(1 << 63))).alias("at"), _said().alias("said"), "role", "text", "copies")
    both = heads.unionByName(lines)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("found").isNull(), "at", "said").drop("conv_id")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND with the hash of the repaired conversation."""
    schema = _FOUND.append(pa.field("repaired_sha256", pa.string()))
    replay, digest, started = None, None, False

    def add(turns: Iterator[tuple[str, str, str]]) -> None:
        nonlocal started
        for _, role, text in turns:
            digest.update((("\n" if started else "") + f"{role}:{text}").encode())
            started = True

    def closed() -> dict:
        add(replay.inserted())
        return replay.found | {"repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for found, _, _, role, text, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if found is not None:
                if replay is not None:
                    out.append(closed())
                replay, digest, started = Replay(found), hashlib.sha256(), False
            for _ in range(copies):
                add(replay.row(role, text))
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist([closed()] if replay is not None else [], schema)


TURNS = "conv_id long, place int, edit string, turn long, role string, text string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    replay = None
    for batch in batches:
        out = []

        def add(turn: int | None, made: Iterator[tuple[str, str, str]], out: list = out) -> None:
            for edit, role, text in made:
                out.append({"conv_id": replay.found["conv_id"], "place": replay.place, "edit": edit, "turn": None if edit == "I" else turn, "role": role, "text": text})

        for found, at, _, role, text, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if found is not None:
                if replay is not None:
                    add(None, replay.inserted())
                replay = Replay(found)
            for _ in range(copies):
                add(None if at == -(1 << 63) else at, replay.row(role, text))
        yield pa.RecordBatch.from_pylist(out, _TURNS)
    out = [] if replay is None else [{"conv_id": replay.found["conv_id"], "place": replay.place, "edit": e, "turn": None, "role": r, "text": t} for e, r, t in replay.inserted()]
    yield pa.RecordBatch.from_pylist(out, _TURNS)


def repaired(rows: DataFrame) -> DataFrame:
    """TURNS: the turns of the repaired conversations, with their place, the edit that made them and the turn they had (null if inserted)."""
    return _together(rows, repairs(rows)).mapInArrow(_turns, TURNS)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the damaged table: its faults, the cheapest repair and the hash of what it gives."""
    rows = damaged(rows_of(table(spark, sf_dir, "conversations")))
    return _together(rows, repairs(rows)).mapInArrow(_digests, FOUND + ", repaired_sha256 string")


#: Edits as steps between places: the same rules, as a table that a recursive query walks row by row.
OP11_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) v FROM range(256) r(i))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce("text", ' ') txt, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') nm FROM conversations),
fated AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(nm, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 fate FROM named n, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END txt, k
  FROM fated, LATERAL (SELECT unnest(CASE WHEN fate = 0 THEN [] WHEN fate = 3 THEN [1, 2] ELSE [1] END) k)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(role) || txt), k) i, left(role, 1) ini FROM hurt),
faults AS (SELECT *, NOT regexp_matches(txt, '[^\x20\x09-\x0D]') blank, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 again,
  NOT regexp_matches(txt, '[.!?][\x20\x09-\x0D]*$') cut, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini pair FROM numbered),
classed AS (SELECT *, CASE WHEN blank THEN 'b' WHEN again THEN 'd' WHEN cut THEN 't' ELSE 'k' END kind FROM faults),
step(p, ini, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
edits AS (SELECT conv_id, i, p.p, p.p q, 3 c, 'D' a FROM classed, (VALUES (0), (1), (2), (3)) p(p)
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN kind = 't' THEN 1 ELSE 0 END, 'K' FROM classed JOIN step USING (ini) WHERE kind IN ('t', 'k')
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN kind = 't' THEN 3 ELSE 2 END, 'R' FROM classed, step s WHERE kind IN ('t', 'k') AND s.ini <> 's'),
moves AS MATERIALIZED (SELECT e.conv_id, i, e.p, n.q, e.c + n.c c, e.a || n.a a FROM edits e JOIN ins n ON n.p = e.q),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) i, q p, CAST(c AS BIGINT) c, a FROM ids, ins WHERE ins.p = 0
  UNION ALL SELECT w.conv_id, w.i + 1, m.q, min(w.c + m.c), arg_min(w.a || m.a, (w.c + m.c, w.a || m.a)) FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.p = w.p GROUP BY w.conv_id, w.i, m.q),
least AS (SELECT conv_id, max(i) n FROM walk GROUP BY conv_id),
chosen AS (SELECT w.conv_id, min(c) AS cost, arg_min(a, (c, a)) audit FROM walk w JOIN least l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.i WHERE p IN (0, 3) GROUP BY w.conv_id),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) e, generate_subscripts(string_split(audit, ''), 1) k FROM chosen WHERE audit <> ''),
placed AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) i, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) - 1 place FROM letters),
matched AS (SELECT p.*, c.role, c.txt, c.ini, max(CASE WHEN e = 'K' AND c.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) sys FROM placed p LEFT JOIN classed c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i AND p.e <> 'I'),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE txt END, chr(10) ORDER BY k) s FROM matched WHERE e <> 'D' GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (kind = 'b') blank, count(*) FILTER (kind = 'd') "duplicate", count(*) FILTER (kind = 't') truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) illegal FROM classed GROUP BY conv_id)
SELECT h.conv_id, coalesce(gaps, 0) gaps, coalesce(n.blank, 0) blank, coalesce(n."duplicate", 0) "duplicate", coalesce(n.truncated, 0) truncated, coalesce(n.illegal, 0) illegal, h.cost, h.audit, sha256(coalesce(t.s, '')) repaired_sha256
FROM chosen h LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM h.conv_id
"""
