"""Operator 9: personal data, also in disguise, with offsets into the source text.

Base spans are regular-expression matches on the text itself. Then transducers rewrite the text: lookalike and full-width
characters to ASCII, invisible ones to nothing, "(at)", "[dot]" and "name at host dot org" to signs, runs of spelled digits to
digits, numbers joined by "dot" to addresses. Each keeps, for every character it writes, the source characters it came from, so that a match on the rewritten text
maps back. Matches there are added unless a base span of the same kind holds them, so spans may overlap; base spans stay as they are.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; spans that start together are in the
order of ``KINDS``; repeated rows are each searched; no rows give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches, table, texts_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a match starts at the start of its digits: if it fails there it fails further on in them
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As a scan by the whole pattern, but from each @ outwards, so that long words cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            yield start, 0, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def find(text: str) -> list[Span]:
    """The base spans of a text."""
    spans = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(spans)


# Letters of other scripts that look like ASCII letters, and what they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Invisible characters.
INVISIBLE = "­​‌‍⁠﻿"
#: Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


@lru_cache(maxsize=1)
def _table() -> dict[str, str]:
    """Characters to rewrite: lookalikes, and all whose compatibility form is one ASCII letter, digit or sign."""
    table = dict(LOOKALIKES) | {c: "" for c in INVISIBLE}
    for i in [*range(0x2000, 0x2500), *range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970), *range(0xFE50, 0xFE70), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        c = chr(i)
        to = unicodedata.normalize("NFKC", c)
        if c not in table and unicodedata.decimal(c, None) is not None:
            to = str(unicodedata.decimal(c))
        if c not in table and len(to) == 1 and " " < to < "\x7f":
            table[c] = to
    return table


@lru_cache(maxsize=256)
def _any_of(chars: str) -> re.Pattern:
    return re.compile("[" + re.escape(chars) + "]")


#: Top-level domains that a domain in words must end in.
TOP = "com|org|net|edu|gov|mil|int|info|biz|dev|app|io|co|ai|me|tv|uk|de|fr|es|it|nl|be|ch|pt|pl|se|no|dk|fi|ie|eu|us|ca|mx|br|ar|au|nz|jp|cn|in|kr|ru|za"
_WORD = "(?:" + "|".join(SPELLED) + ")"
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[ -]+)?{_WORD}(?:[ -]+{_WORD}){{3,}}(?![A-Za-z])", re.I)
_SIGN = re.compile(r"[\[({<][ \t]*(at|dot|@|\.)[ \t]*[\])}>]", re.I)  # and the blanks around it
_SAID = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>[ \t]+at[ \t]+)[A-Za-z0-9-]+(?:(?:[ \t]+dot[ \t]+|\.)[A-Za-z0-9-]+)*[ \t]+dot[ \t]+(?:{TOP})(?![A-Za-z])", re.I)
_HALF_SAID = re.compile(rf"@[A-Za-z0-9-]+(?:(?:[ \t]+dot[ \t]+|\.)[A-Za-z0-9-]+)*[ \t]+dot[ \t]+(?:{TOP})(?![A-Za-z])", re.I)
_SAID_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:[ \t]+dot[ \t]+|\.)[0-9]{1,3}){3}(?![0-9])", re.I)
_PAUSE = re.compile(r"(?<![ \t])[ \t]+(at|dot)[ \t]+", re.I)
#: Letters that a pattern without regard to case takes for "i" and "s", besides those that lower() gives.
_FOLDS = str.maketrans("ıſ", "is", "\u0307")


class Tape:
    """A rewritten text and, for each of its characters, where its source starts and ends."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, pieces: Iterable[tuple[int, int, str]]) -> Tape:
        """Put each (start, end, new) in place, in ascending order; every character of new comes from the whole of what it replaces."""
        parts, starts, ends, at = [], [], [], 0
        for begin, end, new in pieces:
            parts += [self.text[at:begin], new]
            starts += [*self.starts[at:begin], *[self.starts[begin]] * len(new)]
            ends += [*self.ends[at:begin], *[self.ends[end - 1]] * len(new)]
            at = end
        if at:
            self.text = "".join(parts) + self.text[at:]
            self.starts, self.ends = starts + [*self.starts[at:]], ends + [*self.ends[at:]]
        return self

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _digits(words: str) -> str:
    return "".join("+" if w == "plus" else SPELLED[w] for w in re.split("[ -]+", words.lower().translate(_FOLDS)))


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    """Signs in brackets, each with the blanks around it."""
    done = 0
    for m in _SIGN.finditer(text):
        start, end = m.span()
        while start > done and text[start - 1] in " \t":
            start -= 1
        while end < len(text) and text[end] in " \t":
            end += 1
        done = end
        yield start, end, _sign(m[1])


def _sign(word: str) -> str:
    return {"at": "@", "dot": "."}.get(word.lower(), word)


def _said(text: str, pattern: re.Pattern) -> list[tuple[int, int, str]]:
    """The "at" and "dot" within the matches of a pattern, with the blanks around them."""
    return [(m.start() + p.start(), m.start() + p.end(), _sign(p[1])) for m in pattern.finditer(text) for p in _PAUSE.finditer(m[0])]


def reveal(text: str) -> Tape:
    """The text after all transducers."""
    tape = Tape(text)
    if not text.isascii() and (odd := _table().keys() & set(text)):
        table = _table()
        tape.rewrite([(m.start(), m.end(), table[m[0]]) for m in _any_of("".join(sorted(odd))).finditer(text)])
    # each test holds wherever its pattern matches
    low = tape.text.lower()
    if any(b in low for b in "[({<"):
        tape.rewrite(_bracketed(tape.text))
    if "dot" in low:
        for pattern in (_SAID, _HALF_SAID, _SAID_IP):
            tape.rewrite(_said(tape.text, pattern))
    if "ı" in low or "ſ" in low or "\u0307" in low:
        low = low.translate(_FOLDS)
    if sum(low.count(w + " ") + low.count(w + "-") for w in SPELLED) >= 3:
        tape.rewrite([(m.start(), m.end(), _digits(m[0])) for m in _SPELLED.finditer(tape.text)])
    return tape


def find_all(text: str, base: list[Span] | None = None) -> list[Span]:
    """Base spans and those that the transducers reveal."""
    base = find(text) if base is None else base
    tape = reveal(text)
    if tape.text == text:
        return base
    spans = set(base)
    known = [[s for s in base if s[1] == kind] for kind in range(len(KINDS))]  # of one kind, they don't overlap
    for start, kind, end in find(tape.text):
        a, b = tape.source(start, end)
        at = bisect_right(known[kind], a, key=lambda s: s[0]) - 1
        if at < 0 or b > known[kind][at][2]:
            spans.add((a, kind, b))
    return sorted(spans)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType([T.StructField("base", SPANS), T.StructField("spans", SPANS)])


def _arrow(rows: list[list[Span]]) -> pa.ListArray:
    ends, flat = [0], []
    for spans in rows:
        flat += spans
        ends.append(len(flat))
    fields = [pa.array([KINDS[x[1]] for x in flat], pa.string()), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end"]))


@F.arrow_udf(FOUND)
def find_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column function: struct<base, spans> of a text column."""
    for batch in batches:
        base, spans = [], []
        for value in batch:
            text = value.as_py() or ""
            base.append(find(text))
            spans.append(find_all(text, base[-1]))
        yield pa.StructArray.from_arrays([_arrow(base), _arrow(spans)], ["base", "spans"])
    give_back()


def redact(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in find_all(text):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


@F.arrow_udf(T.StringType())
def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column function: texts without personal data; null stays null."""
    for batch in batches:
        yield pa.array([redact(x.as_py()) if x.is_valid else None for x in batch], pa.string())
    give_back()


def digest(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts by kind, a digest of base spans, and all spans."""
    small_batches(spark)
    docs = texts_of(table(spark, sf_dir, "documents")).select("doc_id", find_spans("text").alias("found"))
    counts = [F.size(F.filter("found.base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return docs.select("doc_id", *counts, F.sha2(digest(F.col("found.base")), 256).alias("base_sha256"), digest(F.col("found.spans")).alias("spans"))
