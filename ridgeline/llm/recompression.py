"""Operator 5: removal of long word sequences that a document with a smaller id has too, found by recompression.

Each round renames runs of one symbol, then pairs of a "left" and a "right" symbol (a bit of the symbol's hash says
which it is). A new symbol's name is a hash of what it stands for, so names are global without any exchange. A symbol keeps the
range of words that decided it was formed; where that range lies inside a window of 50 words, every copy of the window forms the
same symbol. A window's anchor is the least name among such symbols of the highest round that has one (a single word, at
worst), hence a function of the window's words alone.

1. Anchors that only one document has are dropped: no window around them repeats elsewhere.
2. The windows of the remaining anchors are compared in full, by 64-bit hashes; for each, the least doc_id wins.
3. Documents take back those of their windows that another wins, and drop the words that they cover.

What a task has several times is combined before it is shuffled (one document for each anchor or window), so a passage that a third of
all documents share costs a row a task.

Defined results: null text has no words; texts shorter than a window lose nothing; a null doc_id neither loses nor wins words; equal rows
lose or keep the same words; rows that share a doc_id lose what any of them shares with a smaller id; any 64-bit id is allowed; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, cut_of, distinct_groups, having_ids, home_column, homes_of, joined, listed_ids, mix, packed, packed_table, runs, small_batches, stored, table, texts_of, windows, word_hashes

WINDOW = 50
ROUNDS = 4
CHUNK = 1 << 20
_FAR = np.int64(1 << 40)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(2**64 - 1)


def _times(n: int, c: np.uint64) -> np.uint64:
    return np.uint64(n * int(c) % 2**64)


def rounds(h: np.ndarray, doc: np.ndarray, n: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols after each round, with the range of words [lo, hi) that decided them; round 0 is the words."""
    sym, lo = h, np.arange(len(h), dtype=np.int64)
    hi = lo + 1
    out = [(sym, lo, hi)]
    for r in range(1, n + 1):
        if len(sym) < 2:
            break
        new = np.ones(len(sym), bool)
        edge = doc[1:] != doc[:-1]
        new[1:] = (sym[1:] != sym[:-1]) | edge
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(sym)))
        first = np.ones(len(at), bool)
        first[1:] = doc[at[1:]] != doc[at[1:] - 1]
        last = np.append(first[1:], True)
        before, after = np.maximum(at - 1, 0), np.minimum(at + size, len(sym) - 1)
        lo, hi = (
            np.where(first, -_FAR, np.minimum(np.minimum.reduceat(lo, at), np.minimum(lo[before], np.where(last, _FAR, lo[after])))),
            np.where(last, _FAR, np.maximum(np.maximum.reduceat(hi, at), np.maximum(hi[after], np.where(first, -_FAR, hi[before])))),
        )
        sym, doc = np.where(size > 1, mix(sym[at] * _A + size.astype(np.uint64) * _B + np.uint64(r)), sym[at]), doc[at]

        right = (mix(sym + _times(r, _A)) >> np.uint64(63)).astype(bool)
        together = np.append(doc[1:] == doc[:-1], False)
        pair = np.zeros(len(sym), bool)
        pair[:-1] = ~right[:-1] & right[1:] & together[:-1]
        second = np.append(False, pair[:-1])
        has_before = np.append(False, together[:-1])
        next_lo, next_hi = np.append(lo[1:], _FAR), np.append(hi[1:], -_FAR)
        last_lo, last_hi = np.append(_FAR, lo[:-1]), np.append(-_FAR, hi[:-1])
        # a pair rests on both; a left symbol without a pair on the symbol after it, a right one on that before it
        use_next, use_last = ~right & together, right & has_before & ~second
        low = np.where(use_next, np.minimum(lo, next_lo), np.where(use_last, np.minimum(lo, last_lo), np.where(right & ~has_before, -_FAR, lo)))
        high = np.where(use_next, np.maximum(hi, next_hi), np.where(use_last, np.maximum(hi, last_hi), np.where(~right & ~together, _FAR, hi)))
        sym = np.where(pair, mix(sym * _A + np.append(sym[1:], np.uint64(0)) * _B + np.uint64(r << 32)), sym)
        keep = ~second
        sym, lo, hi, doc = sym[keep], low[keep], high[keep], doc[keep]
        out.append((sym, lo, hi))
    return out


def anchors(h: np.ndarray, firsts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word, the anchor of the window that starts there (``_NONE`` where the document ends before the window)."""
    counts = np.diff(firsts)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin, end = firsts[:-1][doc], firsts[1:][doc]
    valid = np.arange(len(h)) + window <= end
    chosen = np.full(len(h), _NONE)
    top = window.bit_length() - 1
    for r, (sym, lo, hi) in reversed(list(enumerate(rounds(h, doc)))):
        if r == 0:  # the words of windows that no later round decides
            open_ = valid & (chosen == _NONE)
            if not open_.any():
                break
        at = np.clip(lo, 0, len(h) - 1)
        a, b = np.maximum(hi - window, begin[at]), np.minimum(lo, end[at] - window)
        some = np.flatnonzero((a <= b) & (lo >= 0) & (hi <= len(h)))
        a, b, value = a[some], b[some], np.minimum(mix(sym[some] ^ _times(r + 1, _B)), _NONE - np.uint64(1))
        k = np.floor(np.log2(b - a + 1)).astype(np.int64)
        least = np.full((top + 1, len(h)), _NONE)
        np.minimum.at(least, (k, a), value)
        np.minimum.at(least, (k, b - (1 << k) + 1), value)
        for level in range(top, 0, -1):
            half = 1 << (level - 1)
            np.minimum(least[level - 1], least[level], out=least[level - 1])
            np.minimum(least[level - 1][half:], least[level][:-half], out=least[level - 1][half:])
        chosen = np.where(valid & (chosen == _NONE), least[0], chosen)
    return chosen


def _shared_anchors(docs: DataFrame, buckets: int, homes: int) -> DataFrame:
    """home, docs, keys: anchors that a document shares with another one, packed by the document's home bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, count = [], [], 0

        def flush() -> pa.RecordBatch:
            key, doc = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            own = np.ones(len(key), bool)
            own[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[own], doc[own]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            size = np.diff(np.append(np.flatnonzero(first), len(key)))
            here = np.repeat(size > 1, size)  # two documents of this task have it: known to be shared
            rows = [[len(key) % buckets, b"", b"", b"", key[here].tobytes(), doc[here].tobytes()]]
            sent = key[first]
            rows += [[*r, b"", b""] for r in packed(cut_of(sent, buckets), buckets, sent, doc[first], size > 1)]
            return packed_table(rows, names).to_batches()[0]

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            doc_ids = batch.column(0).to_numpy()
            for i, j in runs(offsets):
                h, _, _, firsts = word_hashes(data, offsets[i : j + 1], lower=False)
                if not len(h):
                    continue
                chosen = anchors(h, firsts)
                of = np.repeat(doc_ids[i:j], np.diff(firsts))
                keep = chosen != _NONE
                keep[1:] &= (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])
                keys.append(chosen[keep])
                ids.append(of[keep])
                count += len(keys[-1])
            if count >= CHUNK:
                yield flush()
                keys, ids, count = [], [], 0
        if count:
            yield flush()

    names = ["bucket", "sent", "of", "several", "keys", "docs"]

    def meet(group: pa.Table) -> pa.Table:
        c = {n: group.column(n).to_pylist() for n in names[1:]}
        sent, of, several = joined(c["sent"], np.uint64), joined(c["of"], np.int64), joined(c["several"], bool)
        order = np.argsort(sent)
        sent, of, several = sent[order], of[order], several[order]
        same = np.zeros(len(sent), bool)
        same[1:] = sent[1:] == sent[:-1]
        same[:-1] |= same[1:]
        # sent twice: by two tasks, for two documents unless equal rows (which are copies, and settle by id)
        same &= ~several
        key, doc = np.concatenate([joined(c["keys"], np.uint64), sent[same]]), np.concatenate([joined(c["docs"], np.int64), of[same]])
        return packed_table(list(packed(homes_of(doc, homes), homes, doc, key)), ["home", "docs", "keys"])

    return docs.mapInArrow(send, "bucket int, sent binary, of binary, several binary, keys binary, docs binary").groupBy("bucket").applyInArrow(meet, "home int, docs binary, keys binary")


def _lost_windows(docs: DataFrame, shared: DataFrame, buckets: int, homes: int) -> DataFrame:
    """home, docs, hashes: windows of a document that one with a smaller id has too."""
    names = ["bucket", "docs", "hashes", "lost_docs", "lost_hashes"]

    def send(lists: pa.Table, texts: pa.Table) -> pa.Table:
        if not len(lists) or not len(texts):
            return packed_table([], names)
        doc, key = joined(lists.column("docs").to_pylist(), np.int64), joined(lists.column("keys").to_pylist(), np.uint64)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        data, offsets = buffers(texts.column("text").combine_chunks())
        doc_ids = texts.column("doc_id").to_numpy()
        found = []
        for i, j in runs(offsets):
            h, _, _, firsts = word_hashes(data, offsets[i : j + 1], lower=False)
            if not len(h):
                continue
            chosen = anchors(h, firsts)
            hashes, begins = windows(h, firsts, WINDOW, short=False)
            for d in range(i, j):
                a, b = np.searchsorted(doc, (doc_ids[d], doc_ids[d] + 1))
                n = int(begins[d - i + 1] - begins[d - i])
                if b > a and n:
                    own = chosen[firsts[d - i] : firsts[d - i] + n]
                    some = np.flatnonzero(np.isin(own, key[a:b]))
                    found.append((np.full(len(some), doc_ids[d]), hashes[begins[d - i] + some]))
        if not found:
            return packed_table([], names)
        of, value = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((of, value))
        of, value = of[order], value[order]
        first = np.ones(len(value), bool)
        first[1:] = value[1:] != value[:-1]
        size = np.diff(np.append(np.flatnonzero(first), len(value)))
        again = np.ones(len(value), bool)  # each window of a document once
        again[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
        lost = again & (of > np.repeat(of[first], size))
        rows = [[int(of[0] % buckets), b"", b"", of[lost].tobytes(), value[lost].tobytes()]]
        of, value = of[first], value[first]
        order = np.argsort(of, kind="stable")
        of, value = of[order], value[order]
        rows += [[*r, b"", b""] for r in packed(cut_of(value, buckets), buckets, of, value)]
        return packed_table(rows, names)

    def settle(group: pa.Table) -> pa.Table:
        c = {n: group.column(n).to_pylist() for n in names[1:]}
        of, value = joined(c["docs"], np.int64), joined(c["hashes"], np.uint64)
        order = np.lexsort((of, value))
        of, value = of[order], value[order]
        first = np.ones(len(value), bool)
        first[1:] = value[1:] != value[:-1]
        lost = of > np.repeat(of[first], np.diff(np.append(np.flatnonzero(first), len(value))))
        doc, value = np.concatenate([joined(c["lost_docs"], np.int64), of[lost]]), np.concatenate([joined(c["lost_hashes"], np.uint64), value[lost]])
        order = np.argsort(doc, kind="stable")
        return packed_table(list(packed(homes_of(doc[order], homes), homes, doc[order], value[order])), ["home", "docs", "hashes"])

    left = shared.groupBy("home")
    sent = left.cogroup(docs.withColumn("home", home_column(homes)("doc_id")).groupBy("home")).applyInArrow(send, "bucket int, docs binary, hashes binary, lost_docs binary, lost_hashes binary")
    return sent.groupBy("bucket").applyInArrow(settle, "home int, docs binary, hashes binary")


def kept_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for documents(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = homes = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = stored(_shared_anchors(some, buckets, homes), "shared-anchors")
    lost = _lost_windows(having_ids(some, listed_ids(shared)), shared, buckets, homes)

    def cut(lists: pa.Table, texts: pa.Table) -> pa.Table:
        doc, lost_hash = joined(lists.column("docs").to_pylist(), np.int64), joined(lists.column("hashes").to_pylist(), np.uint64)
        order = np.argsort(doc, kind="stable")
        doc, lost_hash = doc[order], lost_hash[order]
        data, offsets = buffers(texts.column("text").combine_chunks())
        keys = texts.column("doc_id").to_pylist()
        out = ([], [], [])
        for i, j in runs(offsets):
            h, s, e, firsts = word_hashes(data, offsets[i : j + 1], lower=False)
            hashes, begins = windows(h, firsts, WINDOW, short=False)
            for d in range(i, j):
                x, y = int(firsts[d - i]), int(firsts[d - i + 1])
                keep = np.ones(y - x, bool)
                a, b = np.searchsorted(doc, (keys[d], keys[d] + 1)) if keys[d] is not None else (0, 0)
                if b > a:
                    own = hashes[begins[d - i] : begins[d - i + 1]]
                    gone = np.flatnonzero(np.isin(own, lost_hash[a:b]))
                    edge = np.zeros(y - x + 1, np.int64)
                    np.add.at(edge, gone, 1)
                    np.add.at(edge, gone + WINDOW, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                out[0].append(y - x)
                out[1].append(int((~keep).sum()))
                at = np.flatnonzero(keep) + x
                out[2].append(b" ".join(data[p:q].tobytes() for p, q in zip(s[at].tolist(), e[at].tolist(), strict=True)).decode())
        return pa.table({"doc_id": pa.array(keys, pa.int64()), "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "kept": pa.array(out[2], pa.string())})

    homed = docs.withColumn("home", home_column(homes)("doc_id"))
    return lost.groupBy("home").cogroup(homed.groupBy("home")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, how many a smaller document has too, and a digest of the rest."""
    done = kept_words(texts_of(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM w)),
l AS (SELECT doc_id, i FROM k JOIN (SELECT h, min(doc_id) least FROM k GROUP BY h) USING (h) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) j FROM l),
word AS (SELECT doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) kept, count(*) n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
