"""Operator 6: removal of byte strings of 400 bytes that occur elsewhere too, decided on Burrows-Wheeler transforms.

1. A window (400 consecutive bytes of one document) has an anchor under each of three orders of 32-byte grams: the least gram in
   it. Equal windows have equal anchors. Anchors that occur once in the corpus are dropped; a window of which all three anchors occur
   again is a candidate.
2. Neighbouring candidates with one anchor form a region; regions meet by anchor. Equal regions settle each other, and one of them
   goes on. A task builds the transform of its regions and expands intervals breadth-first, each round by one byte at the front:
   round k finds the suffixes that have exactly k bytes in common with the one before, and the rounds stop at 400.
   Suffixes that are still together start a string that occurs more than once. The sort that orders the suffixes tells no lengths.
3. Anchors that occur more than ``COMMON`` times would make one region group grow with the corpus; candidates with no rarer anchor
   are compared by 64-bit hashes of their bytes instead, counted in each task before they are shuffled.
4. Documents take their places back and drop the bytes.

Defined results: null text counts as empty; shorter texts lose nothing; equal rows are elsewhere to each other; a null doc_id
neither loses bytes nor counts; rows that share a doc_id are told apart by their texts; any 64-bit id is allowed; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, buffers, combine, cut_of, distinct_groups, eights, having_ids, home_column, homes_of, joined, listed_ids, mix, packed, packed_table, runs, small_batches, stored, table, texts_of

LENGTH = 400
GRAM = 32
ORDERS = np.array([0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5], np.uint64)
LOW = 16  # grams of a window that are low under an order, on average
COMMON = 2000
MAX_COMMON_KEYS = 1 << 18  # whose list is broadcast: 2 MB
CHUNK = 1 << 20
BATCH_BYTES = 1 << 18  # 400 rounds cost little a byte then; a larger group makes its own batch
LONG = 2 << 20
_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE, _PLACES = np.uint64(23), np.uint64((1 << 23) - 1)  # a piece has fewer bytes than that


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, and begin and end bytes of the rows, for pieces of a batch; a long row comes in parts that overlap by a window less a byte."""
    for i, j in runs(offsets):
        if j == i + 1 and offsets[j] - offsets[i] > LONG:
            for a in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j]) - LENGTH + 1), PIECE):
                yield i, np.array([a]), np.array([min(a + PIECE + LENGTH - 1, int(offsets[j]))])
        else:
            yield i, offsets[i:j], offsets[i + 1 : j + 1]


class Piece:
    """Window starts of some rows' bytes, numbered one after another, and their anchors under each order."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        self.lo, hi = int(begins[0]), int(ends[-1])
        self.seg = data[self.lo : hi]
        self.begins = begins - self.lo
        self.counts = np.maximum(ends - begins - LENGTH + 1, 0)
        self.row_at = np.concatenate([[0], np.cumsum(self.counts)])
        self.windows = int(self.row_at[-1])
        if self.windows:
            level = eights(self.seg)[: len(self.seg) - 7] * _C
            level ^= level >> np.uint64(32)
            width = 8
            while width < GRAM:  # anchors only select, so a few steps do
                longer = level[:-width] * _D
                longer += level[width:]
                longer ^= longer >> np.uint64(29)
                level, width = longer, 2 * width
            self.grams = level

    def row(self, window: np.ndarray) -> np.ndarray:
        """The row of each window."""
        return np.searchsorted(self.row_at, window, "right") - 1

    def start(self, window: np.ndarray) -> np.ndarray:
        """The byte of the piece where each window starts."""
        row = self.row(window)
        return window - self.row_at[row] + self.begins[row]

    def whole(self, start: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start there, of grams that cover them and are mixed well."""
        level, width = mix(eights(self.seg)[: len(self.seg) - 7]), 8
        while width < GRAM:
            level, width = combine(level[:-width], level[width:]), 2 * width
        out = level[start]
        for at in [*range(GRAM, LENGTH - GRAM, GRAM), LENGTH - GRAM]:
            out = combine(out, level[start + at])
        return out

    def runs(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first window and number of windows of each run of windows that have their anchor at one place.

        Grams compare by their high bits, and the first of equal ones wins. Only grams that are low enough to be anchors as a rule
        are looked at, and all grams of the rows with a window that has none of those."""
        ranked = self.grams * ORDERS[order]
        span = LENGTH - GRAM + 1
        own = np.flatnonzero(self.counts)
        first, last = self.begins[own], self.begins[own] + self.counts[own]  # windows start from first, before last
        low = ranked < np.uint64(min(LOW / span, 0.99) * 2**64)
        edges = np.stack([first, last + span - 1], 1).ravel()  # of the grams that windows have
        low &= np.repeat(np.arange(len(edges) + 1) % 2 == 1, np.diff(np.concatenate([[0], edges, [len(low)]])))
        place = np.flatnonzero(low)
        near = np.sort(np.concatenate([first - 1, place, last + span - 1]))
        bare = near[:-1][np.diff(near) > span]
        row = np.searchsorted(first, bare + 1, "right") - 1
        row = np.unique(row[bare < last[row] + span - 1])
        if len(row):
            for r in row.tolist():
                low[first[r] : last[r] + span - 1] = True
            place = np.flatnonzero(low)
        value = ranked[place] >> _PLACE
        while len(place) > 2:  # a gram is no anchor if all windows that have it have a lower one, before or behind it
            kept = np.ones(len(place), bool)
            kept[1:-1] = (value[:-2] > value[1:-1]) | (value[2:] >= value[1:-1]) | (place[2:] - place[:-2] > span)
            before, value, place = len(place), value[kept], place[kept]
            if len(place) > 0.85 * before:
                break
        # windows change when they pass a gram, come to one, begin a row or end it
        event = np.sort(np.concatenate([place + 1 << 2, place - span + 1 << 2 | 1, first << 2 | 2, last << 2 | 3]))
        kind, event = event & 3, event >> 2
        inside = np.cumsum((kind == 2).astype(np.int8) - (kind == 3)) > 0
        inside[:-1] &= event[1:] > event[:-1]
        passed, come, event = np.cumsum(kind == 0)[inside], np.cumsum(kind == 1)[inside], event[inside]
        # the least of the grams between, from those of 1, 2, 4, ... grams
        least, found = value << _PLACE | np.arange(len(value), dtype=np.uint64), np.empty(len(event), np.int64)
        level = np.frexp(come - passed)[1] - 1
        for k in range(int(level.max()) + 1):
            q = np.flatnonzero(level == k)
            found[q] = np.minimum(least[passed[q]], least[come[q] - (1 << k)]) & _PLACES
            least = np.minimum(least[: max(0, len(least) - (1 << k))], least[1 << k :])
        new = np.append(True, found[1:] != found[:-1])
        place, event = place[found[new]], event[new]
        row = np.searchsorted(first, event, "right") - 1
        at = event - first[row] + self.row_at[own[row]]
        return ranked[place], at, np.diff(np.append(at, self.windows))


def suffix_order(sym: np.ndarray, bits: int) -> np.ndarray:
    """Places of all suffixes in their order, by sorts of prefixes of doubling length, of those that are still tied alone.

    The last symbols of the regions differ: no two suffixes are equal, and tied ones go on beyond what they have in common."""
    n, width = len(sym), max(1, 62 // bits)  # symbols in the first sort key
    ahead = np.append(sym + 1, np.zeros(width, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key << bits | ahead[k : k + n]
    order, slots, rank = np.argsort(key), np.arange(n), np.empty(n, np.int64)
    key = key[order]
    while True:
        new = np.append(True, key[1:] != key[:-1])
        rank[order[slots]] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the first slot of each tie
        tied = ~(new & np.append(new[1:], True))
        slots = slots[tied]
        if not len(slots):
            return order
        own = order[slots]
        key = rank[own] * n + rank[own + width]
        by = np.argsort(key)
        order[slots], key = own[by], key[by]
        width *= 2


def dense(sym: np.ndarray) -> np.ndarray:
    """Small numbers in the order of the symbols: the bytes that occur, then one for all ends."""
    plain = np.minimum(sym, 256)
    number = np.cumsum(np.bincount(plain, minlength=257) > 0) - 1
    return number.astype(np.uint16)[plain]


class Transform:
    """A Burrows-Wheeler transform that extends many intervals of suffixes backward at once.

    Bit planes of the transform, highest first, split an interval into those of its distinct symbols, whatever its width."""

    def __init__(self, symbols: np.ndarray, ends: int):
        """symbols: the transform, small numbers (uint16) of which the greatest is that of all ``ends`` region ends."""
        n = len(symbols)
        step = np.empty(n, np.int32)
        step[np.argsort(symbols, kind="stable")] = np.arange(n, dtype=np.int32)  # last to first; a radix sort
        self.step, self.bodies = step, n - ends  # suffixes that are an end alone come last
        self.planes, of = [], np.arange(n, dtype=np.int32)
        for level in reversed(range(int(symbols.max()).bit_length())):
            one = (symbols[of] >> np.uint16(level) & np.uint16(1)).astype(bool)
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.planes.append(zeros)
            of = np.concatenate([of[~one], of[one]])
        self.last = step[of]

    def backward(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all strings that are one byte longer at the front than those of the intervals from lo up to hi."""
        wide = hi - lo > 1
        one = self.step[lo[~wide]]
        lo, hi = lo[wide], hi[wide]
        for zeros in self.planes if len(lo) else []:
            low, high = zeros[lo], zeros[hi]
            rest_low, rest_high = lo - low + zeros[-1], hi - high + zeros[-1]
            lo, hi = np.concatenate([low, rest_low]), np.concatenate([high, rest_high])
            some = lo < hi
            lo, hi = lo[some], hi[some]
        if len(lo):
            lo, hi = self.last[lo], self.last[hi - 1] + 1
        lo, hi = np.concatenate([one, lo]), np.concatenate([one + 1, hi])
        body = lo < self.bodies
        return lo[body], hi[body]


def repeated(regions: list[bytes]) -> list[np.ndarray]:
    """For each region, whether the string of LENGTH bytes at each place occurs at another place of the regions too.

    Round k finds the borders between sorted suffixes that have exactly k bytes in common: they end the intervals of strings of k + 1 bytes, which
    are the backward extensions of the intervals that the round before was the first to end. Borders that LENGTH rounds have not found lie within one string."""
    sizes = np.array([len(r) for r in regions])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(at[-1])
    sym = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[at[1:] - 1] = False
    sym[inside] = np.frombuffer(b"".join(regions), np.uint8)
    sym[~inside] = 256 + np.arange(len(regions))  # each region ends in a symbol of its own
    order = suffix_order(sym, int(257 + len(regions)).bit_length())
    transform = Transform(dense(sym)[order - 1], len(regions))
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    head = sym[order]
    lo = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])).astype(np.int32)
    hi = np.append(lo[1:], np.int32(n))
    for _ in range(LENGTH):
        new = ~border[hi]
        lo, hi = lo[new], hi[new]
        if not len(hi):
            break
        border[hi] = True
        lo, hi = transform.backward(lo, hi)
    twice = np.zeros(n, bool)
    together = np.flatnonzero(~border)
    twice[order[together]] = True
    twice[order[together - 1]] = True
    return [twice[a : a + s] for a, s in zip(at.tolist(), sizes.tolist(), strict=False)]


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    a = np.flatnonzero(edge == 1)
    return a, np.flatnonzero(edge == -1) - a


def _among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _anchors_again(docs: DataFrame, buckets: int, homes: int) -> DataFrame:
    """home, docs, keys: anchors of a document that occur again; common: anchors that occur over COMMON times (home -1)."""
    names = ["bucket", "sent", "of", "several", "times", "keys", "docs"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, count = [], [], 0

        def flush() -> pa.RecordBatch:
            key, doc = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            at = np.flatnonzero(first)
            times = np.diff(np.append(at, len(key)))
            again = np.repeat(times > 1, times)
            rows = [[len(key) % buckets, b"", b"", b"", b"", key[again].tobytes(), doc[again].tobytes()]]
            sent = key[first]
            rows += [[*r, b"", b""] for r in packed(cut_of(mix(sent), buckets), buckets, sent, doc[first], times > 1, times.astype(np.int32))]
            return packed_table(rows, names).to_batches()[0]

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            doc_ids = batch.column(0).to_numpy()
            for i, begins, ends in pieces(offsets):
                piece = Piece(data, begins, ends)
                if not piece.windows:
                    continue
                for order in range(len(ORDERS)):
                    key, at, _ = piece.runs(order)
                    keys.append(key)
                    ids.append(doc_ids[i + piece.row(at)])
                    count += len(key)
            if count >= CHUNK:
                yield flush()
                keys, ids, count = [], [], 0
        if count:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        c = {n: group.column(n).to_pylist() for n in names[1:]}
        sent, of, several, times = joined(c["sent"], np.uint64), joined(c["of"], np.int64), joined(c["several"], bool), joined(c["times"], np.int32)
        rows = []
        if len(sent):
            order = np.argsort(sent)
            sent, of, several, times = sent[order], of[order], several[order], times[order]
            at = np.flatnonzero(np.concatenate([[True], sent[1:] != sent[:-1]]))
            total = np.add.reduceat(times.astype(np.int64), at)
            again = np.repeat(total > 1, np.diff(np.append(at, len(sent)))) & ~several
            sent_again, of_again, common = sent[again], of[again], sent[at][total > COMMON]
            if len(common):
                rows.append([-1, total[total > COMMON].tobytes(), common.tobytes()])
        else:
            sent_again, of_again = sent, of
        key, doc = np.concatenate([joined(c["keys"], np.uint64), sent_again]), np.concatenate([joined(c["docs"], np.int64), of_again])
        return packed_table(rows + list(packed(homes_of(doc, homes), homes, doc, key)), ["home", "docs", "keys"])

    return docs.mapInArrow(send, "bucket int, sent binary, of binary, several binary, times binary, keys binary, docs binary").groupBy("bucket").applyInArrow(meet, "home int, docs binary, keys binary")


def common_keys(again: DataFrame) -> np.ndarray:
    """Anchors too common to meet in one group: those over COMMON, or over the next power of two that keeps the list in bounds."""
    limit = COMMON
    while True:
        keys, total = 0, []
        for r in again.where("home = -1").toLocalIterator():
            times, key = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["keys"], np.uint64)
            total.append(key[times > limit])
            keys += len(total[-1])
            if keys > MAX_COMMON_KEYS:
                break
        else:
            return np.sort(np.concatenate(total)) if total else np.zeros(0, np.uint64)
        limit *= 2


_LOST = ["lost_docs", "lost_starts", "lost_sizes"]
_SENT = ["bucket", "keys", "docs", "starts", "sizes", "done", "alone", "bytes", "hashes", "hash_docs", "hash_starts", "hash_done", *_LOST]


def _repeats(docs: DataFrame, again: DataFrame, common: np.ndarray, buckets: int, homes: int) -> DataFrame:
    """home, docs, starts, sizes: ranges of window starts whose strings occur elsewhere."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def send(lists: pa.Table, texts: pa.Table) -> pa.Table:
        if not len(lists) or not len(texts):
            return packed_table([], _SENT)
        listed, key = joined(lists.column("docs").to_pylist(), np.int64), joined(lists.column("keys").to_pylist(), np.uint64)
        of_doc = lambda docs: mix(docs.view(np.uint64))
        pairs = np.sort(key ^ of_doc(listed))  # two alike only add candidates
        data, offsets = buffers(texts.column("text").combine_chunks())
        doc_ids = texts.column("doc_id").to_numpy()
        regions, bodies, single = [], [], []
        for i, begins, ends in pieces(offsets):
            piece = Piece(data, begins, ends)
            if not piece.windows:
                continue
            found = [piece.runs(o) for o in range(len(ORDERS))]
            at = np.unique(np.concatenate([begin for _, begin, _ in found]))  # stretches of windows with one anchor under each order
            count, row = np.diff(np.append(at, piece.windows)), piece.row(at)
            candidate, primary, rare, run = np.ones(len(at), bool), np.zeros(len(at), np.uint64), np.zeros(len(at), bool), np.zeros(len(at), np.int64)
            for o, (anchor, begin, _) in enumerate(found):
                of = np.searchsorted(begin, at, "right") - 1
                candidate &= _among(pairs, anchor ^ of_doc(doc_ids[i + piece.row(begin)]))[of]
                seldom = ~_among(shared.value, anchor)[of]
                use = seldom & ~rare
                primary[use] = anchor[of[use]]
                run[use] = of[use] * len(ORDERS) + o
                rare |= seldom
            cold = np.flatnonzero(candidate & rare)
            if len(cold):
                new = np.ones(len(cold), bool)
                new[1:] = (at[cold[1:]] != at[cold[:-1]] + count[cold[:-1]]) | (primary[cold[1:]] != primary[cold[:-1]]) | (row[cold[1:]] != row[cold[:-1]])
                begin = np.flatnonzero(new)
                size, first = np.add.reduceat(count[cold], begin), cold[begin]
                start = piece.start(at[first])
                offset = start + piece.lo - offsets[i + row[first]]
                # windows of one run have their anchor at one place, so they differ from each other
                alone = run[first] == run[cold[np.append(begin[1:], len(cold)) - 1]]
                regions.append((primary[first], doc_ids[i + row[first]], offset, size, alone))
                bodies += [piece.seg[s : s + k + LENGTH - 1].tobytes() for s, k in zip(start.tolist(), size.tolist(), strict=True)]
            hot = candidate & ~rare
            if hot.any():
                window = np.flatnonzero(np.repeat(hot, count))
                start, of = piece.start(window), i + piece.row(window)
                single.append((piece.whole(start), doc_ids[of], start + piece.lo - offsets[of]))
        lost, rows = [], []
        if regions:
            anchor, own, offset, size, alone = (np.concatenate(x) for x in zip(*regions, strict=True))
            # equal regions of one task: none needs an answer, one goes on
            seen: dict[tuple[int, bytes], int] = {}
            like = np.array([seen.setdefault(x, k) for k, x in enumerate(zip(anchor.tolist(), bodies, strict=True))])
            done = np.bincount(like, minlength=len(like))[like] > 1
            lost.append((own[done], offset[done], size[done]))
            order = np.unique(like)
            bucket = cut_of(mix(anchor[order]), buckets)
            order, bucket = order[np.argsort(bucket, kind="stable")], np.sort(bucket)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.unique(bucket).tolist():
                o = order[cuts[b] : cuts[b + 1]]
                rows.append([b, anchor[o].tobytes(), own[o].tobytes(), offset[o].tobytes(), size[o].astype(np.int32).tobytes(), done[o].tobytes(), alone[o].tobytes(), b"".join(bodies[x] for x in o.tolist()), *[b""] * 7])
        if single:
            value, own, offset = (np.concatenate(x) for x in zip(*single, strict=True))
            order = np.argsort(value)
            value, own, offset = value[order], own[order], offset[order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            times = np.diff(np.append(np.flatnonzero(new), len(value)))
            many = np.repeat(times > 1, times)
            lost.append((own[many], offset[many], np.ones(int(many.sum()), np.int64)))
            for b, *values in packed(cut_of(value[new], buckets), buckets, value[new], own[new], offset[new], many[new]):
                rows.append([b, *[b""] * 7, *values, *[b""] * 3])
        if lost:
            own, offset, size = (np.concatenate(x) for x in zip(*lost, strict=True))
            rows.append([len(own) % buckets, *[b""] * 11, own.tobytes(), offset.astype(np.int64).tobytes(), size.astype(np.int64).tobytes()])
        return packed_table(rows, _SENT)

    def settle(group: pa.Table) -> pa.Table:
        c = {n: group.column(n).to_pylist() for n in _SENT[1:]}
        lost = [tuple(joined(c[n], np.int64) for n in _LOST)]
        value, own, offset, done = joined(c["hashes"], np.uint64), joined(c["hash_docs"], np.int64), joined(c["hash_starts"], np.int64), joined(c["hash_done"], bool)
        if len(value):
            order = np.argsort(value)
            value, own, offset, done = value[order], own[order], offset[order], done[order]
            times = np.diff(np.append(np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])), len(value)))
            many = np.repeat(times > 1, times) & ~done
            lost.append((own[many], offset[many], np.ones(int(many.sum()), np.int64)))
        anchor = joined(c["keys"], np.uint64)
        if len(anchor):
            own, done = joined(c["docs"], np.int64), joined(c["done"], bool).copy()
            offset, size = joined(c["starts"], np.int64), joined(c["sizes"], np.int32).astype(np.int64)
            alone = joined(c["alone"], bool)
            body, at = b"".join(c["bytes"]), np.concatenate([[0], np.cumsum(size + LENGTH - 1)]).tolist()
            text = [body[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            seen: dict[tuple[int, bytes], list[int]] = {}
            for k, a in enumerate(anchor.tolist()):
                seen.setdefault((a, text[k]), []).append(k)
            groups: dict[int, list[tuple[bytes, list[int]]]] = {}
            for (a, t), sites in seen.items():
                if len(sites) > 1:
                    s = np.array(sites)[~done[sites]]
                    lost.append((own[s], offset[s], size[s]))
                    done[sites] = True
                groups.setdefault(a, []).append((t, sites))
            batch, held = [], 0
            for distinct in groups.values():
                # else all are settled, or nothing can be equal
                if any(not done[sites[0]] for _, sites in distinct) and (len(distinct) > 1 or not alone[distinct[0][1][0]]):
                    batch += distinct
                    held += sum(len(t) for t, _ in distinct)
                if held >= BATCH_BYTES:
                    lost += _settled(batch, done, own, offset, size)
                    batch, held = [], 0
            lost += _settled(batch, done, own, offset, size)
        doc, start, length = (np.concatenate(x).astype(np.int64) for x in zip(*lost, strict=True))
        return packed_table(list(packed(homes_of(doc, homes), homes, doc, start, length)), ["home", "docs", "starts", "sizes"])

    homed = docs.withColumn("home", home_column(homes)("doc_id"))
    schema = ", ".join(f"{n} {'int' if n == 'bucket' else 'binary'}" for n in _SENT)
    sent = again.where("home >= 0").groupBy("home").cogroup(homed.groupBy("home")).applyInArrow(send, schema)
    return sent.groupBy("bucket").applyInArrow(settle, "home int, docs binary, starts binary, sizes binary")


def _settled(batch: list, done: np.ndarray, own: np.ndarray, offset: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if not batch:
        return []
    out = []
    for (_, sites), flags in zip(batch, repeated([t for t, _ in batch]), strict=True):
        k = sites[0]
        if not done[k]:
            a, n = _stretches(flags[: size[k]])
            out.append((np.full(len(a), own[k]), offset[k] + a, n))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, of: ids that name one text each; ``of`` is the id that was given. Only ids of several rows are replaced, by a hash of id and text."""
    several = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("several")), "several")
    if several.isEmpty():
        return docs.withColumn("of", F.col("doc_id"))
    key = F.when(F.col("several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    return docs.join(several, "doc_id", "left").select(key.alias("doc_id"), "text", F.col("doc_id").alias("of"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for documents(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = _keyed(docs)
    buckets = homes = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    again = stored(_anchors_again(some, buckets, homes), "anchors")
    some = having_ids(some, listed_ids(again.where("home >= 0")))
    ranges = _repeats(some, again, common_keys(again), buckets, homes)

    def cut(lists: pa.Table, texts: pa.Table) -> pa.Table:
        own, start, size = (joined(lists.column(n).to_pylist(), np.int64) for n in ("docs", "starts", "sizes"))
        order = np.argsort(own, kind="stable")
        own, start, size = own[order], start[order], size[order]
        data, offsets = buffers(texts.column("text").combine_chunks())
        keys = texts.column("doc_id").to_pylist()
        out = ([], [], [], [])
        for d, key in enumerate(keys):
            body = data[offsets[d] : offsets[d + 1]]
            gone = np.zeros(len(body), bool)
            if key is not None:
                a, b = np.searchsorted(own, (key, key + 1))
                edge = np.zeros(len(body) + 1, np.int32)
                np.add.at(edge, start[a:b], 1)
                np.add.at(edge, start[a:b] + size[a:b] + LENGTH - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
            for column, value in zip(out, (len(body), int(gone.sum()), len(_stretches(gone)[0]), body[~gone].tobytes()), strict=True):
                column.append(value)
        return pa.table({"doc_id": texts.column("of"), **{n: pa.array(x, pa.int64()) for n, x in zip(("n_bytes", "n_removed", "n_spans"), out, strict=False)}, "kept": pa.array(out[3], pa.binary())})

    homed = docs.withColumn("home", home_column(homes)("doc_id"))
    return ranges.groupBy("home").cogroup(homed.groupBy("home")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, how many repeat elsewhere in long strings, and a digest of the rest."""
    done = without_repeats(texts_of(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
