"""Shared helpers: Arrow text buffers, vectorised word and shingle hashes, session settings.

Hashes are 64-bit content fingerprints: equal input gives the same value in every task, so no dictionary is exchanged. Words are
mixed eight bytes at a time, windows by doubling, and each step is non-linear.
All kernels work on pieces of about ``PIECE`` bytes; a longer word or document only enlarges its own piece.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 1 << 19
MAX_BATCH_ROWS = 500
BLOOM_BITS = 1 << 25  # 4 MB, whatever the input

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LONG_WORD = 512  # bytes; longer words are hashed one by one
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8), offs.astype(np.int64)


def runs(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order; not linear in either, so that no regular sequence meets its mirror image."""
    return mix(mix(a * _A) ^ (b * _B))


def eights(seg: np.ndarray) -> np.ndarray:
    """For each place of a buffer, and the place after its end, the eight bytes from there (zeros past the end) as one number."""
    return np.ndarray((len(seg) + 1,), "<u8", np.concatenate([seg, np.zeros(8, np.uint8)]), strides=(1,))


def _words(seg: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one piece; cuts: positions where a document starts."""
    word = ~_SPACE[seg]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(seg))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if lower:
        seg = _LOWER[seg]
    chunk, size = eights(seg), ends - starts
    h = mix(mix(size.astype(np.uint64) * _A) ^ (chunk[starts] & _MASKS[np.minimum(size, 8)]))
    more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        h[more] = combine(h[more], chunk[starts[more] + at] & _MASKS[np.minimum(size[more] - at, 8)])
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(seg[starts[k] : ends[k]].tobytes())
    return h, starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: hashes, byte starts, byte ends, and each row's first word (one more than rows)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    got, at = [], lo
    while at < hi:
        end = min(at + PIECE, hi)
        if end < hi:  # cut where a word can't go on: after white space, else at the next one
            back = np.flatnonzero(_SPACE[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                step = PIECE
                while end < hi:
                    ahead = np.flatnonzero(_SPACE[data[end : min(end + step, hi)]])
                    if len(ahead):
                        end += int(ahead[0]) + 1
                        break
                    end = min(end + step, hi)
        h, s, e = _words(data[at:end], offsets[:-1] - at, lower)
        got.append((h, s + at, e + at))
        at = end
    if got:
        h, s, e = (np.concatenate(x) for x in zip(*got, strict=True))
    else:
        h, s, e = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return h, s, e, np.searchsorted(s, offsets, "left")


def stretches(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on, by doubling."""
    out, done, cur, width = None, 0, h, 1
    while True:
        if k & width:
            part = cur[done:]
            out = part if out is None else combine(out[: len(part)], part)
            done += width
        width *= 2
        if width > k:
            return out[: max(0, len(h) - k + 1)]
        half = width // 2
        cur = combine(cur[: max(0, len(cur) - half)], cur[half:])


def windows(h: np.ndarray, firsts: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's windows of k words, and where each row's windows begin; short: fewer words count as one window."""
    counts = np.diff(firsts)
    n = np.maximum(counts - k + 1, 0)
    few = np.flatnonzero((counts > 0) & (counts < k)) if short else np.zeros(0, np.int64)
    n[few] = 1
    begins = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(begins[-1]) - begins[row] + firsts[:-1][row]
    whole = stretches(h, k)
    out = np.zeros(len(start), np.uint64)
    long = counts[row] >= k
    out[long] = whole[start[long]]
    if len(few):
        of = counts[few].astype(np.uint64) * _B
        for j in range(k - 1):
            own = counts[few] > j
            of[own] = combine(of[own], h[firsts[few[own]] + j])
        out[begins[few]] = of
    return out, begins


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors don't take it along."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever signs that has."""
    return df["`" + name.replace("`", "``") + "`"]


def columns(df: DataFrame) -> list[Column]:
    return [column(df, c) for c in df.columns]


def _marked(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """The rows as structs, and whether a bitmap of the ids has a row's id. BLOOM_BITS / 8 bytes at most go to all tasks."""
    hashed = lambda d: F.pmod(F.xxhash64(d[key]), F.lit(BLOOM_BITS)) + 1
    bits = ids.select(hashed(ids).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    packed_rows = rows.select(F.struct(*columns(rows)).alias("_row"), hashed(rows).alias("_hash"))
    at = F.bitmap_bit_position("_hash")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce((byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False))
    return packed_rows.join(F.broadcast(bits), F.bitmap_bucket_number("_hash") == F.col("_part"), "left"), bit


def _unpacked(marked: DataFrame, columns: list[str]) -> DataFrame:
    return marked.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def having_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows with these ids, and perhaps a few others: a bitmap of fixed size goes to all tasks, so that nothing is
    shuffled. Where the ids are too many for it, an exact join follows. Callers must not mind the others."""
    marked, bit = _marked(rows, ids, key)
    passed = _unpacked(marked.where(bit), rows.columns)
    return passed if 16 * ids.count() < BLOOM_BITS else passed.join(ids, key, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exactly the rows without these ids (a null id stays): only rows whose id the bitmap has are shuffled, to an exact join."""
    marked, bit = _marked(rows, ids, key)
    doubtful = _unpacked(marked.where(bit), rows.columns)
    return _unpacked(marked.where(~bit), rows.columns).union(doubtful.join(ids, key, "left_anti").select(*columns(doubtful)))


def distinct_groups(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return first


def cut_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key by its high bits."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def homes_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each doc_id."""
    return (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def home_column(buckets: int):
    """Column function: ``homes_of`` for a column of ids; null ids go to the bucket of 0."""

    @F.arrow_udf(T.IntegerType())
    def home(ids: pa.Array) -> pa.Array:
        return pa.array(homes_of(ids.fill_null(0).to_numpy(zero_copy_only=False), buckets).astype(np.int32))

    return home


def packed(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[list]:
    """The columns' bytes for each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    columns = [c[order] for c in columns]
    for b in range(buckets):
        x, y = cuts[b], cuts[b + 1]
        if y > x:
            yield [b, *(c[x:y].tobytes() for c in columns)]


def packed_table(rows: Iterable[list], names: list[str]) -> pa.Table:
    """A table of packed rows: a bucket or home, then bytes."""
    rows = list(rows)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, pa.int32() if n in ("bucket", "home") else pa.binary()) for n, c in zip(names, columns, strict=True)})


def joined(values: list, dtype) -> np.ndarray:
    """One array of the bytes of several packed rows."""
    return np.frombuffer(b"".join(v for v in values if v), dtype)


def listed_ids(lists: DataFrame) -> DataFrame:
    """doc_id: the documents in packed lists."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(docs, np.int64)))], ["doc_id"])

    return lists.select("docs").mapInArrow(ids, "doc_id long").distinct()


def give_back() -> None:
    """Return freed memory to the system at a task's end; a Python worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MAX_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only id and text, so that other columns of any name can't clash with an operator's own."""
    return docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).cast("string").alias("text"))
