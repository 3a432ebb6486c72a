"""Operator 10: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in Spark (on at most ``SAMPLE_PER_LANGUAGE`` expected documents a language, chosen by
a hash of the id, whole texts); the log-probability matrix (``BUCKETS`` x languages, at most ``MAX_LANGUAGES``: 64 MB)
is broadcast, and whole batches are scored in numpy.

Defined results: null text, or a text without a letter, gives ``und`` with score 0; ties go to the alphabetically first
language; a training set without labelled text gives ``und`` everywhere; no rows give no rows; repeated rows are each scored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, buffers, give_back, runs, small_batches, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 4000
PICKS = 1 << 62  # a sample is drawn by a hash below a share of this, so it is as exact for 10^12 rows as for a few
MAX_LANGUAGES = 512
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point up to 0x323AF (the last letters of Unicode 16): is it a letter, and its lower case."""
    chars = [chr(i) for i in range(0x323B0)]
    letter = np.array([unicodedata.category(c)[0] == "L" for c in chars])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    return letter, lower


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: bucket of each n-gram and its row; then which rows have a letter."""
    letter, lower = _letters()
    seg = data[offsets[0] : offsets[-1]]
    points = np.frombuffer(seg.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((seg & 0xC0) != 0x80)])[offsets - offsets[0]]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(heads))
    points = np.minimum(points, len(letter) - 1)
    is_letter = letter[points]
    first = np.ones(len(points), bool)
    first[1:] = row[1:] != row[:-1]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & ~first[1:]
    sym = np.where(is_letter, lower[points], 32)[keep].astype(np.uint64)
    row = row[keep]
    has = np.zeros(len(offsets) - 1, bool)
    has[row] = True
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    acc = np.zeros(len(sym), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(sym) < n:
            break
        acc = acc[: len(sym) - n + 1] * np.uint64(0x100000001B3) + sym[n - 1 :]
        if n in ORDERS:
            same = row[: len(acc)] == row[n - 1 :]
            bucket = ((acc + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
            yield bucket[same], row[: len(acc)][same], has


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # BUCKETS x languages, float32
    prior: np.ndarray


def train(docs: DataFrame, text: Column, lang: Column, key: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on rows with text and language; key picks the sample, the same one on every run."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(text.alias("text"), lang.cast("string").alias("lang"), F.pmod(F.xxhash64(key), F.lit(PICKS)).alias("pick")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(PICKS, max(1, PICKS * per_language // sizes[k])))])
    sample = rows.where(F.col("pick") < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(languages)}
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            of = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j in runs(offsets, PIECE):
                for bucket, row, _ in grams(data, offsets[i : j + 1]):
                    total += np.bincount(of[i:j][row] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        lang_at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang_at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang_at, bucket])], ["at", "bucket", "n"])
        give_back()

    counts = sample.mapInArrow(count, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.ones((BUCKETS, len(languages)))
    np.add.at(matrix, (counts["bucket"].to_numpy(), counts["at"].to_numpy()), counts["n"].to_numpy())
    return Model(languages, np.log(matrix / matrix.sum(0)).astype(np.float32), np.log(np.array([sizes[k] for k in languages]) / sum(sizes.values())))


def score_rows(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    total, letters = np.tile(model.prior, (n, 1)), np.zeros(n, bool)
    for i, j in runs(offsets, PIECE // 4):
        for bucket, row, has in grams(data, offsets[i : j + 1]):
            letters[i:j] |= has
            if len(row) and model.languages:
                at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                total[i + row[at]] += np.add.reduceat(model.log_prob[bucket], at, axis=0, dtype=np.float64)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    best = total.argmax(1)
    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """Add struct<lang_pred string, score double>."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, score = score_rows(shared.value, batch)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], ["lang_pred", "score"])
        give_back()

    return docs.withColumn(to, scored(docs[text].cast("string")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language; learn from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = train(docs.where(~held_out), F.col("text"), F.col("lang"), F.col("doc_id"))
    done = predict(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")
