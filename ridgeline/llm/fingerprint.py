"""Operator 2: threshold-scaled document fingerprints.

A sketch holds every distinct hash of a text's five-word shingles that is below a fixed fraction of all hashes: ``2^64 / SCALE``, or all of
them for a set of up to ``WHOLE`` shingles. The fraction is part of the sketch. Two sketches are compared at the smaller fraction of
the two: hashes above its threshold are left out, so both keep the same part of their sets and their overlap estimates containment, also
between a short and a very long document. Sketches merge in the same way, and the merged sketch is that of the union. Words are
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer than five words count as one shingle.

A fingerprint is the scale (1 or ``SCALE``), a colon, and the ascending hashes as little-endian 64-bit values in base64.

Defined results: null and empty texts, and texts of white space, have the empty fingerprint; two empty fingerprints are alike
(1), an empty and another are not (0); nor are two where the smaller one has no hash below the common threshold (0, unless they are equal); equal texts have equal fingerprints; no rows give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, runs, small_batches, table, texts_of, windows, word_hashes

SHINGLE = 5
SCALE = 4
WHOLE = 256


@dataclass
class Sketch:
    """The hashes of a set, ascending, that are below 2^64 / scale."""

    scale: int
    hashes: np.ndarray

    def at(self, scale: int) -> np.ndarray:
        """The hashes below 2^64 / scale, where that is no larger than the own threshold."""
        return self.hashes[: np.searchsorted(self.hashes, np.uint64(2**64 // scale - 1), "right")]


def sketch_of(hashes: np.ndarray) -> Sketch:
    """The sketch of a whole set of distinct ascending hashes."""
    whole = Sketch(1, hashes)
    return whole if len(hashes) <= WHOLE else Sketch(SCALE, whole.at(SCALE))


def sketches(texts: pa.Array, k: int = SHINGLE) -> list[Sketch]:
    data, offsets = buffers(texts)
    out = []
    for i, j in runs(offsets):
        h, _, _, firsts = word_hashes(data, offsets[i : j + 1], lower=True)
        shingles, begins = windows(h, firsts, k, short=True)
        out += [sketch_of(np.unique(shingles[a:b])) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    return out


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of the union of two shingle sets."""
    if a.scale == b.scale == 1:
        return sketch_of(np.union1d(a.hashes, b.hashes))
    return Sketch(SCALE, np.union1d(a.at(SCALE), b.at(SCALE)))


def to_text(sketch: Sketch) -> str:
    return f"{sketch.scale}:{base64.b64encode(sketch.hashes.astype('<u8').tobytes()).decode()}" if sketch.scale > 1 or len(sketch.hashes) else ""


def from_text(fingerprint: str) -> Sketch:
    scale, _, hashes = fingerprint.partition(":")
    return Sketch(int(scale or 1), np.frombuffer(base64.b64decode(hashes), "<u8"))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the smaller shingle set that the larger one holds."""
    scale = max(a.scale, b.scale)
    x, y = a.at(scale), b.at(scale)
    if not len(x) or not len(y):
        return float(a.scale == b.scale and np.array_equal(a.hashes, b.hashes))
    return len(np.intersect1d(x, y, assume_unique=True)) / min(len(x), len(y))


@F.arrow_udf(T.StringType())
def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column function: the fingerprint of a text column."""
    for batch in batches:
        yield pa.array([to_text(x) for x in sketches(batch)], pa.string())


@F.arrow_udf(T.DoubleType())
def likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    """Column function: estimated containment of two fingerprints; null where either is null."""
    return pa.array([containment(from_text(x), from_text(y)) if x is not None and y is not None else None for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def with_next(docs: DataFrame, columns: list[str], slices: int) -> DataFrame:
    """Add next_<column>: the values of the next row by descending doc_id (ties: ascending text), after the last those of the first.

    Rows are cut into ranges of ids at approximate quantiles; each range also gets a copy of the first row of the range below
    it, so no global order and no single task is needed. What is broadcast and collected is ``slices`` rows.
    """
    quantiles = docs.select(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)], 10 * slices).alias("q")).first()["q"]
    bounds = sorted(set(quantiles or []))
    shared = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))

    @F.arrow_udf(T.IntegerType())
    def slot_of(ids: pa.Array) -> pa.Array:
        """The number of bounds at or below an id; null ids go last, below all."""
        found = np.searchsorted(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, found).astype(np.int32))

    slot = docs.withColumn("slot", slot_of("doc_id"))
    tops = [(r["slot"], r["top"]) for r in slot.groupBy("slot").agg(F.max("doc_id").alias("top")).collect()]
    tops.sort(reverse=True)
    targets = [(lower[1], upper[0], 1 if i < len(tops) - 1 else 2) for i, (upper, lower) in enumerate(zip(tops, tops[1:] + tops[:1], strict=True))] if tops else []
    guests = docs.sparkSession.createDataFrame(targets, "top long, slot int, guest int")
    copies = docs.join(F.broadcast(guests), docs["doc_id"].eqNullSafe(guests["top"])).drop("top")
    every = slot.withColumn("guest", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("slot").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    ahead = every.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return ahead.where("guest = 0").drop("slot", "guest")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them and the next document's."""
    small_batches(spark)
    docs = texts_of(table(spark, sf_dir, "documents")).withColumn("text", F.coalesce("text", F.lit("")))
    pairs = with_next(docs, ["text"], 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    done = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    done = done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("text").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"), fingerprint("next_text").alias("next_fingerprint"))
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
