"""Operator 1: byte-level BPE encoding and decoding with a local rank file.

The rank file's bytes are read on the driver and broadcast (a vocabulary, under ``MAX_RANK_BYTES``); each Python worker builds
one tiktoken encoding from them. Texts over ``LONG`` characters are split first where no match of the pattern can
span: before a blank or line end that follows a letter or digit, else between a letter and a digit. Runs of over ``LONG``
white-space characters, in which the regular-expression engine gives up, are found by a linear scan: under ``public_tokenizers.PATTERN`` such a
run, without its last character unless the text ends there, is one match, which is merged by itself.

Defined results: null text counts as empty and gives an empty array; empty text gives an empty array; repeated rows are
encoded each; no rows give no rows; columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, give_back, small_batches, table, texts_of

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = 50_000
MAX_RANK_BYTES = 64 << 20
_CUT = re.compile(r"(?<=[^\W_])[ \n]|(?<=[^\W\d_])(?=[0-9])")


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def safe_pieces(text: str, limit: int = LONG) -> Iterator[str]:
    """Parts of a text whose encodings, one after another, are the encoding of the whole."""
    at = 0
    while len(text) - at > limit:
        cut = _CUT.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def long_blanks(text: str) -> Iterator[tuple[int, int]]:
    """The one match that each run of over ``LONG`` white-space characters begins with."""
    at = 0
    while at + LONG < len(text):  # a run of that length covers one of these places
        if not text[at + LONG].isspace():
            at += LONG + 1
            continue
        start = end = at + LONG
        while start > at and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        if end - start > LONG:
            yield start, end if end == len(text) else end - 1
        at = end


def encoded(enc: tiktoken.Encoding, text: str, pattern: str) -> Iterator[np.ndarray]:
    """The ids of a whole text, in parts."""
    at = 0
    for start, end in long_blanks(text) if len(text) > LONG and pattern == public_tokenizers.PATTERN else ():
        yield from (np.asarray(enc.encode_ordinary(p), np.int32) for p in safe_pieces(text[at:start]))
        yield np.asarray(enc._encode_single_piece(text[start:end]), np.int32)
        at = end
    yield from (np.asarray(enc.encode_ordinary(p), np.int32) for p in safe_pieces(text[at:]))


def _ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        ranks = f.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"{path}: over {MAX_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, text: str = "text", to: str = "token_ids", rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add the ids of each whole text as array<int>."""
    small_batches(docs.sparkSession)
    ranks = _ranks(docs.sparkSession, rank_file)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            parts, ends = [], [0]
            for value in batch:
                own = list(encoded(enc, value.as_py() or "", pattern))
                parts += own
                ends.append(ends[-1] + sum(map(len, own)))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
        give_back()

    return docs.withColumn(to, ids(docs[text].cast("string")))


def decode(docs: DataFrame, ids: str = "token_ids", to: str = "decoded", rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add the raw bytes that the ids stand for; they need not be valid UTF-8 (ids may end within a character). Null ids give null."""
    small_batches(docs.sparkSession)
    ranks = _ranks(docs.sparkSession, rank_file)

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            yield pa.array([enc.decode_bytes(x.values.to_pylist()) if x.is_valid else None for x in batch], pa.binary())
        give_back()

    return docs.withColumn(to, raw(docs[ids]))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes decoded from them."""
    done = decode(encode(texts_of(table(spark, sf_dir, "documents"))))
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
