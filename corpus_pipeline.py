"""A corpus pipeline of five stages over ``documents``: each takes (spark, docs, sf_dir), keeps what it decides to keep, and is
written and read again before the next.

Language ID drops documents without a letter; the n-gram join keeps the least doc_id of each group; personal data is replaced
in the texts; mixing keeps the documents that are drawn; encoding returns each document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, langid, mixing, ngram_join, pii
from ridgeline.llm.common import column, columns, small_batches, stored, table, texts_of, without_ids


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have, in any case."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with the columns of the documents."""
    return rows.select(*[column(rows, c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without text or letters go. A missing lang is filled in. A null id changes nothing, repeated rows
    are each told, further columns stay whatever their names."""
    model = langid.train(docs, docs["text"], docs["lang"], docs["doc_id"])
    to = unused(docs, "told")
    told = langid.predict(docs, model, to=to).where(F.col(f"{to}.lang_pred") != langid.UNKNOWN)
    return like(told.withColumn("lang", F.coalesce("lang", f"{to}.lang_pred")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near copies; all others. Rows without an id stay; rows that share the id that is kept all stay."""
    found = ngram_join.near_duplicates(texts_of(docs))
    away = found.where("component_id <> doc_id").select("doc_id")
    return without_ids(docs, stored(away, "pipeline-away"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each piece of personal data replaced by its kind; a null text stays null. All rows stay."""
    small_batches(spark)
    clean = docs.withColumn("text", pii.redacted(F.col("text")))
    return like(clean.withColumn("n_chars", F.char_length("text").cast("long")), docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn with calibrated probabilities; rows that share an id, or have none, are drawn alike."""
    to = unused(docs, "mix")
    return like(mixing.mixed(docs, to=to).where(F.col(f"{to}.sampled")), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether their decoding gives the text's bytes; one row for each row."""
    done = bpe.decode(bpe.encode(docs.select(*columns(docs))))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing_weights", mixing_weights),
    ("byte_bpe", byte_bpe),
]

#: Language ID, the join's components and the encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
