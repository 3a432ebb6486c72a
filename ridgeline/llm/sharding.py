"""Operator 12: shards that all have the corpus' mixture, by proportional stratified interleaving; DataFrame functions alone.

Within each source (the strata) rows are ranked in a seeded shuffle (the order of a hash). A row's fraction is (rank + u) / rows of its source, with u
in [0, 1) by a hash of the source, so that small sources don't all fall on one place. All rows are sorted by fraction, and the order is cut into
shards of floor or ceiling of rows / shards: the law ``rows``, and each source has its share in each shard to within a few rows.

No source and no order meets in one task. A rank is counted in two steps: rows in ranges of the shuffled order (about the square root of all rows many),
and a row's place within its range. Only counts of ranges are summed in order. The places in the order of fractions are counted the same way. So
a window holds about sqrt(rows) rows and the table of ranges has as many for each source; a source with a third of all rows is split over all its ranges.

Defined results: null text has size 8 and the checksum of no bytes; null sources are the source ``''``; rows that share an id are dealt one by one, exact copies too (equal
texts are no unit of this law); a null id is dealt like any other; fewer rows than shards leave shards empty; no rows give no rows; columns of the documents stay,
but for one of the name of the new column, whatever its case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, shared_folder, stored, table

SHARDS = 24
SEED = "shard-1"
HEX = 12  # digits of a hash that order the shuffle: 48 bits


def _fraction(name: Column) -> Column:
    """A number in [0, 1) by the first 48 bits of a hash."""
    return F.conv(F.substring(F.md5(name), 1, HEX), 16, 10).cast("double") / F.lit(float(1 << 4 * HEX))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _ordered(rows: DataFrame, share: str, ranges: int, order: list[str], within: list[str]) -> DataFrame:
    """The rows with _place, from 0, in the order of (share, order) among those that agree in ``within``; _all: how many these are. share: in [0, 1)."""
    cut = rows.withColumn("_range", F.floor(F.col(share) * ranges))
    counts = cut.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*within)))
    own = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(share, *order)) - 1
    return cut.withColumn("_own", own).join(sums.drop("_n"), [*within, "_range"]).withColumn("_place", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def sharded(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, to: str = "placed", carry: list[str] | None = None) -> DataFrame:
    """The documents with one more column: struct<size, text_crc32, law, shard, slot, grown_shard>; slots are the places within a shard.

    carry: the columns that go along through the exchanges (default: all); without the text these are some hundred bytes a row."""
    total = docs.count()
    ranges = max(1, math.isqrt(total))
    words, src = _text(column(docs, text)), _text(column(docs, source))
    kept = F.struct(*[column(docs, c) for c in (docs.columns if carry is None else carry) if c.lower() != to.lower()]).alias("row")
    rows = docs.select(
        kept, src.alias("_source"), _fraction(F.concat(F.lit(f"{seed}:"), _text(column(docs, doc_id)))).alias("_shuffled"), _fraction(F.concat(F.lit(f"{seed}/"), src)).alias("_phase"), _text(column(docs, doc_id)).alias("_id"), F.md5(words).alias("_text"),
        (F.octet_length(words).cast("long") + 8).alias("_size"), F.crc32(words).alias("_crc"),
    )
    ranked = _ordered(rows, "_shuffled", ranges, ["_id", "_text"], ["_source"])
    dealt = stored(ranked.withColumn("_fraction", (F.col("_place") + F.col("_phase")) / F.col("_all")).drop("_all", "_place"), "shard-ranks")
    placed = _ordered(dealt.withColumn("_one", F.lit(0)), "_fraction", ranges, ["_source", "_shuffled", "_id", "_text"], ["_one"])
    shard = F.expr(f"(_place * {shards}L) div {max(1, total)}L")
    start = F.expr(f"((_place * {shards}L) div {max(1, total)}L * {total}L + {shards - 1}L) div {shards}L")
    out = F.struct(F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("_place") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    fields = [f.name for f in placed.schema["row"].dataType.fields]
    return placed.select(*[F.col("row").getField(c).alias(c) for c in fields], out.alias(to))


def written(placed: DataFrame, path: str | None = None, to: str = "placed", tasks_a_shard: int = 1) -> str:
    """Write a folder of Parquet files a shard, rows in the order of their slots, and return its path. Each shard is written by so many tasks, each with a run of slots."""
    path = path or f"{shared_folder(placed.sparkSession)}/shards"
    flat = placed.select("*", F.col(f"{to}.shard").alias("shard"))
    flat.repartitionByRange(SHARDS * tasks_a_shard, "shard", f"{to}.slot").sortWithinPartitions("shard", f"{to}.slot").write.partitionBy("shard").parquet(path)
    return path


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sharded(docs, carry=["doc_id"]).select("doc_id", "placed.*")


OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') src, coalesce("text", '') txt FROM documents),
bytes AS (SELECT *, list_transform(regexp_extract_all(hex(txt), '..'), lambda x: CAST('0x' || x AS BIGINT)) b FROM d),
k AS (SELECT doc_id, src, strlen(txt) + 8 size, md5(txt) tie,
  xor(list_reduce(list_prepend(4294967295, b), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) text_crc32,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HEX}) AS BIGINT) / {float(1 << 4 * HEX)!r} h, CAST('0x' || substr(md5('{SEED}/' || src), 1, {HEX}) AS BIGINT) / {float(1 << 4 * HEX)!r} u FROM bytes),
r AS (SELECT *, ((row_number() OVER (PARTITION BY src ORDER BY h, CAST(doc_id AS VARCHAR), tie) - 1) + u) / count(*) OVER (PARTITION BY src) f FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY f, src, h, CAST(doc_id AS VARCHAR), tie) - 1 place, count(*) OVER () n FROM r),
s AS (SELECT *, place * {SHARDS} // n shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) text_crc32, 'rows' law, CAST(shard AS INTEGER) shard, place - (shard * n + {SHARDS - 1}) // {SHARDS} slot, CAST(NULL AS INTEGER) grown_shard FROM s
"""
