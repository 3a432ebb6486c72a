"""Top-k, sampling, decimation, deduplication and other choices of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_in(df: DataFrame, key: str | list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def stride(df: DataFrame, key: str, index: str, n: int) -> DataFrame:
    """Every (rows // n)-th row of a key, from the first."""
    step = F.greatest(F.floor(F.count("*").over(Window.partitionBy(key)) / n), F.lit(1))
    return df.withColumn("_step", step).where(F.col(index) % F.col("_step") == 0).drop("_step")


def decimate(df: DataFrame, key: str, axis: str, value: str, buckets: int) -> DataFrame:
    """For charts: each bucket's least and greatest row, and each key's first and last."""
    ends = df.groupBy(key).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    at = F.least(F.floor((F.col(axis) - F.col("_lo")) / F.when(width > 0, width) * buckets), F.lit(buckets - 1))
    rows = df.join(ends, key).withColumn("_b", F.coalesce(at, F.lit(0)))
    point = F.struct(axis, value)
    cells = rows.groupBy(key, "_b").agg(F.array(F.min_by(point, F.struct(value, axis)), F.max_by(point, F.struct(value, (-F.col(axis)).alias("_m")))).alias("p"))
    edges = df.groupBy(key).agg(F.array(F.min_by(point, axis), F.max_by(point, axis)).alias("p"))
    return cells.select(key, "p").unionByName(edges).select(key, F.explode("p").alias("p")).select(key, "p.*").distinct()


def retained(df: DataFrame, age: Column, protected: Column, keep: int) -> DataFrame:
    """All protected rows and the newest of the others, ``keep`` in all (protected ones count first).

    The newest come from a bounded top-k, so the whole table never meets in one task."""
    safe = df.where(protected)
    room = max(0, keep - safe.limit(keep).count())
    return safe.unionByName(df.where(~protected).orderBy(age.desc()).limit(room))


def by_content(df: DataFrame, content: str, id: str) -> DataFrame:
    """The first id of every distinct content, by SHA-256."""
    return df.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("file_hash")).agg(F.min(id).alias(id), F.count("*").alias("copies"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of tables with different columns under the union of their columns, absent ones null, names after the first two in order."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    lead = [c for c in ("message_type", "timestamp") if c in whole.columns]
    return whole.select(*lead, *sorted(c for c in whole.columns if c not in lead))


def without_cascade(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of deleted keys."""
    return {n: t.join(gone.select(key), key, "left_anti") for n, t in tables.items()}


def upserted(old: DataFrame, new: DataFrame, key: str | list[str], version: str) -> DataFrame:
    """The newest row of each key of both tables."""
    return first_in(old.unionByName(new), key, F.col(version).desc())


def unpivoted(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each key and column: key, metric, value."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_x")).select(key, "_x.*")


def merged_axis(*series: DataFrame) -> DataFrame:
    """The distinct x values of several series."""
    every = series[0].select("x")
    for one in series[1:]:
        every = every.unionByName(one.select("x"))
    return every.distinct()


def younger_than(rows: DataFrame, time: str, now: DataFrame, age: float) -> DataFrame:
    """Rows no older than an age; now: one row with that column."""
    return rows.crossJoin(F.broadcast(now)).where(F.col(time) >= F.col("now") - age).drop("now")


def importable(records: Column, size: Column, least: int = 20, most: int = 200_000, most_bytes: int = 64 << 20) -> Column:
    """May a file be imported: enough records, not too many, not too large."""
    return F.coalesce(records.between(least, most) & (size <= most_bytes), F.lit(False))


def stride_within(df: DataFrame, key: str, order: str, n: int, low: int = 240, high: int = 5000) -> DataFrame:
    """Every k-th row of a key's series, so that about n rows are left; n is held between two bounds."""
    w = Window.partitionBy(key)
    step = F.greatest(F.floor(F.count("*").over(w) / min(max(n, low), high)), F.lit(1))
    return df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_step", step).where(F.col("_i") % F.col("_step") == 0).drop("_i", "_step")
