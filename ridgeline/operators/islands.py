"""Runs of samples that share a condition: numbering, merging and measuring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import ordered


def islands(df: DataFrame, key: str, order: str, on: Column, to: str = "island") -> DataFrame:
    """Only the rows where a condition holds, numbered from 1 by uninterrupted run."""
    w = ordered(key, order)
    frame = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    start = (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("long")
    return frame.withColumn("_new", start).withColumn(to, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on").drop("_on", "_new")


def segments(df: DataFrame, key: str, order: str, time: str, on: Column, least: int, **more: Column) -> DataFrame:
    """key, island, n_points, t_start, t_end and further aggregates, for runs of at least so many rows."""
    found = islands(df, key, order, on).groupBy(key, "island")
    return found.agg(F.count("*").alias("n_points"), F.min(time).alias("t_start"), F.max(time).alias("t_end"), *[c.alias(n) for n, c in more.items()]).where(F.col("n_points") >= least)


def merge_near(runs: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """Runs that are at most a gap apart become one: key, block, t_start, t_end, n_islands, n_points."""
    w = ordered(key, start)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    frame = runs.withColumn("_new", (F.coalesce(F.col(start) - reach > gap, F.lit(True))).cast("long"))
    frame = frame.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return frame.groupBy(key, "block").agg(F.min(start).alias("t_start"), F.max(end).alias("t_end"), F.count("*").alias("n_islands"), F.sum("n_points").alias("n_points"))


def segment_integrals(df: DataFrame, key: str, order: str, time: str, on: Column, elev: str, dist: str, speed: str, least: int = 10) -> DataFrame:
    """For each run: rise, length and the integral of speed cubed over time."""
    found = islands(df, key, order, on)
    w = Window.partitionBy(key, "island").orderBy(order)
    dt = F.lead(time).over(w) - F.col(time)
    found = found.withColumn("_v3", F.coalesce(F.pow(speed, F.lit(3.0)) * dt, F.lit(0.0)))
    return found.groupBy(key, "island").agg(F.count("*").alias("n_points"), (F.max_by(elev, order) - F.min_by(elev, order)).alias("rise"), (F.max_by(dist, order) - F.min_by(dist, order)).alias("length"), F.sum("_v3").alias("v3")).where(F.col("n_points") >= least)


def vam(df: DataFrame, key: str, order: str, time: str, grade: str, elev: str, climb: float) -> DataFrame:
    """Median climbing speed (m/h) over runs steeper than a grade that rise over 1 m in over 5 s."""
    runs = islands(df, key, order, F.col(grade) > climb).groupBy(key, "island").agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("dt"), (F.max_by(elev, order) - F.min_by(elev, order)).alias("dz"))
    rate = F.col("dz") / F.when(F.col("dt") > 0, F.col("dt")) * 3600
    return runs.where("n >= 2 AND dt > 5 AND dz > 1").groupBy(key).agg(F.percentile(rate, F.lit(0.5)).alias("vam_mh"))
