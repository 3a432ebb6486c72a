"""Recurrences along a key's ordered events: closed forms over blocks of time, and grouped Arrow functions where there is none."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import C

BLOCK_DAYS = 100.0


def training_load(events: DataFrame, key: str, day: str, id: str, load: str, slow: float = C.ctl_days, fast: float = C.atl_days) -> DataFrame:
    """Long and short exponentially weighted load after every event and their difference before it: key, id, ctl, atl, tsb.

    A key's days are cut into blocks of ``BLOCK_DAYS``. Within a block a load is the running sum of loads scaled to the block's start; what earlier
    blocks leave is a sum over their totals, of which a key has as many as its years have blocks. So no task needs a key's whole history."""
    start = F.floor(F.col(day) / BLOCK_DAYS)
    rows = events.select(key, id, F.col(day).cast("double").alias("_d"), F.coalesce(F.col(load).cast("double"), F.lit(0.0)).alias("_x"), start.alias("_b"))
    since = F.col("_d") - F.col("_b") * BLOCK_DAYS
    names = (("ctl", slow), ("atl", fast))
    rows = rows.select("*", *[(F.col("_x") * F.exp(since / tau)).alias(f"_{n}") for n, tau in names])
    totals = rows.groupBy(key, "_b").agg(*[F.sum(f"_{n}").alias(n) for n, _ in names])
    lines = totals.groupBy(key).agg(F.collect_list(F.struct("_b", "ctl", "atl")).alias("_all"))

    def left(n: str, tau: float):
        own = F.col("_block._b")
        return F.aggregate(F.filter("_all", lambda x: x["_b"] < own), F.lit(0.0), lambda acc, x: acc + x[n] * F.exp(-(own - x["_b"]) * BLOCK_DAYS / tau)).alias(f"_before_{n}")

    carried = lines.select(key, "_all", F.explode("_all").alias("_block")).select(key, F.col("_block._b").alias("_b"), *[left(n, tau) for n, tau in names])
    w = Window.partitionBy(key, "_b").orderBy("_d", id).rowsBetween(Window.unboundedPreceding, 0)
    share = {n: 1 - math.exp(-1 / tau) for n, tau in names}
    run = rows.join(carried, [key, "_b"]).select(key, id, "_x", *[(share[n] * F.exp(-since / tau) * (F.sum(f"_{n}").over(w) + F.col(f"_before_{n}"))).alias(n) for n, tau in names])
    before = [F.col(n) - F.col("_x") * share[n] for n, _ in names]
    return run.select(key, id, "ctl", "atl", (before[0] - before[1]).alias("tsb"))


def limited_jumps(df: DataFrame, key: str, order: str, value: str, jump: float = 20.0, to: str = "steady") -> DataFrame:
    """Five-row median, then no step over ``jump`` from the value before (as already limited), then five-row mean. Keys are single rides."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-2, 2)
    rows = df.withColumn("_m", F.percentile(value, F.lit(0.5)).over(w)).withColumn("_v", F.lit(None).cast("double"))

    def limit(ride: pa.Table) -> pa.Table:
        ride = ride.take(pc.sort_indices(ride, [(order, "ascending")]))
        held, last = ride.column("_m").to_pylist(), None
        for k, m in enumerate(held):
            if m is not None:
                last = held[k] = m if last is None else min(max(m, last - jump), last + jump)
        return ride.set_column(ride.column_names.index("_v"), "_v", pa.array(held, pa.float64()))

    return rows.groupBy(key).applyInArrow(limit, rows.schema).withColumn(to, F.avg("_v").over(w)).drop("_v", "_m")


def best_of_windows(windows: DataFrame, key: str, order: str, drift: str, points: str, band: float = 0.5) -> DataFrame:
    """Along each key's windows: the strongest drift; within a band of strength the one with more points."""
    line = windows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(drift).alias("d"), F.col(points).alias("n")))).alias("h"))

    def better(s, e):
        clear = F.abs(e["d"]) > F.abs(s["d"]) + band
        close = (F.abs(F.abs(e["d"]) - F.abs(s["d"])) <= band) & (e["n"] > s["n"])
        return F.when(s["d"].isNull() | clear | close, e).otherwise(s)

    none = F.struct(F.lit(None).cast(windows.schema[order].dataType).alias("o"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("long").alias("n"))
    return line.select(key, F.aggregate("h", none, better).alias("b")).select(key, F.col("b.o").alias(order), F.col("b.d").alias(drift), F.col("b.n").alias(points))
