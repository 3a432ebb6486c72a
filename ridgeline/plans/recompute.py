"""Derived tables that are brought up to date by key: what a changed input can't have changed is neither read nor written.

A step derives one table from named inputs and from the tables of earlier steps. For every key and step a stamp is kept, a hash of the content of all inputs that the step
depends on, through other steps too. ``refresh`` compares the stamps with those of today's inputs and runs each step over the keys that differ. Rows are only ever added, as a
batch of ``committed``: all steps' new rows and their stamps appear together, and a key's rows are those of the batch that its stamp names. So a run that fails leaves
the tables as they were, and the next one does it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import committed

STAMPS = "stamps"


@dataclass(frozen=True)
class Step:
    """A derived table. ``run`` gets the tables of ``inputs`` and ``after`` by name, of the keys to compute alone, and returns rows that have the key."""

    name: str
    inputs: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()


def content(rows: DataFrame, key: str | None = None) -> DataFrame:
    """key, hash of all rows of a key whatever their order, repeated rows included; without a key, one row for the whole table. Row hashes are summed as decimals, so no sum overflows."""
    columns = sorted(rows.columns)
    named = [F.col(f"`{c}`") for c in columns]
    absent = F.concat_ws(",", *[F.when(c.isNull(), F.lit(str(i))) for i, c in enumerate(named)])  # a hash skips nulls
    row = rows.select(*([F.col(f"`{key}`").alias(key)] if key else []), F.xxhash64(*named, absent).alias("_h"), F.hash(*named, absent).cast("long").alias("_g"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return row.groupBy(*([f"`{key}`"] if key else [])).agg(F.xxhash64(F.count("*"), total("_h"), total("_g")).alias("_content"))


def _needs(steps: list[Step]) -> dict[str, set[str]]:
    """The inputs that each step depends on, through earlier steps too."""
    needs: dict[str, set[str]] = {}
    for s in steps:
        unknown = [a for a in s.after if a not in needs]
        if unknown or s.name in needs or s.name == STAMPS:
            raise ValueError(f"step {s.name} comes twice or before {unknown}")
        needs[s.name] = set(s.inputs).union(*[needs[a] for a in s.after])
    return needs


def _wanted(steps: list[Step], inputs: dict[str, DataFrame], shared: dict[str, DataFrame], key: str, base: str) -> DataFrame:
    """key, step, stamp of today's inputs for all keys of the base input: one aggregate an input, joined by key."""
    found = content(inputs[base], key).withColumnRenamed("_content", f"_of_{base}")
    for name in inputs:
        if name != base:
            found = found.join(content(inputs[name], key).withColumnRenamed("_content", f"_of_{name}"), key, "left")
    for name in shared:
        found = found.crossJoin(F.broadcast(content(shared[name]).withColumnRenamed("_content", f"_of_{name}")))  # one row
    stamps = [F.struct(F.lit(s).alias("step"), F.xxhash64(*[F.coalesce(F.col(f"_of_{n}"), F.lit(0)) for n in sorted(of)]).alias("stamp")) for s, of in _needs(steps).items()]
    return found.select(key, F.explode(F.array(*stamps)).alias("_s")).select(key, "_s.*")


def _stamp_schema(key: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(key, kind), T.StructField("step", T.StringType()), T.StructField("stamp", T.LongType())])


def stamps(spark: SparkSession, root: str, key: str, kind: T.DataType) -> DataFrame:
    """key, step, stamp, batch: the latest of each key and step; a null stamp says that the key is gone."""
    rows = committed.read(spark, root, STAMPS, _stamp_schema(key, kind))
    last = F.max_by(F.struct("stamp", "batch"), "batch").alias("_l")
    return rows.groupBy(key, "step").agg(last).select(key, "step", "_l.stamp", "_l.batch")


def table(spark: SparkSession, root: str, step: str, schema: T.StructType, key: str = "ride_id") -> DataFrame:
    """A step's rows as they stand, with the batch that each was computed in."""
    now = stamps(spark, root, key, schema[key].dataType).where((F.col("step") == step) & F.col("stamp").isNotNull()).select(key, "batch")
    names = [F.col(f"`{c}`") for c in schema.names]
    return committed.read(spark, root, step, schema).join(now, [key, "batch"], "left_semi").select(*names, "batch")


def _of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids, key, "left_semi")


def refresh(spark: SparkSession, root: str, steps: list[Step], inputs: dict[str, DataFrame], shared: dict[str, DataFrame] | None = None, key: str = "ride_id", base: str | None = None) -> int | None:
    """Bring all steps up to date; the batch that was written, or None where nothing had changed.

    inputs: tables that have the key; a key exists while the base input (the first) has a row of it. shared: tables without a key that every key's result depends on, such as a
    profile; each has one content, so any change of it concerns all keys. A null key is no key. A key that is gone gets an empty stamp, so its rows are not seen any more.
    One writer at a time: two that run together would take the same batch number."""
    shared, base = shared or {}, base or next(iter(inputs))
    inputs = {n: d.where(F.col(f"`{key}`").isNotNull()) for n, d in inputs.items()}
    kind = inputs[base].schema[key].dataType
    now = stamps(spark, root, key, kind).select(key, "step", F.col("stamp").alias("_old"))
    both = _wanted(steps, inputs, shared, key, base).join(now, [key, "step"], "full_outer")
    known: Column = F.col("step").isin([s.name for s in steps])
    changed = both.where(known & ~F.col("stamp").eqNullSafe(F.col("_old"))).select(key, "step", "stamp")
    batch = (committed.commits(spark, root).agg(F.max("batch")).first()[0] or 0) + 1
    committed.stage(root, batch, STAMPS, changed)  # written once: every step below reads the same keys
    changed = spark.read.schema(_stamp_schema(key, kind)).parquet(f"{root}/{STAMPS}/batch={batch}")
    if changed.isEmpty():
        return None
    new: dict[str, DataFrame] = {}
    for s in steps:
        ids = changed.where((F.col("step") == s.name) & F.col("stamp").isNotNull()).select(key)
        given = {n: _of(inputs[n], ids, key) if n in inputs else shared[n] for n in s.inputs}
        for a in s.after:
            fresh = changed.where(F.col("step") == a).select(key)
            kept = table(spark, root, a, new[a].schema, key).drop("batch").join(fresh, key, "left_anti")
            given[a] = _of(kept.unionByName(new[a]), ids, key)
        rows = s.run(given)
        committed.stage(root, batch, s.name, rows)
        new[s.name] = spark.read.schema(rows.schema).parquet(f"{root}/{s.name}/batch={batch}")
    committed.commit(spark, root, batch, [*new, STAMPS])
    return batch


def touched(spark: SparkSession, root: str, key: str = "ride_id", kind: T.DataType | None = None) -> DataFrame:
    """batch, step, n_keys, n_gone: how many keys each refresh computed or dropped."""
    rows = committed.read(spark, root, STAMPS, _stamp_schema(key, kind or T.LongType()))
    return rows.groupBy("batch", "step").agg(F.count("stamp").alias("n_keys"), F.count_if(F.col("stamp").isNull()).alias("n_gone"))
