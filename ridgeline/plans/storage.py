"""Tables that are written once and read back, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests on one machine), a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back, so that its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PARTS = 16


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("part")


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """Store a table in parts by a hash of its key, so that a key's rows can be replaced without the rest."""
    df.select("*", _part(key)).write.partitionBy("part").parquet(path)


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def rewrite_keys(spark: SparkSession, path: str, key: str, new: DataFrame) -> None:
    """Replace all rows of the keys that the new rows have; only the parts that hold those keys are written again."""
    new = stored(new.select("*", _part(key)), "rewrite-new")
    keys, parts = new.select(key).distinct(), new.select("part").distinct()
    old = spark.read.parquet(path)
    kept = old.join(F.broadcast(parts), "part", "left_semi").join(keys, key, "left_anti")  # PARTS rows at most
    both = stored(kept.unionByName(new), "rewrite-parts")
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
