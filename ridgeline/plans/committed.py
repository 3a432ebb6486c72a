"""Several tables that change together: a batch of rows is in all of them or in none.

Each table's rows of a batch go to its own folder ``<root>/<table>/batch=<n>``; only when all are written does one row, the marker, appear under ``<root>/commits``. Readers
take the rows of batches that have a marker, by a join with the few markers that Spark prunes folders with. So a batch that fails between two tables leaves
nothing that a reader sees, and is simply written again; a batch that has its marker is not written twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "batch long, tables array<string>"
#: The tables of a ride and their columns.
RIDE_TABLES = {
    "ride": "ride_id long, file_hash string, started_at double, ended_at double, distance_m double, duration_s double, avg_hr double, avg_watts double, gain_m double, has_hr boolean, n_points long",
    "gps_point": "ride_id long, t double, lat double, lon double, elev_raw double, elev double, grade double, speed double, dist double, idx int",
    "hr_point": "ride_id long, t double, hr double",
    "power_point": "ride_id long, t double, watts_lo double, watts_est double, watts_hi double, confidence string, mode string",
    "weather": "ride_id long, temp double, wind_speed double, wind_dir double, pressure double, source string",
}


def rows_at(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The table, or no rows while nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The markers: batch, tables."""
    return rows_at(spark, f"{root}/commits", COMMITS)


def is_committed(spark: SparkSession, root: str, batch: int) -> bool:
    return not commits(spark, root).where(F.col("batch") == batch).isEmpty()


def stage(root: str, batch: int, name: str, rows: DataFrame) -> None:
    """Write a batch's rows of one table, in place of what an earlier try left."""
    rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def commit(spark: SparkSession, root: str, batch: int, names: list[str]) -> None:
    """Write the marker: from now on readers see the batch's staged rows of these tables."""
    spark.createDataFrame([(batch, sorted(names))], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def insert(spark: SparkSession, root: str, batch: int, tables: dict[str, DataFrame]) -> bool:
    """Stage all tables of a batch, then commit it; False if it was committed before, and nothing is done."""
    if is_committed(spark, root, batch):
        return False
    for name, rows in tables.items():
        stage(root, batch, name, rows)
    commit(spark, root, batch, list(tables))
    return True


def read(spark: SparkSession, root: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The committed rows of a table, with their batch."""
    schema = RIDE_TABLES[name] if schema is None else schema
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = rows_at(spark, f"{root}/{name}", T.StructType([*fields.fields, T.StructField("batch", T.LongType())]))
    return rows.join(commits(spark, root).where(F.array_contains("tables", name)).select("batch"), "batch", "left_semi")


def _typed(rows: DataFrame, name: str) -> DataFrame:
    fields = T.StructType.fromDDL(RIDE_TABLES[name])
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def ride_tables(samples: DataFrame, weather: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five tables of rides from their processed samples (ride_id, file_hash, idx, t, lat, lon, elev, elev_smooth, along, grade, speed, dist, hr,
    watts_lo, watts_est, watts_hi, confidence, mode); weather: ride_id, temp, wind_speed, wind_dir, pressure, source (none: nulls)."""
    rise = F.greatest(F.col("elev_smooth") - F.lag("elev_smooth").over(Window.partitionBy("ride_id").orderBy("idx")), F.lit(0.0))
    totals = samples.withColumn("_rise", rise).groupBy("ride_id").agg(
        F.min("file_hash").alias("file_hash"), F.min("t").alias("started_at"), F.max("t").alias("ended_at"), (F.max("along") - F.min("along")).alias("distance_m"), (F.max("t") - F.min("t")).alias("duration_s"),
        F.avg("hr").alias("avg_hr"), F.avg(F.when(F.col("mode") == "pedal", F.col("watts_est"))).alias("avg_watts"), F.coalesce(F.sum("_rise"), F.lit(0.0)).alias("gain_m"), (F.count("hr") > 0).alias("has_hr"), F.count("*").alias("n_points"),
    )
    ids = totals.select("ride_id")
    known = ids.join(weather, "ride_id", "left") if weather is not None else ids.select("*", *[F.lit(None).alias(c) for c in ("temp", "wind_speed", "wind_dir", "pressure", "source")])
    return {
        "ride": _typed(totals, "ride"),
        "gps_point": _typed(samples.withColumns({"elev_raw": F.col("elev"), "elev": F.col("elev_smooth")}), "gps_point"),
        "hr_point": _typed(samples.where("hr IS NOT NULL"), "hr_point"),
        "power_point": _typed(samples, "power_point"),
        "weather": _typed(known, "weather"),
    }

