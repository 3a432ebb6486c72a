"""Registered queries: a table function that streams runs, loads of rides that arrive late."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, r6
from .plans import storage
from .plans.views import RIDES_SQL, points, rides
from .queries_time import COASTING, SEGMENTS, _runs
from .sources import runs_udtf
from .streaming import late


@query(_runs(COASTING) + SEGMENTS.format(least=3))
def coast_segments_function(spark, sf_dir):
    """The coasting segments by SQL: TABLE(...) PARTITION BY ride ORDER BY sample."""
    runs_udtf.register(spark)
    samples = points(spark, sf_dir).select("ride_id", "idx", "t", F.expr(COASTING).alias("is_on"))
    found = spark.sql("SELECT * FROM runs(3, TABLE(SELECT * FROM {samples}) PARTITION BY ride_id ORDER BY idx)", samples=samples)
    return found.select("ride_id", "island", "n_points", r6("t_start"), r6("t_end"))


@query(f"""WITH r AS (SELECT route_id, ride_id, day, trimp FROM ({RIDES_SQL})), e AS (SELECT a.route_id rider, a.ride_id id, a.day,
sum(b.trimp * exp(-(a.day - b.day) / 42.0E0)) * (1 - exp(-1 / 42.0E0)) ctl, sum(b.trimp * exp(-(a.day - b.day) / 7.0E0)) * (1 - exp(-1 / 7.0E0)) atl
FROM r a JOIN r b ON b.route_id = a.route_id AND (b.day < a.day OR (b.day = a.day AND b.ride_id <= a.ride_id)) GROUP BY ALL)
SELECT rider, id, round(day, 6) AS day, round(ctl, 6) ctl, round(atl, 6) atl FROM e""")
def late_load(spark, sf_dir):
    """Riders' loads from a stream in which every third ride comes a batch, some 400 days, later than its day."""
    r = rides(spark, sf_dir).select(F.col("route_id").cast("long").alias("rider"), F.col("ride_id").cast("long").alias("id"), F.col("day").cast("double").alias("day"), F.col("trimp").cast("double").alias("trimp"))
    out, schema = storage.new_path(spark, "late-load"), r.schema
    r = storage.stored(r.withColumn("batch", F.floor(F.col("day") / 400) + (F.col("id") % 3 == 0).cast("int")), "late-load")
    for (number,) in r.select("batch").distinct().orderBy("batch").toLocalIterator():  # a batch is some 400 days
        r.where(F.col("batch") == number).drop("batch").coalesce(1).write.mode("append").parquet(f"{out}/in")
        _to_the_end(spark, out, schema)
    # a day far ahead of all: the watermark passes the last rides
    r.agg(F.lit(-1).cast("long").alias("rider"), F.lit(-1).cast("long").alias("id"), (F.max("day") + 2000).alias("day"), F.lit(0.0).alias("trimp")).where("day IS NOT NULL").write.mode("append").parquet(f"{out}/in")
    _to_the_end(spark, out, schema)
    found = spark.read.parquet(f"{out}/out")
    return found.where("rider >= 0").select("rider", "id", r6("day"), r6("ctl"), r6("atl"))


def _to_the_end(spark, out: str, schema) -> None:
    loads = late.training_load(spark.readStream.schema(schema).parquet(f"{out}/in"), delay="900 days")
    loads.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
