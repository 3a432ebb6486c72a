"""Registered queries: fits, routes, files, streams and the whole ride pipeline. Those without SQL have brute-force tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, r6
from .functions.physio import power_band
from .operators import fits, islands, routes
from .plans import ride_pipeline, storage
from .plans.views import points
from .queries_time import P
from .sources import activity
from .streaming import imports


@query(P + """, f AS (SELECT *, atan(least(greatest(grade, -1.0E0), 1.0E0)) a, speed + 1 along, sqrt((speed + 1) * (speed + 1) + 0.25E0) air FROM p),
w AS (SELECT *, 0.005E0 * 86 * 9.80665E0 * cos(a) * speed roll, 0.5E0 * 1.225E0 * 0.35E0 * air * along * speed aero, 86.0E0 * 9.80665E0 * sin(a) * speed grav FROM f),
v AS (SELECT *, CASE WHEN roll + aero + grav > 0 THEN (roll + aero + grav) / 0.97E0 ELSE roll + aero + grav END w2,
sqrt(pow(0.5E0 * 1.225E0 * 0.35E0 * speed * (along * along / air + air) * 2.0E0, 2) + pow(aero * 0.2E0, 2) + pow(roll * 0.25E0, 2) + pow(86 * 9.80665E0 * pow(cos(a), 3) * speed * 0.005E0, 2) + pow((roll + grav) / 86 * 1.5E0, 2) + pow(aero / 1.225E0 * 0.015E0, 2)) / 0.97E0 s FROM w)
SELECT ride_id, idx, round(greatest(w2 - 2 * s, 0.0E0), 6) lo, round(greatest(w2 + 2 * s, 0.0E0), 6) hi FROM v""")
def power_bands(spark, sf_dir):
    band = power_band("speed", 0.0, "grade", 1.225, 86.0, headwind=1.0, crosswind=0.5)
    return points(spark, sf_dir).select("ride_id", "idx", r6(band["lo"], "lo"), r6(band["hi"], "hi"))


@query()
def watts_at_hr_irls(spark, sf_dir):
    return fits.watts_at_hr(points(spark, sf_dir)).select("ride_id", "hr", F.round("watts", 4).alias("watts"), F.round("r2", 6).alias("r2"), "n")


def _steps(spark, sf_dir):
    """Coasting steps of the ride view; each segment has its own heading."""
    runs = islands.islands(points(spark, sf_dir), "ride_id", "idx", F.expr("grade < -0.01 AND speed > 2"))
    w = Window.partitionBy("ride_id", "island").orderBy("idx")
    ahead = lambda c: F.lead(c).over(w)
    steps = runs.select(
        "ride_id", F.col("island").alias("segment"), (ahead("t") - F.col("t")).alias("dt"), ((F.col("speed") + ahead("speed")) / 2).alias("v"),
        (F.col("island") * 2.4).cast("double").alias("heading"), (ahead("speed") * ahead("speed") - F.col("speed") * F.col("speed")).alias("dv2"), (-0.04 * (ahead("dist") - F.col("dist"))).alias("rise"),
    )
    return steps.where("dt IS NOT NULL")


@query()
def loop_fit(spark, sf_dir):
    return fits.loop_calibration(_steps(spark, sf_dir)).select("ride_id", F.round("crr", 4).alias("crr"), F.round("cda", 3).alias("cda"), "n_segments")


@query()
def pooled_fit(spark, sf_dir):
    found = fits.pooled_calibration(storage.stored(_steps(spark, sf_dir), "fit-steps"))
    rows = [(round(found["crr"], 4), round(found["cda"], 3), int(found["n_segments"]))] if found else []
    return spark.createDataFrame(rows, "crr double, cda double, n_segments bigint")


def _known_steps(spark, sf_dir):
    """Coasting steps of rides whose constants and winds are known: every ride of the view, its segments of twelve samples in different directions, with
    the descent that the energy balance asks for."""
    w = Window.partitionBy("ride_id").orderBy("idx")
    p = points(spark, sf_dir).select("ride_id", "idx", F.floor(F.col("idx") / 12).alias("segment"), (9.0 + 3.0 * F.sin(F.col("idx") / 3.0 + F.col("ride_id"))).alias("a"))
    p = p.withColumn("b", F.lead("a").over(w)).withColumn("same", F.lead("segment").over(w) == F.col("segment")).where("same")
    heading, v, dv2 = F.col("segment") * 2.4, (F.col("a") + F.col("b")) / 2, F.col("b") * F.col("b") - F.col("a") * F.col("a")
    wind, to = 1.0 + F.col("ride_id") % 4, F.radians(F.lit(10.0) + (F.col("ride_id") * 37) % 340)
    along, across = v + wind * F.cos(heading - to), wind * F.sin(to - heading)
    lost = _CRR * 86.0 * 9.80665 * v + _CDA * 0.5 * 1.225 * F.sqrt(along * along + across * across) * along * v
    return p.select("ride_id", "segment", F.lit(1.0).alias("dt"), v.alias("v"), heading.cast("double").alias("heading"), dv2.alias("dv2"), (-(0.5 * 86.0 * dv2 + lost) / (86.0 * 9.80665)).alias("rise"))


def _enough(steps):
    """The steps of rides of five segments or more."""
    many = steps.groupBy("ride_id").agg(F.count_distinct("segment").alias("n")).where("n >= 5")
    return steps.join(many.select("ride_id"), "ride_id", "left_semi")


_CRR, _CDA = 0.005, 0.32
_KNOWN = P + ", s AS (SELECT ride_id FROM (SELECT ride_id, idx // 12 g, count(*) n FROM p GROUP BY ALL HAVING count(*) > 1) GROUP BY ride_id HAVING count(*) >= 5) SELECT ride_id, 0.005E0 crr, 0.32E0 cda, CAST(1 + ride_id % 4 AS DOUBLE) wind, CAST(10 + (ride_id * 37) % 340 AS DOUBLE) wind_dir"


@query(_KNOWN + ", true recovered FROM s")
def loop_fit_known(spark, sf_dir):
    """Rides of five segments or more: four unknowns are found again."""
    found = fits.loop_or_plain(_enough(storage.stored(_known_steps(spark, sf_dir), "fit-steps"))).where("n_segments >= 5")
    return found.select("ride_id", F.round("crr", 4).alias("crr"), F.round("cda", 2).alias("cda"), F.round("wind", 1).alias("wind"), F.round("wind_dir", 0).alias("wind_dir"), "recovered")


@query(_KNOWN + ", true AS ok FROM s")
def pooled_fit_known(spark, sf_dir):
    """One row for each ride of the pool, with the shared constants and its own wind."""
    found, winds = fits.pooled_fits(_enough(storage.stored(_known_steps(spark, sf_dir), "fit-steps")))
    constants = [F.lit(found.get(k)).cast("double") for k in ("crr", "cda")]
    fine = F.lit(bool(found) and found["n_rides"] >= 2 and found["r2"] > 0.6 and found["crr_sigma"] < 1e-4)
    return winds.select("ride_id", F.round(constants[0], 4).alias("crr"), F.round(constants[1], 2).alias("cda"), F.round("wind", 1).alias("wind"), F.round((F.degrees("dir") + 360) % 360, 0).alias("wind_dir"), fine.alias("ok"))


@query()
def fit_classifier(spark, sf_dir):
    rows = points(spark, sf_dir).where("hr IS NOT NULL").select((F.col("hr") / 180 - 0.7).alias("a"), (F.col("watts") / 1000).alias("b"), (F.col("mode") == "coast").cast("int").alias("y"))
    weights = fits.fit_classifier(storage.stored(rows, "fit-examples"), ["a", "b"], "y", (1.0, -1.0, 0.0))
    return spark.createDataFrame([(i, round(w, 6)) for i, w in enumerate(weights)], "place int, weight double")


@query()
def route_clusters(spark, sf_dir):
    p = points(spark, sf_dir)
    prints = storage.stored(routes.fingerprints(p), "route-prints")
    edges = storage.stored(routes.similarities(prints), "route-edges")
    return routes.grouped(p.groupBy("ride_id").agg(F.min("t").alias("started_at")), edges)


_DEGREES = "round(round_even({c} * 2147483648.0E0 / 180.0E0, 0) * 180.0E0 / 2147483648.0E0, 6) {c}"


@query(P + "SELECT ride_id, round_even(t, 0) + 631065600 t, hr, round(round_even((elev + 500) * 5, 0) / 5.0E0 - 500, 6) alt_raw, round(round_even(speed * 1000, 0) / 1000.0E0, 6) speed, " + _DEGREES.format(c="lat") + ", " + _DEGREES.format(c="lon") + " FROM p")
def binary_roundtrip(spark, sf_dir):
    files = activity.encoded(points(spark, sf_dir)).withColumn("path", F.col("ride_id").cast("string"))
    return activity.decode(files).select(F.col("path").cast("long").alias("ride_id"), "t", F.col("hr").cast("double").alias("hr"), r6("alt_raw"), r6("speed"), r6("lat"), r6("lon"))


@query(P + """, s AS (SELECT *, CASE WHEN speed >= 0.3 THEN t - lag(t) OVER (PARTITION BY ride_id ORDER BY t) END step FROM p)
SELECT ride_id, round_even(min(t), 0) + 631065600 start_t, round_even(max(t), 0) + 631065600 end_t, round(round_even(coalesce(sum(step), 0) * 1000, 0) / 1000.0E0, 6) duration_s, CAST(count(*) AS INTEGER) point_count, 2 sport,
round(round_even((max(t) - min(t)) * 1000, 0) / 1000.0E0, 6) total_elapsed, round(round_even(max_by(dist, t) * 100, 0) / 100.0E0, 6) total_distance, round_even(max(hr), 0) max_hr FROM s GROUP BY ride_id""")
def binary_metadata(spark, sf_dir):
    files = activity.encoded(points(spark, sf_dir), summary=True).withColumn("path", F.col("ride_id").cast("string"))
    found = activity.decode_metadata(files)
    return found.select(F.col("path").cast("long").alias("ride_id"), "start_t", "end_t", r6("duration_s"), "point_count", "sport", r6("total_elapsed"), r6("total_distance"), "max_hr")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, epoch_us(min(ts)) / 1000000 session_start, count(*) n, round(sum("value"), 6) total FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = imports.sessions(e, "user_id", "ts", "value", "12 hours")
    return found.select("user_id", (F.unix_micros("session.start") / 1e6).alias("session_start"), "n", r6("total"))


@query("SELECT sha256(text) file_hash FROM documents GROUP BY 1")
def stream_dedup(spark, sf_dir):
    """A stream over the documents, each content once; it ends when all files are read."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may name a file or a folder
    once = stream.select(F.sha2("text", 256).alias("file_hash"), F.lit("2024-01-01").cast("timestamp").alias("seen"))
    out = storage.new_path(spark, "stream-dedup")
    imports.without_repeats(once, "seen").select("file_hash").writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("file_hash string").parquet(out)


@query()
def ride_pipeline_gold(spark, sf_dir):
    p = points(spark, sf_dir).drop("watts", "grade", "mode")
    gold = ride_pipeline.run(p)
    return gold.select("ride_id", "method", *[F.round(c, 3).alias(c) for c in ("distance_m", "duration_s", "avg_hr", "avg_watts", "pedalling", "np", "trimp", "kcal", "gain_m", "vam_mh", "best_5m")])
