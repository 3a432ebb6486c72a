"""Registered queries: import jobs, tables that change together, patched files, power by tags."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import ORACLES, query, r6
from .plans import committed, recompute, ride_pipeline, storage
from .plans.views import TAGGED_SQL, points, tagged
from .queries_time import P
from .sources import activity, patch
from .streaming import jobs

LIMIT = 2000  # bytes of a file that the queries allow
#: A file of n records has 46 + 26 n bytes.
_SIZED = P + f""", n AS (SELECT ride_id, count(*) n, 46 + 26 * count(*) size FROM p GROUP BY ride_id),
j AS (SELECT ride_id, n, size, 'a/' || ride_id path, CASE WHEN size > {LIMIT} AND ride_id % 7 <> 3 THEN 'File too large: ' || size || ' bytes' WHEN ride_id % 7 = 3 THEN 'the file ends within a definition' WHEN n < 20 THEN 'Too few records: ' || n END why, false late FROM n
 UNION ALL SELECT ride_id, n, size, 'a/' || ride_id || '-copy', CASE WHEN size > {LIMIT} THEN 'File too large: ' || size || ' bytes' WHEN n < 20 THEN 'Too few records: ' || n END, false FROM n WHERE ride_id % 5 = 1 AND ride_id % 7 <> 3
 UNION ALL SELECT ride_id, n, size, 'b/' || ride_id, CASE WHEN size > {LIMIT} THEN 'File too large: ' || size || ' bytes' WHEN n < 20 THEN 'Too few records: ' || n END, true FROM n WHERE ride_id % 3 = 0)"""


def _files(spark, sf_dir, which: str):
    """Files of all rides under a/ (some cut within their definition, some twice), or whole ones under b/."""
    f = activity.encoded(points(spark, sf_dir))
    if which == "b":
        found = f.where("ride_id % 3 = 0").select(F.concat(F.lit("b/"), "ride_id").alias("path"), "content")
    else:
        cut = F.when(F.col("ride_id") % 7 == 3, F.expr("substring(content, 1, 30)")).otherwise(F.col("content"))
        found = f.select(F.concat(F.lit("a/"), "ride_id").alias("path"), cut.alias("content"))
        found = found.union(f.where("ride_id % 5 = 1 AND ride_id % 7 <> 3").select(F.concat(F.lit("a/"), "ride_id", F.lit("-copy")), "content"))
    return found.withColumn("file_hash", F.sha2("content", 256))


@query(_SIZED + """ SELECT path, CASE WHEN why IS NOT NULL THEN 'error' WHEN path LIKE '%-copy' OR (late AND ride_id % 7 <> 3) THEN 'duplicate' ELSE 'done' END status,
coalesce(why, CASE WHEN path LIKE '%-copy' OR (late AND ride_id % 7 <> 3) THEN 'Already imported' ELSE 'Imported' END) message, CASE WHEN why IS NULL THEN n ELSE 0 END n_points FROM j""")
def import_jobs(spark, sf_dir):
    """Each job's final state after two runs of the import: good, repeated, cut and oversized files, and the samples of the ride that a job's content has given (0: none)."""
    root = storage.new_path(spark, "imports")
    schema = "path string, content binary, file_hash string"
    for which in ("a", "b"):
        _files(spark, sf_dir, which).repartition(2).write.mode("append").parquet(f"{root}/drop")
        stream = spark.readStream.schema(schema).parquet(f"{root}/drop")
        jobs.import_files(stream, f"{root}/tables", f"{root}/log", max_bytes=LIMIT).awaitTermination()
    rides = committed.read(spark, f"{root}/tables", "ride").select("file_hash", "n_points")
    return jobs.states(jobs.events(spark, f"{root}/tables")).join(rides, "file_hash", "left").select("path", "status", "message", F.coalesce("n_points", F.lit(0)).alias("n_points"))


@query(P + "SELECT ride_id, count(*) n_gps, count(hr) n_hr, count(*) n_power, 1 n_weather, round(sum(hr), 6) sum_hr, round(max(dist), 6) far FROM p WHERE ride_id % 3 <> 2 GROUP BY ride_id")
def committed_children(spark, sf_dir):
    """What readers see of rides and their children after a batch that was committed twice and one that failed after its second table."""
    root = storage.new_path(spark, "rides")
    p = storage.stored(ride_pipeline.with_power(ride_pipeline.with_elevation(points(spark, sf_dir).drop("watts", "mode").withColumn("file_hash", F.sha2(F.col("ride_id").cast("string"), 256)))), "samples")
    weather = p.select("ride_id", F.lit(12.0).alias("temp"), F.lit(3.0).alias("wind_speed"), F.lit(270.0).alias("wind_dir"), F.lit(1013.0).alias("pressure"), F.lit("made").alias("source")).distinct()
    whole, failed = (committed.ride_tables(p.where(on), weather) for on in ("ride_id % 3 <> 2", "ride_id % 3 = 2"))
    committed.insert(spark, root, 1, whole)
    for name in list(failed)[:2]:
        committed.stage(root, 2, name, failed[name])
    committed.insert(spark, root, 1, whole)
    seen = lambda name: committed.read(spark, root, name)
    out = seen("ride").select("ride_id")
    for name, sums in {"gps_point": [F.count("*").alias("n_gps"), r6(F.max("dist"), "far")], "hr_point": [F.count("*").alias("n_hr"), r6(F.sum("hr"), "sum_hr")], "power_point": [F.count("*").alias("n_power")], "weather": [F.count("*").cast("int").alias("n_weather")]}.items():
        out = out.join(seen(name).groupBy("ride_id").agg(*sums), "ride_id", "left")
    return out.select("ride_id", "n_gps", F.coalesce("n_hr", F.lit(0)).alias("n_hr"), "n_power", "n_weather", "sum_hr", "far")


PLAIN_FIELDS = [f for f in activity.ALTITUDE_FIELDS if f[0] not in (2, 78)]


@query(P + "SELECT ride_id, round_even(t, 0) + 631065600 t, hr, round(round_even((elev + 3 + 500) * 5, 0) / 5.0E0 - 500, 6) alt_raw, round(round_even(dist * 100, 0) / 100.0E0, 6) dist FROM p WHERE idx % 10 <> 9 UNION ALL SELECT ride_id, round_even(t, 0) + 631065600, hr, NULL, round(round_even(dist * 100, 0) / 100.0E0, 6) FROM p WHERE idx % 10 = 9")
def patched_altitude(spark, sf_dir):
    """Files whose records have no altitude get one for nine of ten records; all else is read back as it was."""
    p = points(spark, sf_dir)
    files = activity.encoded(p, fields=PLAIN_FIELDS).select(F.col("ride_id").cast("string").alias("path"), "content")
    altitudes = p.where("idx % 10 <> 9").select(F.col("ride_id").cast("string").alias("path"), F.col("idx").cast("int").alias("k"), (F.col("elev") + 3).alias("altitude"))
    found = activity.decode(patch.patched_files(files, altitudes).where("error IS NULL")).where("crc_valid")
    return found.select(F.col("path").cast("long").alias("ride_id"), "t", F.col("hr").cast("double").alias("hr"), r6("alt_raw"), r6("dist"))


@query(f"WITH p AS ({TAGGED_SQL})" + """, m AS (SELECT ride_id, idx, speed, label, atan(grade) a, CASE WHEN grade < -0.01 AND label IS DISTINCT FROM 'pedal' THEN 'coast' WHEN speed < 0.3 THEN 'static' ELSE 'pedal' END mode FROM p),
w AS (SELECT *, (0.005E0 * 86 * 9.80665E0 * cos(a) + 0.5E0 * 1.225E0 * 0.35E0 * (speed + 4) * (speed + 4) + 86.0E0 * 9.80665E0 * sin(a)) * speed wheel FROM (SELECT ride_id, idx, speed, a, mode, label FROM m))
SELECT ride_id, idx, mode, label, round(CASE WHEN mode = 'pedal' THEN greatest(CASE WHEN wheel > 0 THEN wheel / 0.97E0 ELSE wheel END, 0.0E0) ELSE 0.0E0 END, 6) watts FROM (SELECT ride_id, idx, mode, label, (0.005E0 * 86 * 9.80665E0 * cos(a) * speed + 0.5E0 * 1.225E0 * 0.35E0 * (speed + 4) * (speed + 4) * speed + 86.0E0 * 9.80665E0 * sin(a) * speed) wheel FROM w)""")
def tagged_power(spark, sf_dir):
    """Power with tags, against 4 m/s of wind: a descent that is tagged as pedalled has power again."""
    p = ride_pipeline.powered(tagged(spark, sf_dir), "speed", 0.0, 1.225, headwind=F.lit(4.0), label="label")
    return p.select("ride_id", "idx", "mode", "label", r6("watts_est", "watts"))


RECOMPUTE = [
    recompute.Step("shape", ("samples",), lambda t: t["samples"].groupBy("ride_id").agg(F.count("*").alias("n"), F.max("dist").alias("far"))),
    recompute.Step("power", ("samples", "tags", "profile"), lambda t: _tagged_watts(t["samples"], t["tags"], t["profile"])),
    recompute.Step("load", (), lambda t: t["power"].join(t["shape"], "ride_id").groupBy("ride_id").agg(F.avg("watts_est").alias("watts"), F.first("n").alias("n"), F.first("far").alias("far")), after=("power", "shape")),
]


def _tagged_watts(samples, tags, profile):
    joined = samples.join(tags, ["ride_id", "idx"], "left").crossJoin(F.broadcast(profile))
    return ride_pipeline.powered(joined, "speed", 0.0, 1.225, headwind=F.col("wind"), label="label").select("ride_id", "idx", "watts_est", "mode")


@query("SELECT ride_id, round(avg(watts), 3) watts, count(*) n, max(CASE WHEN tag IS NULL THEN 1 ELSE 2 END)::BIGINT power_batch, 1::BIGINT shape_batch, max(CASE WHEN tag IS NULL THEN 1 ELSE 2 END)::BIGINT load_batch FROM (SELECT *, label tag FROM (" + ORACLES["tagged_power"].replace(TAGGED_SQL, f"SELECT * REPLACE (CASE WHEN ride_id % 5 = 0 THEN label END AS label) FROM ({TAGGED_SQL})") + ")) GROUP BY ride_id")
def partial_recompute(spark, sf_dir):
    """Power and load of all rides after a fifth of them were tagged, with the batch that each of their tables is from: only tagged rides were computed again, and a third refresh did nothing."""
    root = storage.new_path(spark, "derived")
    p = storage.stored(tagged(spark, sf_dir).select("ride_id", "idx", "speed", "grade", "dist", "label"), "samples")
    samples, profile = p.drop("label"), spark.range(1).select(F.lit(4.0).alias("wind"))
    tags = p.where("label IS NOT NULL AND ride_id % 5 = 0").select("ride_id", "idx", "label")
    for known in (tags.limit(0), tags, tags):
        recompute.refresh(spark, root, RECOMPUTE, {"samples": samples, "tags": known}, {"profile": profile})
    batch = lambda name, schema: recompute.table(spark, root, name, T.StructType.fromDDL(schema)).select("ride_id", F.col("batch").alias(f"{name}_batch")).distinct()
    load = recompute.table(spark, root, "load", T.StructType.fromDDL("ride_id long, watts double, n long, far double"))
    load = load.select("ride_id", F.round("watts", 3).alias("watts"), "n", F.col("batch").alias("load_batch"))
    return load.join(batch("power", "ride_id long, idx long"), "ride_id").join(batch("shape", "ride_id long"), "ride_id")
