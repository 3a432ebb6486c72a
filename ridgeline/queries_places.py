"""Registered queries: places and grids, dimension joins, edits of stored rides, and what dashboards read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, r6
from .functions import checks
from .functions import geo as G
from .functions import physio as H
from .operators import aggregates as A
from .operators import joins as J
from .operators import selection as S
from .plans import storage
from .plans.views import RIDES_SQL, points, rides
from .queries_time import BY, P
from .sources import raster

R = f"WITH r AS ({RIDES_SQL})\n"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- places

_A, _B = G.GRS80
_E2 = 1 - _B * _B / (_A * _A)


@query(P + f", n AS (SELECT ride_id, idx, radians(lat) p, radians(lon) q, {_A!r}::DOUBLE / sqrt(1 - {_E2!r}::DOUBLE * sin(radians(lat)) * sin(radians(lat))) nu, elev FROM p) SELECT ride_id, idx, round((nu + elev) * cos(p) * cos(q), 4) x, round((nu + elev) * cos(p) * sin(q), 4) y, round(({1 - _E2!r}::DOUBLE * nu + elev) * sin(p), 4) z FROM n")
def ecef(spark, sf_dir):
    x, y, z = G.to_ecef("lat", "lon", "elev")
    return points(spark, sf_dir).select("ride_id", "idx", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


@query(P + ", o AS (SELECT *, min(lat) OVER (PARTITION BY ride_id) a, min(lon) OVER (PARTITION BY ride_id) b FROM p) SELECT ride_id, idx, round((lon - b) * 111320.0E0 * cos(radians(a)), 6) + 0.0E0 east_m, round((lat - a) * 111320.0E0, 6) + 0.0E0 north_m FROM o")
def local_metres(spark, sf_dir):
    from .operators.routes import local_track

    return local_track(points(spark, sf_dir), "ride_id", "lat", "lon").select("ride_id", "idx", r6("east_m"), r6("north_m"))


@query("SELECT p_partkey, round((p_partkey % 256) * 256.0E0 + p_size * 5 % 256 + (p_partkey * 7 % 256) / 256.0E0 - 32768, 6) metres FROM part")
def terrain_rgb(spark, sf_dir):
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", r6(G.terrain_rgb(k % 256, F.col("p_size") * 5 % 256, k * 7 % 256), "metres"))


@query("SELECT c_custkey, CAST(greatest(120.0E0, 220.0E0 - (18 + c_custkey % 110)) AS DOUBLE) max_hr FROM customer")
def default_max_hr(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", H.default_max_hr(18 + F.col("c_custkey") % 110).alias("max_hr"))


_TILE = (51.99, -1.51, 52.08, -1.49)


@query(P + """, g AS (SELECT n_nationkey // 5 r, n_nationkey % 5 c, n_regionkey * 10.0E0 + n_nationkey v FROM nation), q AS (SELECT ride_id, idx, (52.08E0 - lat) / (52.08E0 - 51.99E0) * 4 y, (lon + 1.51E0) / (-1.49E0 + 1.51E0) * 4 x FROM p WHERE lat BETWEEN 51.99 AND 52.08 AND lon BETWEEN -1.51 AND -1.49),
f AS (SELECT *, CAST(floor(y) AS INTEGER) r0, CAST(floor(x) AS INTEGER) c0 FROM q), h AS (SELECT *, least(r0 + 1, 4) r1, least(c0 + 1, 4) c1 FROM f)
SELECT h.ride_id, h.idx, round((a.v * (1 - (x - c0)) + b.v * (x - c0)) * (1 - (y - r0)) + (d.v * (1 - (x - c0)) + e.v * (x - c0)) * (y - r0), 6) + 0.0E0 elev
FROM h JOIN g a ON a.r = r0 AND a.c = c0 JOIN g b ON b.r = r0 AND b.c = c1 JOIN g d ON d.r = r1 AND d.c = c0 JOIN g e ON e.r = r1 AND e.c = c1""")
def raster_sample(spark, sf_dir):
    """Elevations from a grid of five by five cells."""
    n = _table(spark, sf_dir, "nation").select(F.floor(F.col("n_nationkey") / 5).alias("r"), (F.col("n_nationkey") % 5).alias("c"), (F.col("n_regionkey") * 10.0 + F.col("n_nationkey")).alias("v"))
    lines = n.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("line")).select("r", F.transform("line", lambda x: x["v"]).alias("line"))
    grid = lines.groupBy().agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("g")).select(*[F.lit(v).alias(n) for v, n in zip(_TILE, ("south", "west", "north", "east"), strict=True)], F.transform("g", lambda x: x["line"]).alias("raster"))
    found = raster.sample(points(spark, sf_dir).select("ride_id", "idx", "lat", "lon"), grid, "lat", "lon", "elev")
    return found.where("elev IS NOT NULL").select("ride_id", "idx", r6("elev"))


@query(P + ", s AS (SELECT *, CASE WHEN (ride_id + idx) % 3 = 0 OR ride_id % 4 = 1 AND idx % 3 > 0 THEN NULL ELSE elev END lidar, CASE WHEN idx % 2 = 0 THEN elev + 1 END device FROM p), f AS (SELECT *, avg(CASE WHEN lidar IS NULL THEN 0.0E0 ELSE 1.0E0 END) OVER (PARTITION BY ride_id) share FROM s) SELECT ride_id, idx, round(CASE WHEN share >= 0.5 THEN coalesce(lidar, device, elev - 1) ELSE coalesce(device, elev - 1) END, 6) best FROM f")
def provider_cascade(spark, sf_dir):
    i, n = F.col("idx"), F.col("ride_id")
    p = points(spark, sf_dir).withColumn("lidar", F.when(~(((n + i) % 3 == 0) | ((n % 4 == 1) & (i % 3 > 0))), F.col("elev"))).withColumn("device", F.when(i % 2 == 0, F.col("elev") + 1)).withColumn("mesh", F.col("elev") - 1)
    return raster.cascade(p, "ride_id", "lidar", ["device", "mesh"], "best").select("ride_id", "idx", r6("best"))


# --- dimension joins

@query("SELECT c_custkey, round(c_acctbal / 1.0E6, 6) crr, o.o_orderkey ride_id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) o_orderkey FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def calibration_rides(spark, sf_dir):
    """Every calibration with its latest ride, if it has one."""
    latest = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("ride_id"))
    c = _table(spark, sf_dir, "customer")
    return c.join(latest, c["c_custkey"] == latest["o_custkey"], "left").select("c_custkey", r6(F.col("c_acctbal") / 1e6, "crr"), "ride_id")


@query(R + ", x AS (SELECT route_id, count(*) n, min(ride_id) ref FROM r GROUP BY route_id) SELECT r.ride_id, x.route_id, x.n, x.ref FROM r JOIN x USING (route_id) WHERE r.has_hr")
def route_of_ride(spark, sf_dir):
    """The route of each ride that has a heart rate."""
    r = rides(spark, sf_dir)
    routes = r.groupBy("route_id").agg(F.count("*").alias("n"), F.min("ride_id").alias("ref"))
    return r.where("has_hr").select("ride_id", "route_id").join(routes, "route_id").select("ride_id", "route_id", "n", "ref")


@query(R + ", w AS (SELECT epoch_us(date_trunc('day', ts)) / 8.64E10 AS d, avg(\"value\") wind FROM events GROUP BY 1) SELECT r.ride_id, round(wind, 6) wind FROM r LEFT JOIN w ON floor(r.day) = w.d - 10000")
def rides_with_weather(spark, sf_dir):
    """The day's wind of each ride, where the cache has the day."""
    e = _table(spark, sf_dir, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10).alias("d")).agg(F.avg("value").alias("wind"))
    r = rides(spark, sf_dir)
    return r.join(e, F.floor("day") == F.col("d") - 10000, "left").select("ride_id", r6("wind"))


@query(R + ", o AS (SELECT route_id, max(trimp) v FROM r WHERE has_hr AND route_id % 3 > 0 GROUP BY route_id), n AS (SELECT route_id, max(trimp) v FROM r WHERE NOT has_hr GROUP BY route_id) SELECT ride_id, round(coalesce(n.v, o.v), 6) wind, n.v IS NOT NULL AND n.v IS DISTINCT FROM o.v late FROM r LEFT JOIN o USING (route_id) LEFT JOIN n USING (route_id)")
def late_weather(spark, sf_dir):
    """Reference values of which some come with a later delivery."""
    r = rides(spark, sf_dir)
    best = lambda d: d.groupBy("route_id").agg(F.max("trimp").alias("v"))
    return J.with_late(r.select("ride_id", "route_id"), best(r.where("has_hr AND route_id % 3 > 0")), best(r.where("NOT has_hr")), "route_id", "v", "wind").select("ride_id", r6("wind"), "late")


@query("SELECT event_id, round(\"value\", 6) plain, CAST(json_extract_string(doc, '$.calories.kcal') AS DOUBLE) kcal, user_id FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_object('calories', json_object('kcal', user_id * 2)) END doc FROM events)")
def ride_summaries(spark, sf_dir):
    """A list's rows: the plain columns, and the headline out of the nested document, where there is one."""
    e = _table(spark, sf_dir, "events")
    doc = F.when(F.col("event_id") % 5 != 0, F.to_json(F.struct(F.struct((F.col("user_id") * 2).alias("kcal")).alias("calories"))))
    return e.select("event_id", r6("value", "plain"), checks.first_of(doc, ["$.calories.kcal"]).alias("kcal"), "user_id")


# --- stored rides

@query(P + " SELECT ride_id, idx, round(CASE WHEN ride_id % 3 = 0 THEN watts * 2 + 1 ELSE watts END, 6) watts FROM p")
def rewritten_power(spark, sf_dir):
    """A stored table of samples in which the power of some rides is replaced."""
    p = points(spark, sf_dir).select("ride_id", "idx", "watts")
    path = storage.new_path(spark, "samples")
    storage.write_by_key(p, path, "ride_id")
    storage.rewrite_keys(spark, path, "ride_id", p.where("ride_id % 3 = 0").withColumn("watts", F.col("watts") * 2 + 1))
    return storage.read_by_key(spark, path).select("ride_id", "idx", r6("watts"))


@query("SELECT 'order' message_type, epoch_us(o_orderdate) AS \"timestamp\", NULL::VARCHAR event_type, o_orderkey key, o_orderstatus status FROM orders UNION ALL SELECT 'event', epoch_us(ts), event_type, event_id, NULL FROM events")
def csv_export(spark, sf_dir):
    """Two kinds of messages in one CSV file set under the union of their columns, read back."""
    o = _table(spark, sf_dir, "orders").select(F.lit("order").alias("message_type"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    e = _table(spark, sf_dir, "events").select(F.lit("event").alias("message_type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("key"), "event_type")
    both, path = S.union_all(o, e), storage.new_path(spark, "export")
    both.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(both.schema).csv(path)


@query("SELECT doc_id, sha256(from_base64(to_base64(encode(coalesce(text, ''))))) file_hash FROM documents")
def uploads_decoded(spark, sf_dir):
    """Uploads that arrive as base64: the hash of what they hold."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.unbase64(F.base64(F.coalesce("text", F.lit("")).cast("binary"))), 256).alias("file_hash"))


@query(P + ", n AS (SELECT ride_id, count(*) n, count(*) * 100 bytes FROM p GROUP BY ride_id) SELECT ride_id, n, n BETWEEN 60 AND 80 AND bytes <= 7900 ok FROM n")
def import_guards(spark, sf_dir):
    n = points(spark, sf_dir).groupBy("ride_id").agg(F.count("*").alias("n"))
    return n.select("ride_id", "n", S.importable(F.col("n"), F.col("n") * 100, 60, 80, 7900).alias("ok"))


@query("SELECT h file_hash, min(doc_id) doc_id FROM (SELECT sha256(text) h, doc_id FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL) WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) GROUP BY h")
def dedup_gate(spark, sf_dir):
    """Contents of the second half of an import that the first half does not have, each once."""
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    new = S.by_content(d.where("doc_id % 2 = 1"), "text", "doc_id")
    old = S.by_content(d.where("doc_id % 2 = 0"), "text", "doc_id")
    return J.missing(new, old, ["file_hash"]).select("file_hash", "doc_id")


@query(R + ", f AS (SELECT ride_id, route_id, day, CASE ride_id % 3 WHEN 0 THEN 'loop' WHEN 1 THEN 'pooled' ELSE 'climb' END kind, (ride_id % 13) / 1000.0E0 crr FROM r), b AS (SELECT route_id, arg_max(crr, (day, ride_id)) FILTER (kind <> 'climb') crr FROM f GROUP BY route_id) SELECT route_id, round(coalesce(crr, 0.005E0), 6) crr, crr IS NOT NULL calibrated FROM b")
def applied_calibration(spark, sf_dir):
    """Each bike's rolling resistance after its last fit; climbing checks never change it."""
    n = F.col("ride_id")
    fits = rides(spark, sf_dir).select("route_id", "day", "ride_id", F.when(n % 3 == 0, "loop").when(n % 3 == 1, "pooled").otherwise("climb").alias("kind"), ((n % 13) / 1000.0).alias("crr"))
    last = fits.groupBy("route_id").agg(F.max_by(F.when(F.col("kind") != "climb", F.col("crr")), F.when(F.col("kind") != "climb", F.struct("day", "ride_id"))).alias("crr"))
    return last.select("route_id", r6(F.coalesce("crr", F.lit(0.005)), "crr"), F.col("crr").isNotNull().alias("calibrated"))


# --- what dashboards read

@query(P + f" SELECT ride_id, idx, CAST(row_number() OVER ({BY} t DESC, idx) AS INTEGER) place, round(t - first_value(t) OVER ({BY} t), 6) since FROM p")
def ordered_children(spark, sf_dir):
    w = Window.partitionBy("ride_id")
    return points(spark, sf_dir).select("ride_id", "idx", F.row_number().over(w.orderBy(F.desc("t"), "idx")).alias("place"), r6(F.col("t") - F.min("t").over(w), "since"))


@query(R + " SELECT metric, ride_id, round(\"value\", 6) AS \"value\" FROM (SELECT 'trimp' metric, ride_id, trimp \"value\" FROM r UNION ALL SELECT 'distance_m', ride_id, distance_m FROM r) ORDER BY \"value\" DESC, metric, ride_id LIMIT 6")
def top_records(spark, sf_dir):
    """The six highest values of the dashboard's list."""
    long = rides(spark, sf_dir).select("ride_id", F.explode(F.create_map(F.lit("trimp"), F.col("trimp"), F.lit("distance_m"), F.col("distance_m"))).alias("metric", "value"))
    return long.orderBy(F.desc("value"), "metric", "ride_id").limit(6).select("metric", "ride_id", r6("value"))


@query("WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 i, greatest(count(*) OVER () // least(greatest(100, 240), 5000), 1) step FROM (SELECT event_id, user_id FROM events WHERE event_type = 'click')) SELECT event_id FROM n WHERE i % step = 0")
def stride_clamped(spark, sf_dir):
    """A series of about 100 points, of which no fewer than 240 are sent."""
    e = _table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.lit(1).alias("series"))
    return S.stride_within(e, "series", "event_id", 100).select("event_id")


@query(P + ", q AS (SELECT ride_id, abs(watts - 40) d FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY d) k, count(*) OVER (PARTITION BY ride_id) n FROM q) SELECT ride_id, round(avg(d), 6) mean, round(max(CASE WHEN k = least(CAST(floor(n * 0.95E0) AS BIGINT) + 1, n) THEN d END), 6) rank_value FROM n GROUP BY ride_id")
def nearest_rank(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("d", F.abs(F.col("watts") - 40))
    return A.nearest_rank(p, "ride_id", "d").select("ride_id", r6("mean"), r6("rank_value"))


@query(P + ", s AS (SELECT ride_id, quantile_cont(watts, 0.02) p, quantile_cont(watts, 0.98) q FROM p GROUP BY ride_id), b AS (SELECT ride_id, quantile_cont(e, 0.15) lo, quantile_cont(e, 0.85) hi FROM (SELECT ride_id, unnest([watts * 0.8E0, watts * 1.3E0]) e FROM p) GROUP BY ride_id), m AS (SELECT ride_id, least(p, lo) a, greatest(q, hi) b FROM s JOIN b USING (ride_id)) SELECT ride_id, round(a - (b - a) * 0.06E0, 5) + 0.0E0 lo, round(b + (b - a) * 0.06E0, 5) hi FROM m")
def axis_domain(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("l", F.col("watts") * 0.8).withColumn("h", F.col("watts") * 1.3)
    return A.axis_domain(p, "ride_id", "watts", "l", "h").select("ride_id", (F.round("lo", 5) + F.lit(0.0)).alias("lo"), F.round("hi", 5).alias("hi"))


@query("SELECT page_id, left(regexp_replace(trim(regexp_replace(regexp_replace(url, '.*[/\\\\]', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '.'), '^$', 'upload'), 40) AS short_name FROM pages")
def file_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", checks.file_name("url", 40).alias("short_name"))


@query("SELECT event_id, CAST(hour(ts + CASE WHEN user_id % 2 = 0 THEN INTERVAL 9 HOUR ELSE INTERVAL (-3) HOUR END) AS INTEGER) local_hour FROM events")
def local_hours(spark, sf_dir):
    """A zone for each rider."""
    e = _table(spark, sf_dir, "events")
    zone = F.when(F.col("user_id") % 2 == 0, "Asia/Tokyo").otherwise("-03:00")
    return e.select("event_id", F.hour(checks.local_time(F.col("ts").cast("timestamp"), zone)).alias("local_hour"))
