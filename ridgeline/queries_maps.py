"""Registered queries: elevation from coloured tiles and from a point service, road networks and weather from a service's answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import query, r6
from .functions.geo import slippy_tile
from .plans import storage
from .plans.views import points
from .queries_time import P
from .sources import point_elevation, roads, tiles, weather


def _made(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Elevation of a pixel of the whole map, in 256ths."""
    return np.floor((100 * np.sin(gx / 20.0) + 50 * np.cos(gy / 30.0) + 200) * 256).astype(np.int64)


@F.arrow_udf(T.BinaryType())
def _tile(x: pa.Array, y: pa.Array) -> pa.Array:
    out = []
    for tx, ty in zip(x.to_pylist(), y.to_pylist(), strict=True):
        gy, gx = np.mgrid[ty * 256 : ty * 256 + 256, tx * 256 : tx * 256 + 256]
        code = _made(gx, gy) + 32768 * 256
        out.append(tiles.written_tile(code >> 16, code >> 8 & 255, code & 255))
    return pa.array(out, pa.binary())


_PIXEL = "floor((100 * sin({gx} / 20.0E0) + 50 * cos({gy} / 30.0E0) + 200) * 256) / 256"
_CORNERS = " + ".join(f"{wx} * {wy} * ({_PIXEL.format(gx=gx, gy=gy)})" for gx, wx in (("gx", "(1 - fx)"), ("(gx + 1)", "fx")) for gy, wy in (("gy", "(1 - fy)"), ("(gy + 1)", "fy")))


@query(P + f""", u AS (SELECT ride_id, idx, (lon + 180.0E0) / 360.0E0 * 16384 * 256 - 0.5E0 u, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793E0) / 2 * 16384 * 256 - 0.5E0 v FROM p),
g AS (SELECT *, floor(u) gx, floor(v) gy, u - floor(u) fx, v - floor(v) fy FROM u) SELECT ride_id, idx, round({_CORNERS}, 4) elev FROM g""")
def tile_elevation(spark, sf_dir):
    """Every sample's elevation from the tiles around it, which are made with all five row filters; across tile edges too."""
    p = points(spark, sf_dir).select("ride_id", "idx", "lat", "lon")
    x, y = slippy_tile("lat", "lon", 14)
    around = F.explode(F.array(*[F.struct(F.floor(x + i).alias("x"), F.floor(y + j).alias("y")) for i in (-0.002, 0.002) for j in (-0.002, 0.002)]))
    wanted = p.select(around.alias("t")).select("t.*").distinct()
    made = wanted.select(F.lit(14).alias("z"), "x", "y", _tile("x", "y").alias("content"))
    return tiles.tile_elevation(p, made, ["ride_id", "idx"]).select("ride_id", "idx", F.round("elev", 4).alias("elev"))


@query("""WITH w AS (SELECT l_orderkey way, l_linenumber p, l_suppkey node FROM lineitem), n AS (SELECT s_suppkey node, s_acctbal lat, s_nationkey * 1.0E0 lon FROM supplier WHERE s_suppkey % 5 <> 0),
j AS (SELECT way, p, node, lat, lon FROM w JOIN n USING (node) WHERE way % 7 <> 3), s AS (SELECT way, CAST(row_number() OVER v - 1 AS INTEGER) k, lat lat1, lon lon1, lead(lat) OVER v lat2, lead(lon) OVER v lon2 FROM j WINDOW v AS (PARTITION BY way ORDER BY p, node))
SELECT 'box' || (way // 64) AS box, way, k, lat1, lon1, lat2, lon2 FROM s WHERE lat2 IS NOT NULL""")
def road_network(spark, sf_dir):
    """Answers of a map service, made of orders (ways) and suppliers (nodes) by box, then split into segments; footpaths are left out."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    items = t("lineitem").select(F.col("l_orderkey").cast("long").alias("way"), "l_linenumber", F.col("l_suppkey").cast("long").alias("node"), F.concat(F.lit("box"), F.floor(F.col("l_orderkey") / 64)).alias("box"))
    none = lambda kind: F.lit(None).cast(kind)
    ways = items.groupBy("box", "way").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "node"))).alias("x")).select(
        "box", F.struct(F.lit("way").alias("type"), F.col("way").alias("id"), none("double").alias("lat"), none("double").alias("lon"), F.col("x.node").alias("nodes"), F.create_map(F.lit("highway"), F.when(F.col("way") % 7 == 3, "footway").otherwise("tertiary")).alias("tags")).alias("e")
    )
    known = t("supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").cast("long").alias("node"), F.col("s_acctbal").cast("double").alias("lat"), F.col("s_nationkey").cast("double").alias("lon"))
    nodes = items.select("box", "node").distinct().join(known, "node").select("box", F.struct(F.lit("node").alias("type"), F.col("node").alias("id"), "lat", "lon", none("array<bigint>").alias("nodes"), none("map<string,string>").alias("tags")).alias("e"))
    answers = ways.union(nodes).groupBy("box").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("body"))
    return roads.network(answers, ["tertiary", "residential"])


# British summer time ends on the last Sunday of October, until 1995 on the first one from the 22nd on.
_SUNDAY = "make_timestamp(year(ts), {m}, {d}, 1, 0, 0) - to_days(CAST(dayofweek(make_date(year(ts), {m}, {d})) AS INTEGER))"


@query("WITH o AS (SELECT o_orderkey, CAST(o_custkey % 500 AS BIGINT) p, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) ts FROM orders), z AS (SELECT *, CASE WHEN p % 2 = 1 THEN ts + INTERVAL 9 HOUR WHEN ts >= " + _SUNDAY.format(m=3, d=31) + " AND ts < " + _SUNDAY.format(m=10, d="CASE WHEN year(ts) <= 1995 THEN 28 ELSE 31 END") + """ THEN ts + INTERVAL 1 HOUR ELSE ts END lt FROM o),
k AS (SELECT *, hour(lt) hr, day(lt) d, CASE WHEN p % 11 = 3 THEN 5 ELSE 24 END n, p % 13 <> 4 AND p % 17 <> 5 known FROM z),
w AS (SELECT k.*, h, h = least(hr, n - 1) here, p % 20 + h * 0.5E0 temp, CASE WHEN (p + h) % 5 <> 0 THEN (p % 30 + h * 1.8E0) / 3.6E0 END wind, CASE WHEN (d + h) % 7 <> 0 THEN (p * 10 + h * 5) % 360 END dir, CASE WHEN p % 3 <> 0 THEN (p % 30 + h * 1.8E0 + d) / 3.6E0 END gust FROM k, range(24) t(h) WHERE h < n),
g AS (SELECT o_orderkey, any_value(known) known, any_value(p) p, any_value(hr) hr, max(CASE WHEN here THEN temp END) temp, max(CASE WHEN here THEN wind END) wind, max(CASE WHEN here THEN dir END) dir, max(CASE WHEN here THEN gust END) gust, count(CASE WHEN wind IS NOT NULL AND dir IS NOT NULL THEN 1 END) n_pairs,
sum(CASE WHEN dir IS NOT NULL THEN wind END) sum_pairs, CASE WHEN count(wind) >= 3 THEN least(greatest(stddev_pop(wind) * 0.7E0 + 0.5E0, 0.5E0), 4.0E0) END hourly FROM w GROUP BY o_orderkey)
SELECT o_orderkey, round(CASE WHEN known THEN temp ELSE 15.0E0 END, 6) temp_c, round(CASE WHEN known THEN coalesce(wind, 0.0E0) ELSE 0.0E0 END, 6) wind, CAST(CASE WHEN known THEN coalesce(dir, 0) ELSE 0 END AS DOUBLE) dir, CAST(CASE WHEN known THEN 1000 + p % 30 ELSE 1013 END AS DOUBLE) pressure,
coalesce(round(CASE WHEN known THEN CASE WHEN gust IS NULL OR wind IS NULL THEN hourly ELSE greatest(coalesce(hourly, 0.0E0), least(greatest(greatest(gust - wind, 0.0E0) * 0.4E0, 0.5E0), 4.0E0)) END END, 6), -1.0E0) sigma, CAST(CASE WHEN known THEN hr ELSE -1 END AS INTEGER) ride_hour,
CAST(CASE WHEN known THEN n_pairs ELSE 0 END AS INTEGER) n_pairs, round(CASE WHEN known THEN coalesce(sum_pairs, 0.0E0) ELSE 0.0E0 END, 6) sum_pairs, CASE WHEN known THEN 'open-meteo' ELSE 'defaults' END AS source FROM g""")
def ride_weather(spark, sf_dir):
    """The weather of each order's ride from JSON answers for its place and local day: series with holes, short days, broken and missing answers, older answers beside newer ones, summer time."""
    p = (F.col("o_custkey") % 500).cast("long")
    start = F.to_timestamp("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    rides = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (50 + p * 0.02).alias("lat"), F.when(p % 2 == 0, -1.5).otherwise(10.0).alias("lon"), start.alias("start"))
    rides = weather.asked(rides, other_zone="Asia/Tokyo")
    p, d = F.floor((F.col("lat_e3") - 50000) / 20), F.dayofmonth("day")
    hours = F.sequence(F.lit(0), F.when(p % 11 == 3, 4).otherwise(23))
    each = lambda f: F.transform(hours, f)
    series = {
        "time": each(lambda h: F.format_string("%sT%02d:00", F.col("day").cast("string"), h)),
        "temperature_2m": each(lambda h: p % 20 + h * 0.5),
        "wind_speed_10m": each(lambda h: F.when((p + h) % 5 != 0, p % 30 + h * 1.8)),
        "wind_direction_10m": each(lambda h: F.when((d + h) % 7 != 0, (p * 10 + h * 5) % 360)),
        "pressure_msl": each(lambda h: 1000 + p % 30),
        "wind_gusts_10m": each(lambda h: F.when(p % 3 != 0, p % 30 + h * 1.8 + d)),
    }
    good = F.to_json(F.struct(F.col("zone").alias("timezone"), F.struct(*[c.alias(n) for n, c in series.items()]).alias("hourly")))
    asked = rides.select(*weather.KEY, "zone").distinct().where(p % 17 != 5)
    newer = asked.select(*weather.KEY, F.when(p % 13 == 4, F.substring(good, 1, 60)).otherwise(good).alias("body"), F.lit(2.0).alias("fetched_at"), F.lit(False).alias("recent"))
    older = asked.where(p % 2 == 0).select(*weather.KEY, F.lit("{}").alias("body"), F.lit(1.0).alias("fetched_at"), F.lit(False).alias("recent"))
    w = weather.at_rides(rides, newer.union(older))
    total = F.aggregate(F.coalesce("wind_speed_hourly", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    return w.select(
        "o_orderkey", r6("temp_c"), r6("wind_speed_mps", "wind"), F.col("wind_dir_deg").alias("dir"), F.col("pressure_hpa").alias("pressure"), F.coalesce(r6("wind_sigma_mps"), F.lit(-1.0)).alias("sigma"),
        F.coalesce("ride_hour", F.lit(-1)).alias("ride_hour"), F.coalesce(F.size("wind_speed_hourly"), F.lit(0)).alias("n_pairs"), r6(total, "sum_pairs"), "source",
    )


def _service(places):
    """A made service: 900 m of relief, unknown places, calls that fail."""
    found = []
    for lat, lon in places:
        y, x = round(lat * 1e3), round((lon + 3) * 1e2)
        if (y + x) % 301 == 0:
            raise TimeoutError
        z = (y + 3 * x) % 900
        found.append(None if z % 10 == 9 else z)
    return found


@query("""WITH o AS (SELECT o_orderkey, 50000 + o_orderkey % 5000 y, o_custkey % 400 x FROM orders), u AS (SELECT DISTINCT y, x FROM o WHERE y % 3 <> 0), c AS (SELECT *, (row_number() OVER (PARTITION BY y % 4 ORDER BY y, x) - 1) // 90 chunk FROM u),
f AS (SELECT y, x, bool_or((y + x) % 301 = 0) OVER (PARTITION BY y % 4, chunk) failed FROM c)
SELECT o_orderkey, CASE WHEN o.y % 3 = 0 THEN 'cached' WHEN failed THEN 'failed' ELSE 'fetched' END state, CAST(coalesce(CASE WHEN o.y % 3 = 0 THEN CASE WHEN o.x % 10 <> 0 THEN 5 END WHEN failed OR (o.y + 3 * o.x) % 10 = 9 OR (o.y + 3 * o.x) % 900 > 700 THEN NULL ELSE (o.y + 3 * o.x) % 900 END, -1) AS DOUBLE) elev,
CASE WHEN o.y % 3 = 0 OR NOT failed THEN 'cached' ELSE 'failed' END state_again FROM o LEFT JOIN f ON o.y = f.y AND o.x = f.x""")
def point_elevation_chunks(spark, sf_dir):
    """Elevation of each order's place from a cache and, in chunks of 90 a call on four lanes, from a service that fails some calls; a second run asks for the failed chunks' places alone, and fails again."""
    y, x = F.lit(50000) + F.col("o_orderkey") % 5000, F.col("o_custkey") % 400
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (y / 1000).alias("lat"), (x / 100 - 3).alias("lon"))
    path = storage.new_path(spark, "elevation-cache")
    held = p.select(F.lit("dem").alias("dataset"), point_elevation.micro("lat").alias("lat_e6"), point_elevation.micro("lon").alias("lon_e6")).distinct().where(F.floor(F.col("lat_e6") / 1000) % 3 == 0)
    held.withColumn("elev", F.when(F.floor((F.col("lon_e6") + 3000000) / 10000) % 10 != 0, 5.0)).write.parquet(path)
    lane = F.floor(F.col("lat_e6") / 1000)
    how = {"lanes": 4, "lane": lane, "tries": 1, "interval": 0.0}
    first = point_elevation.sampled(p, path, "dem", _service, **how)
    again = point_elevation.sampled(p, path, "dem", lambda places: [None] * (len(places) - 1), **how)  # a short answer is no answer
    again = again.select("o_orderkey", F.col("elev_state").alias("state_again"))
    return first.select("o_orderkey", F.col("elev_state").alias("state"), F.coalesce("elev_point", F.lit(-1.0)).alias("elev")).join(again, "o_orderkey")
