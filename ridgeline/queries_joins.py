"""Registered queries: joins, selection, scalar functions and trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, r6
from .functions import checks
from .functions import geo as G
from .functions import physio as H
from .operators import folds, joins as J, selection as S
from .plans.views import points, rides
from .queries_time import P
from .queries_totals import R
from .schemas import C


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- joins

@query(R + "SELECT m.route_id, m.ride_id, f.ride_id ref_ride_id, round(m.trimp - f.trimp, 6) + 0.0E0 more_trimp FROM r m JOIN (SELECT route_id, min(ride_id) ride_id FROM r GROUP BY route_id) x ON m.route_id = x.route_id JOIN r f ON f.ride_id = x.ride_id")
def route_ref_members(spark, sf_dir):
    r = rides(spark, sf_dir)
    ref = r.groupBy("route_id").agg(F.min_by(F.struct("ride_id", "trimp"), "ride_id").alias("f"))
    return r.join(ref, "route_id").select("route_id", "ride_id", F.col("f.ride_id").alias("ref_ride_id"), r6(F.col("trimp") - F.col("f.trimp"), "more_trimp"))


@query("SELECT l_orderkey, l_linenumber, o_orderpriority label, round(l_extendedprice, 6) \"value\" FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'")
def records_left(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return _table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", F.col("o_orderpriority").alias("label"), r6("l_extendedprice", "value"))


def _second(tie: str) -> str:
    return P + f""", v AS (SELECT ride_id, CAST(round_even(t / 8, 0) AS BIGINT) s, {'max_by' if tie == 'last' else 'min_by'}(hr, t) hr2 FROM p WHERE hr IS NOT NULL GROUP BY ALL)
SELECT ride_id, idx, round(hr2, 6) hr2 FROM (SELECT ride_id, idx, CAST(round_even(t / 8, 0) AS BIGINT) s FROM p) LEFT JOIN v USING (ride_id, s)"""


def _rounded(spark, sf_dir, tie):
    p = points(spark, sf_dir).withColumn("t8", F.col("t") / 8)
    found = J.rounded_second(p.select("ride_id", "idx", "t8"), p.where("hr IS NOT NULL").withColumnRenamed("hr", "hr2"), "ride_id", "t8", "hr2", tie)
    return found.select("ride_id", "idx", r6("hr2"))


@query(_second("first"))
def rounded_second_first(spark, sf_dir):
    return _rounded(spark, sf_dir, "first")


@query(_second("last"))
def rounded_second_last(spark, sf_dir):
    return _rounded(spark, sf_dir, "last")


@query(P + """, h AS (SELECT ride_id, t, hr FROM p WHERE hr IS NOT NULL), q AS (SELECT ride_id, idx, t + 3.7E0 t FROM p),
j AS (SELECT q.*, a.t pt, a.hr ah, b.t bt, b.hr bh FROM q ASOF LEFT JOIN h a ON q.ride_id = a.ride_id AND q.t >= a.t ASOF LEFT JOIN h b ON q.ride_id = b.ride_id AND q.t <= b.t)
SELECT ride_id, idx, round(CASE WHEN bt IS NOT NULL AND (pt IS NULL OR bt - t <= t - pt) THEN CASE WHEN bt - t < 8 THEN bh END ELSE CASE WHEN t - pt < 8 THEN ah END END, 6) near_hr FROM j""")
def asof_nearest_8s(spark, sf_dir):
    p = points(spark, sf_dir)
    probes = p.select("ride_id", "idx", (F.col("t") + 3.7).alias("t"))
    return J.nearest_in_time(probes, p.where("hr IS NOT NULL"), "ride_id", "t", "hr", 8.0, "near_hr").select("ride_id", "idx", r6("near_hr"))


TAGS = """, g AS (SELECT ride_id, idx k, t t_start, t + 40.0E0 t_end, CASE (idx {div} 10) % 3 WHEN 0 THEN 'coast' WHEN 1 THEN 'pedal' ELSE 'brake' END label FROM p WHERE idx % 10 = 5)"""


def _tags(spark, sf_dir):
    kind = F.floor(F.col("idx") / 10) % 3
    return points(spark, sf_dir).where("idx % 10 = 5").select("ride_id", F.col("idx").alias("k"), F.col("t").alias("t_start"), (F.col("t") + 40.0).alias("t_end"), F.when(kind == 0, "coast").when(kind == 1, "pedal").otherwise("brake").alias("label"))


@query(P + TAGS.format(div="//") + " SELECT p.ride_id, p.idx, max_by(label, k) tag FROM p LEFT JOIN g ON p.ride_id = g.ride_id AND p.t >= t_start AND p.t <= t_end GROUP BY p.ride_id, p.idx")
def interval_tag_overwrite(spark, sf_dir):
    return J.in_intervals(points(spark, sf_dir).select("ride_id", "idx", "t"), _tags(spark, sf_dir), "ride_id", "t", "t_start", "t_end", "label", "k", "tag").select("ride_id", "idx", "tag")


@query(P + TAGS.format(div="//") + ", d AS (SELECT ride_id, k, t_start + (k % 4) t_start, t_end - (k % 3) t_end FROM g) SELECT d.ride_id, d.k, min_by(label, g.k) tag FROM d LEFT JOIN g ON d.ride_id = g.ride_id AND abs(d.t_start - g.t_start) <= 2.0 AND abs(d.t_end - g.t_end) <= 2.0 GROUP BY d.ride_id, d.k")
def band_match_2s(spark, sf_dir):
    tags = _tags(spark, sf_dir)
    runs = tags.select("ride_id", F.col("k").alias("run"), (F.col("t_start") + F.col("k") % 4).alias("t_start"), (F.col("t_end") - F.col("k") % 3).alias("t_end"))
    return J.in_band(runs, tags, "ride_id", ["t_start", "t_end"], 2.0, "label", "k", "tag").select("ride_id", F.col("run").alias("k"), "tag")


_ROADS = ", w AS (SELECT c_custkey seg, 52.0E0 + 2.5E-4 * (c_custkey % 200) lat1, -1.5E0 + 1.0E-4 * (c_custkey % 41) lon1, 52.0E0 + 2.5E-4 * (c_custkey % 200) + 1.0E-4 lat2, -1.5E0 + 1.0E-4 * (c_custkey % 41) + 2.0E-4 lon2 FROM customer)"


def _roads(spark, sf_dir):
    k = F.col("c_custkey")
    lat, lon = 52.0 + 2.5e-4 * (k % 200), -1.5 + 1.0e-4 * (k % 41)
    return _table(spark, sf_dir, "customer").select(k.alias("seg"), lat.alias("lat1"), lon.alias("lon1"), (lat + 1.0e-4).alias("lat2"), (lon + 2.0e-4).alias("lon2"))


_M = "111320.0E0"
_SEGMENT = f""", x AS (SELECT ride_id, idx, seg, (lon1 - lon) * {_M} * cos(radians(lat)) ax, (lat1 - lat) * {_M} ay, (lon2 - lon) * {_M} * cos(radians(lat)) bx, (lat2 - lat) * {_M} "by" FROM p JOIN w ON abs(lat - lat1) < 0.001 AND abs(lon - lon1) < 0.002),
y AS (SELECT *, bx - ax dx, "by" - ay dy FROM x), z AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest(-(ax * dx + ay * dy) / (dx * dx + dy * dy), 0.0E0), 1.0E0) ELSE 0.0E0 END s FROM y),
m AS (SELECT ride_id, idx, seg, sqrt(pow(ax + s * dx, 2) + pow(ay + s * dy, 2)) metres FROM z)"""


@query(P + _ROADS + _SEGMENT + ", b AS (SELECT ride_id, idx, min(metres) metres, arg_min(seg, (round(metres, 9), seg)) seg FROM m WHERE metres <= 30 GROUP BY ALL) SELECT ride_id, idx, round(b.metres, 5) metres FROM p LEFT JOIN b USING (ride_id, idx)")
def nn_segment_30m(spark, sf_dir):
    found = J.nearest_segment(points(spark, sf_dir).select("ride_id", "idx", "lat", "lon"), _roads(spark, sf_dir), ["ride_id", "idx"], "lat", "lon")
    return found.select("ride_id", "idx", F.round("metres", 5).alias("metres"))


@query(P + _ROADS + _SEGMENT + ", b AS (SELECT ride_id, idx, min(metres) metres FROM m WHERE metres <= 30 GROUP BY ALL) SELECT ride_id, round(avg(CASE WHEN b.metres IS NULL THEN 0.0E0 ELSE 1.0E0 END), 6) ratio, count(b.metres) snapped FROM p LEFT JOIN b USING (ride_id, idx) GROUP BY ride_id")
def map_match_ratio(spark, sf_dir):
    found = J.nearest_segment(points(spark, sf_dir).select("ride_id", "idx", "lat", "lon"), _roads(spark, sf_dir), ["ride_id", "idx"], "lat", "lon")
    return J.match_ratio(found, "ride_id", "metres").select("ride_id", r6("ratio"), "snapped")


@query(P + ", b AS (SELECT ride_id, min(lat) south, min(lon) west, max(lat) north, max(lon) east FROM p GROUP BY ride_id) SELECT a.ride_id a, b.ride_id b FROM b a JOIN b ON a.ride_id < b.ride_id AND a.south - 0.001 <= b.north + 0.001 AND b.south - 0.001 <= a.north + 0.001 AND a.west - 0.001 <= b.east + 0.001 AND b.west - 0.001 <= a.east + 0.001")
def bbox_overlap_pairs(spark, sf_dir):
    boxes = points(spark, sf_dir).groupBy("ride_id").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
    return J.overlapping_boxes(boxes, "ride_id", 0.001)


@query("""WITH w AS (SELECT l_orderkey way, l_linenumber p, l_suppkey node FROM lineitem), n AS (SELECT s_suppkey node, s_acctbal lat, s_nationkey * 1.0E0 lon FROM supplier WHERE s_suppkey % 5 <> 0),
j AS (SELECT way, p, node, lat, lon FROM w JOIN n USING (node)), s AS (SELECT way, CAST(row_number() OVER v - 1 AS INTEGER) k, lat lat1, lon lon1, lead(lat) OVER v lat2, lead(lon) OVER v lon2 FROM j WINDOW v AS (PARTITION BY way ORDER BY p, node)) SELECT * FROM s WHERE lat2 IS NOT NULL""")
def way_segments(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    ways = items.select(F.col("l_orderkey").alias("way"), F.col("x.l_suppkey").alias("nodes"))
    nodes = _table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("lat"), F.col("s_nationkey").cast("double").alias("lon"))
    return J.way_segments(ways, nodes)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%')")
def anti_missing_cache(spark, sf_dir):
    cached = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing(_table(spark, sf_dir, "customer").select("c_custkey"), cached, ["c_custkey"])


@query(R + ", a AS (SELECT CAST(floor(day) AS BIGINT) d, count(*) n FROM r WHERE has_hr GROUP BY ALL), b AS (SELECT CAST(floor(day) AS BIGINT) d, count(*) m FROM r WHERE NOT has_hr AND route_id % 3 = 0 GROUP BY ALL) SELECT coalesce(a.d, b.d) d, coalesce(n, 0) n, coalesce(m, 0) m FROM a FULL JOIN b ON a.d = b.d")
def full_outer_dates(spark, sf_dir):
    r = rides(spark, sf_dir).withColumn("d", F.floor("day").cast("long"))
    a = r.where("has_hr").groupBy("d").agg(F.count("*").alias("n"))
    b = r.where("NOT has_hr AND route_id % 3 = 0").groupBy("d").agg(F.count("*").alias("m"))
    return a.join(b, "d", "full").select("d", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


@query("SELECT c_custkey, round(c_acctbal / (SELECT max(s_acctbal) FROM supplier), 6) share FROM customer")
def cross_profile(spark, sf_dir):
    top = _table(spark, sf_dir, "supplier").agg(F.max("s_acctbal").alias("top"))
    return J.with_singleton(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), top).select("c_custkey", r6(F.col("c_acctbal") / F.col("top"), "share"))


@query("SELECT e.vec_id, round(min(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))), 5) novelty FROM embeddings e, (SELECT embedding FROM embeddings WHERE label = 0) x GROUP BY e.vec_id")
def nearest_labelled_example(spark, sf_dir):
    """All rows of a label are examples."""
    e = _table(spark, sf_dir, "embeddings")
    return J.nearest_example(e, e.where("label = 0"), "embedding", None, "novelty").select("vec_id", F.round("novelty", 5).alias("novelty"))


# --- selection

@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def latest_authoritative(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return S.first_in(o, "o_custkey", (F.col("o_orderstatus") == "F").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey")


@query(R + "SELECT ride_id, round(day, 6) AS day FROM r ORDER BY r.day DESC, ride_id DESC LIMIT 5")
def last_k(spark, sf_dir):
    return rides(spark, sf_dir).orderBy(F.desc("day"), F.desc("ride_id")).limit(5).select("ride_id", r6("day"))


@query(P + ", n AS (SELECT ride_id, idx, greatest(count(*) OVER (PARTITION BY ride_id) // 20, 1) step FROM p) SELECT ride_id, idx FROM n WHERE idx % step = 0")
def stride_sample(spark, sf_dir):
    return S.stride(points(spark, sf_dir), "ride_id", "idx", 20).select("ride_id", "idx")


@query(P + """, e AS (SELECT ride_id, min(t) lo, max(t) hi FROM p GROUP BY ride_id), b AS (SELECT p.ride_id, t, watts, coalesce(least(CAST(floor((t - lo) / nullif(hi - lo, 0) * 15) AS BIGINT), 14), 0) b FROM p JOIN e USING (ride_id)),
x AS (SELECT ride_id, arg_min(t, (watts, t)) t FROM b GROUP BY ride_id, b UNION SELECT ride_id, arg_max(t, (watts, -t)) FROM b GROUP BY ride_id, b UNION SELECT ride_id, min(t) FROM p GROUP BY 1 UNION SELECT ride_id, max(t) FROM p GROUP BY 1)
SELECT ride_id, round(t, 6) t, round(watts, 6) watts FROM x JOIN p USING (ride_id, t)""")
def minmax_decimate(spark, sf_dir):
    return S.decimate(points(spark, sf_dir), "ride_id", "t", "watts", 15).select("ride_id", r6("t"), r6("watts"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_brand), 'brand#1') ORDER BY p_size DESC, p_partkey LIMIT 50")
def search_sort(spark, sf_dir):
    return _table(spark, sf_dir, "part").where(F.lower("p_brand").contains("brand#1")).orderBy(F.desc("p_size"), "p_partkey").limit(50).select("p_partkey", "p_name", "p_size")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus = 'O' DESC, o_orderdate, o_orderkey LIMIT 100")
def review_first(spark, sf_dir):
    return _table(spark, sf_dir, "orders").orderBy((F.col("o_orderstatus") == "O").desc(), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus")


@query("WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%') SELECT o_orderkey FROM s UNION ALL (SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority LIKE '1%') ORDER BY o_orderkey DESC LIMIT greatest(200 - (SELECT count(*) FROM s), 0))")
def retain_200(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return S.retained(o, F.col("o_orderkey"), (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1"), 200).select("o_orderkey")


@query("SELECT sha256(text) file_hash, min(doc_id) doc_id, count(*) copies FROM documents GROUP BY 1")
def dedup_sha256(spark, sf_dir):
    return S.by_content(_table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def collapse_batches(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return S.first_in(o, ["o_custkey", "o_orderpriority"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT 'customer' message_type, c_acctbal acctbal, c_custkey id, c_mktsegment segment, NULL::DOUBLE size FROM customer UNION ALL SELECT 'part', NULL, p_partkey, NULL, CAST(p_size AS DOUBLE) FROM part UNION ALL SELECT 'supplier', s_acctbal, s_suppkey, NULL, NULL FROM supplier")
def union_headers(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.lit("customer").alias("message_type"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    p = _table(spark, sf_dir, "part").select(F.lit("part").alias("message_type"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"))
    s = _table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("message_type"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))
    return S.union_all(c, p, s)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf_dir):
    gone = _table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return S.without_cascade({"orders": _table(spark, sf_dir, "orders")}, "o_custkey", gone)["orders"].select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return S.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


# --- scalar functions

def _metres(p, roads):
    found = J.segments_around(p.select("ride_id", "idx", "lat", "lon"), roads, "lat", "lon", 0.001, 0.002)
    return found.select("ride_id", "idx", "seg", F.round(G.point_to_segment("lat", "lon", "lat1", "lon1", "lat2", "lon2"), 5).alias("metres"))


@query(P + _ROADS + _SEGMENT + " SELECT ride_id, idx, seg, round(metres, 5) metres FROM m")
def point_to_segment_all(spark, sf_dir):
    """Every sample and every segment that meet in a grid cell."""
    return _metres(points(spark, sf_dir), _roads(spark, sf_dir))


@query(P + "SELECT ride_id, idx, round((lon + 180) / 360 * 16384, 6) x, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793E0) / 2 * 16384, 6) y FROM p")
def slippy_tile(spark, sf_dir):
    x, y = G.slippy_tile("lat", "lon")
    return points(spark, sf_dir).select("ride_id", "idx", r6(x, "x"), r6(y, "y"))


@query(P + "SELECT ride_id, idx, round(101300.0E0 * pow(1 - 0.0065E0 * greatest(elev, 0) / 288.15E0, 5.2559E0) / (287.05E0 * 288.15E0), 6) rho FROM p")
def air_density(spark, sf_dir):
    return points(spark, sf_dir).select("ride_id", "idx", r6(G.air_density(15.0, 1013.0, "elev"), "rho"))


_POWER = """, f AS (SELECT *, atan(least(greatest(grade, -1.0E0), 1.0E0)) a FROM p),
w AS (SELECT *, 0.005E0 * 86 * 9.80665E0 * cos(a) * speed roll, 0.5E0 * 1.225E0 * 0.35E0 * sqrt((speed + 1) * (speed + 1) + 0.25E0) * (speed + 1) * speed aero, 86.0E0 * 9.80665E0 * sin(a) * speed grav FROM f),
v AS (SELECT *, CASE WHEN roll + aero + grav > 0 THEN (roll + aero + grav) / 0.97E0 ELSE roll + aero + grav END w2 FROM w)"""


def _power(spark, sf_dir):
    return points(spark, sf_dir), H.power("speed", 0.0, "grade", 1.225, 86.0, headwind=1.0, crosswind=0.5)


@query(P + _POWER + " SELECT ride_id, idx, round(w2, 6) + 0.0E0 watts FROM v")
def power_model(spark, sf_dir):
    p, parts = _power(spark, sf_dir)
    return p.select("ride_id", "idx", r6(parts["watts"], "watts"))


@query(P + _POWER + " SELECT ride_id, idx, mode, CASE WHEN abs(w2) > 1E-9 THEN CASE WHEN abs(grav) / abs(w2) >= 0.5 THEN 'high' WHEN abs(grav) / abs(w2) >= 0.2 THEN 'med' ELSE 'low' END ELSE 'low' END confidence FROM v")
def confidence_mode(spark, sf_dir):
    p, parts = _power(spark, sf_dir)
    return p.select("ride_id", "idx", H.mode("grade", "speed").alias("mode"), H.confidence(parts["gravity"], parts["watts"]).alias("confidence"))


@query("WITH m AS (SELECT c_custkey, greatest(120.0E0, 220.0E0 - (18 + c_custkey % 70)) m FROM customer) SELECT c_custkey, k zone, CAST(round_even(55 + (m - 55) * (0.5E0 + 0.1E0 * k), 0) AS INTEGER) lo, CAST(round_even(55 + (m - 55) * (0.5E0 + 0.1E0 * (k + 1)), 0) AS INTEGER) hi FROM m, (SELECT CAST(range AS INTEGER) k FROM range(5))")
def hr_zones(spark, sf_dir):
    age = 18 + F.col("c_custkey") % 70
    zones = H.hr_zones(H.default_max_hr(age), F.lit(55.0))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(zones).alias("zone", "z")).select("c_custkey", "zone", "z.lo", "z.hi")


@query(P + "SELECT ride_id, idx, CASE WHEN hr IS NULL THEN 'ask' WHEN s >= 0.9 THEN 'coast' WHEN s <= 0.1 THEN 'pedal' ELSE 'ask' END label FROM (SELECT *, 1 / (1 + exp(-least(greatest(16.0E0 - 0.12E0 * hr, -40.0E0), 40.0E0))) s FROM p)")
def logistic_label(spark, sf_dir):
    score = H.logistic(16.0 - 0.12 * F.col("hr"))
    return points(spark, sf_dir).select("ride_id", "idx", H.coast_label(score, F.col("hr").isNotNull()).alias("label"))


@query(P + "SELECT ride_id, idx, CAST(round_even((elev + 500) * 5, 0) AS BIGINT) code, round(CAST(round_even((elev + 500) * 5, 0) AS BIGINT) / 5.0E0 - 500, 6) elev FROM p")
def alt_encode_decode(spark, sf_dir):
    return points(spark, sf_dir).select("ride_id", "idx", H.altitude_code("elev").alias("code"), r6(H.altitude_of(H.altitude_code("elev")), "elev"))


@query("SELECT page_id, left(regexp_replace(trim(regexp_replace(regexp_replace(url, '.*[/\\\\]', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '.'), '^$', 'upload'), 120) AS name FROM pages")
def sanitize_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", checks.file_name("url").alias("name"))


@query("SELECT event_id, CAST(hour(ts + INTERVAL 1 HOUR) AS INTEGER) local_hour, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') local_day FROM events")
def local_hour_pick(spark, sf_dir):
    local = checks.local_time("ts", "+01:00")
    return _table(spark, sf_dir, "events").select("event_id", F.hour(local).alias("local_hour"), F.date_format(local, "yyyy-MM-dd").alias("local_day"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events")
def nested_property(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", checks.first_of("props", ["$.k"]).cast("long").alias("k"))


@query(R + "SELECT ride_id, unnest(['trimp', 'distance_m']) metric, round(unnest([trimp, distance_m]), 6) \"value\" FROM r")
def unpivot_curve(spark, sf_dir):
    return S.unpivoted(rides(spark, sf_dir), "ride_id", ["trimp", "distance_m"]).select("ride_id", "metric", r6("value"))


@query(R + "SELECT route_id, count(*) FILTER (filename LIKE '1%') urgent, count(*) FILTER (filename LIKE '2%') high, count(*) FILTER (filename LIKE '5%') low FROM r GROUP BY route_id")
def pivot_series(spark, sf_dir):
    kind = F.substring("filename", 1, 1).alias("kind")
    wide = rides(spark, sf_dir).select("route_id", kind).groupBy("route_id").pivot("kind", ["1", "2", "5"]).count()
    return wide.select("route_id", *[F.coalesce(F.col(k), F.lit(0)).alias(n) for k, n in (("1", "urgent"), ("2", "high"), ("5", "low"))])


@query(P + "SELECT ride_id, idx, CASE WHEN watts BETWEEN -200 AND 5000 AND (NOT (lat BETWEEN 49.5 AND 61.0 AND lon BETWEEN -8.7 AND 2.1) OR watts <= 100) THEN round(watts, 6) END elev FROM p")
def plausible_elevation(spark, sf_dir):
    return points(spark, sf_dir).select("ride_id", "idx", r6(G.plausible_elevation("watts", "lat", "lon", uk_high=100.0), "elev"))


# --- trends

@query(R + f""", s AS (SELECT a.route_id, a.ride_id, a.day, a.trimp, b.day bd, b.ride_id bi, b.trimp bt FROM r a JOIN r b ON a.route_id = b.route_id AND (b.day < a.day OR (b.day = a.day AND b.ride_id <= a.ride_id))),
c AS (SELECT route_id, ride_id, sum(bt * (1 - exp(-1 / 42.0E0)) * exp((bd - day) / 42)) ctl, sum(bt * (1 - exp(-1 / 7.0E0)) * exp((bd - day) / 7)) atl, any_value(trimp) x FROM s GROUP BY ALL)
SELECT route_id, ride_id, round(ctl, 6) ctl, round(atl, 6) atl, round((ctl - x * (1 - exp(-1 / 42.0E0))) - (atl - x * (1 - exp(-1 / 7.0E0))), 6) + 0.0E0 tsb FROM c""")
def ctl_atl_tsb(spark, sf_dir):
    return folds.training_load(rides(spark, sf_dir), "route_id", "day", "ride_id", "trimp").select("route_id", "ride_id", r6("ctl"), r6("atl"), r6("tsb"))


@query(P + ", f AS (SELECT ride_id, regr_slope(watts, hr) m, regr_intercept(watts, hr) c, regr_r2(watts, hr) r2, count(*) FILTER (hr IS NOT NULL) n FROM p GROUP BY ride_id) SELECT ride_id, CAST(h AS INTEGER) hr, round(m * h + c, 6) + 0.0E0 watts, CASE WHEN r2 >= 0.5 THEN 'confident' ELSE 'context' END quality FROM f, unnest([130, 140, 150, 160]) u(h) WHERE n >= 20")
def watts_hr_trend(spark, sf_dir):
    fit = points(spark, sf_dir).groupBy("ride_id").agg(F.regr_slope("watts", "hr").alias("m"), F.regr_intercept("watts", "hr").alias("c"), F.regr_r2("watts", "hr").alias("r2"), F.count("hr").alias("n")).where("n >= 20")
    grid = fit.withColumn("hr", F.explode(F.array(*[F.lit(h) for h in C.hr_grid])))
    return grid.select("ride_id", "hr", r6(F.col("m") * F.col("hr") + F.col("c"), "watts"), F.when(F.col("r2") >= 0.5, "confident").otherwise("context").alias("quality"))


@query(R + "SELECT route_id, ride_id, round(distance_m, 6) distance_m, CAST(row_number() OVER w AS INTEGER) place, count(*) OVER (PARTITION BY route_id) n, round(trimp - lag(trimp) OVER w, 6) + 0.0E0 change FROM r WINDOW w AS (PARTITION BY route_id ORDER BY day, ride_id)")
def power_trend(spark, sf_dir):
    w = Window.partitionBy("route_id").orderBy("day", "ride_id")
    return rides(spark, sf_dir).select("route_id", "ride_id", r6("distance_m"), F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy("route_id")).alias("n"), r6(F.col("trimp") - F.lag("trimp").over(w), "change"))


@query(P + ", b AS (SELECT ride_id, idx // 15 block, regr_slope(hr, t) * 3600 d, regr_r2(hr, t) r2, count(hr) n FROM p WHERE hr IS NOT NULL GROUP BY ALL HAVING count(hr) >= 5) SELECT ride_id, block, round(d, 4) + 0.0E0 drift, round(r2, 6) r2, n FROM b")
def drift_trend(spark, sf_dir):
    b = points(spark, sf_dir).where("hr IS NOT NULL").withColumn("block", F.floor(F.col("idx") / 15)).groupBy("ride_id", "block").agg(F.regr_slope("hr", "t").alias("s"), F.regr_r2("hr", "t").alias("r2"), F.count("hr").alias("n")).where("n >= 5")
    return b.select("ride_id", "block", (F.round(F.col("s") * 3600, 4) + F.lit(0.0)).alias("drift"), r6("r2"), "n")


@query()
def despike_limiter(spark, sf_dir):
    """A true recurrence: compared with a brute-force version in the tests."""
    return folds.limited_jumps(points(spark, sf_dir), "ride_id", "idx", "watts").select("ride_id", "idx", r6("steady"))


@query()
def best_drift_window(spark, sf_dir):
    """The rule depends on the order of windows: compared with a brute-force version in the tests."""
    b = points(spark, sf_dir).where("hr IS NOT NULL").withColumn("block", F.floor(F.col("idx") / 15)).groupBy("ride_id", "block").agg((F.regr_slope("hr", "t") * 3600).alias("drift"), F.count("hr").alias("n")).where("n >= 5")
    return folds.best_of_windows(b, "ride_id", "block", "drift", "n").select("ride_id", "block", F.round("drift", 4).alias("drift"), "n")
