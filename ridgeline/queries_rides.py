"""Registered queries: efforts, descents, calibration gates, checks, ride documents and weather."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, r6
from .functions import checks
from .functions import physio as H
from .operators import aggregates, efforts, joins, selection
from .operators import frames as W
from .plans.views import EFFORTS_SQL, RIDES_SQL, TAGGED_SQL, rides, tagged
from .plans.views import efforts as effort_view
from .queries_time import BY, P, _hav, points
from .schemas import C

E = f"WITH p AS ({EFFORTS_SQL})\n"
T = f"WITH p AS ({TAGGED_SQL})\n"
R = f"WITH r AS ({RIDES_SQL})\n"
MAX_HR = 180.0


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- cardiac drift

_STEADY = f"""a AS (SELECT *, coalesce((t - lag(t) OVER w) * (watts + lag(watts) OVER w) / 2, 0.0E0) area FROM p WINDOW w AS ({BY} t)),
c AS (SELECT *, sum(area) OVER ({BY} t ROWS UNBOUNDED PRECEDING) cum FROM a),
m AS (SELECT *, CASE WHEN last_value(t) OVER w > first_value(t) OVER w THEN (last_value(cum) OVER w - first_value(cum) OVER w) / (last_value(t) OVER w - first_value(t) OVER w) ELSE watts END smooth, t - min(t) OVER (PARTITION BY ride_id) since
FROM c WINDOW w AS ({BY} t RANGE BETWEEN 30.0E0 PRECEDING AND 30.0E0 FOLLOWING)),
k AS (SELECT *, coalesce(since >= 240 AND mode = 'pedal' AND smooth >= 60 AND hr BETWEEN 100 AND 0.94E0 * {MAX_HR}, false) ready FROM m),
l AS (SELECT *, last_value(CASE WHEN ready THEN t END IGNORE NULLS) OVER ({BY} t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before, lag(ready) OVER ({BY} t) was FROM k),
n AS (SELECT *, sum(CASE WHEN ready AND NOT coalesce(was, false) AND (before IS NULL OR t - before > 90) THEN 1 ELSE 0 END) OVER ({BY} t ROWS UNBOUNDED PRECEDING) block FROM l),
b AS (SELECT *, hr_ + slope * (lo - mid) start FROM (SELECT ride_id, block, count(*) n_points, min(t) lo, max(t) hi, min(since) since, avg(smooth) power, avg(hr) hr_, stddev_pop(smooth) / greatest(avg(smooth), 1e-9) cvp, stddev_pop(speed) / greatest(avg(speed), 1e-9) cvs,
regr_slope(hr, t) slope, avg(t) mid, regr_sxy(hr, t) sxy, regr_syy(hr, t) syy, count(*) OVER (PARTITION BY ride_id) n_windows FROM n WHERE ready GROUP BY ride_id, block))"""


@query(E + ", " + _STEADY + """, g AS (SELECT ride_id, {'block': block, 'drift_bpm_per_hr': round(slope * 3600, 1), 'drift_pct_per_hr': round(100 * slope * 3600 / start, 1), 'duration_min': round((hi - lo) / 60, 1), 'start_min': round(since / 60, 1),
'mean_power': round(power, 0), 'mean_hr': round(hr_, 0), 'start_hr': round(start, 0), 'end_hr': round(start + slope * (hi - lo), 0), 'r2': round(1 - (syy - slope * sxy) / CASE WHEN syy = 0 THEN 1e-9 ELSE syy END, 3), 'n_points': n_points, 'n_windows': n_windows} w, block
FROM b WHERE hi - lo >= 480 AND n_points >= 2 AND cvp <= 0.25 AND cvs <= 0.35 AND start > 0),
f AS (SELECT ride_id, list_reduce(list(w ORDER BY block), lambda s, e: CASE WHEN abs(e.drift_bpm_per_hr) - abs(s.drift_bpm_per_hr) > 0.5 OR (abs(e.drift_bpm_per_hr) - abs(s.drift_bpm_per_hr) <= 0.5 AND e.n_points > s.n_points) THEN e ELSE s END) w FROM g GROUP BY ride_id)
SELECT ride_id, w.drift_bpm_per_hr, w.drift_pct_per_hr, w.duration_min, w.start_min, w.mean_power, w.mean_hr, w.start_hr, w.end_hr, w.r2, w.n_points, w.n_windows FROM f""")
def cardiac_drift(spark, sf_dir):
    return efforts.cardiac_drift(effort_view(spark, sf_dir), max_hr=MAX_HR)


@query(E + ", " + _STEADY + " SELECT ride_id, CAST(block AS BIGINT) block, n_points, round(lo, 6) t_start, round(hi, 6) t_end, round(since, 6) warm_s FROM b")
def steady_blocks(spark, sf_dir):
    rows = efforts.steady_blocks(effort_view(spark, sf_dir), "ride_id", "t", "hr", "watts", "mode", F.lit(MAX_HR))
    return rows.groupBy("ride_id", "block").agg(F.count("*").alias("n_points"), r6(F.min("t"), "t_start"), r6(F.max("t"), "t_end"), r6(F.min("_since"), "warm_s"))


# --- descents

_DOWN = "grade < -0.01 AND speed > 2"


def _runs(on: str, more: str = "") -> str:
    """Runs of a condition, numbered from 1."""
    return f"""s AS (SELECT *, coalesce({on}, false) ok FROM p), q AS (SELECT *, lag(ok) OVER ({BY} idx) was FROM s),
i AS (SELECT * FROM (SELECT *, sum(CASE WHEN ok AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER ({BY} idx ROWS UNBOUNDED PRECEDING) island FROM q) WHERE ok){more}"""


_COAST = f"CASE WHEN label = 'coast' THEN {_DOWN} WHEN label IN ('pedal', 'brake') THEN false ELSE {_DOWN} AND (hr IS NULL OR hr < 0.78 * 225) END"


@query(T + ", " + _runs(_COAST) + " SELECT ride_id, CAST(island AS BIGINT) island, count(*) n_points, round(min(t), 6) t_start, round(max(t), 6) t_end FROM i GROUP BY ride_id, island HAVING count(*) >= 10")
def coast_runs_tagged(spark, sf_dir):
    from .operators.islands import segments

    found = segments(tagged(spark, sf_dir), "ride_id", "idx", "t", efforts.is_coasting("grade", "speed", "hr", "label", 225.0), 10)
    return found.select("ride_id", "island", "n_points", r6("t_start"), r6("t_end"))


def _features(keys: str, table: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY t)"
    return f"""x AS (SELECT *, CASE WHEN t > lag(t) OVER {w} THEN (speed - lag(speed) OVER {w}) / (t - lag(t) OVER {w}) END a FROM {table}),
f AS (SELECT {keys}, count(*) n, avg(hr) mean_hr, avg(CASE WHEN hr IS NULL THEN NULL WHEN hr < 0.78E0 * {MAX_HR} THEN 1.0E0 ELSE 0.0E0 END) low, regr_slope(hr, t) slope, stddev_pop(a) sd, count(hr) n_hr, max(t) FILTER (hr IS NOT NULL) - min(t) FILTER (hr IS NOT NULL) span, min(t) t_start, max(t) t_end,
bool_or(label IN ('pedal', 'brake')) veto, bool_or(label = 'coast') tag FROM x GROUP BY {keys})"""


@query(T + ", " + _runs(_DOWN) + ", " + _features("ride_id, island", "i") + f""", z AS (SELECT *, 16.356E0 * (0.78E0 - mean_hr / {MAX_HR}) + 0.8E0 * CASE WHEN n_hr >= 3 AND span > 30 THEN least(greatest(-6.0E0 * slope, -1.0E0), 1.0E0) ELSE 0.0E0 END - 0.8E0 * coalesce(sd / 0.3E0, 0.0E0) + low - 1.636E0 z FROM f WHERE n >= 10)
SELECT ride_id, CAST(island AS BIGINT) island, n, round(t_start, 6) t_start, round(t_end, 6) t_end, CASE WHEN coalesce(tag, false) THEN 'manual' ELSE 'auto' END source FROM z WHERE NOT coalesce(veto, false) AND (coalesce(tag, false) OR coalesce(mean_hr IS NOT NULL AND 1 / (1 + exp(-least(greatest(z, -40.0E0), 40.0E0))) >= 0.9, false))""")
def effective_coasts(spark, sf_dir):
    found = efforts.effective_coasts(tagged(spark, sf_dir), "ride_id", "idx", "t", "grade", "speed", "hr", "label", MAX_HR)
    return found.select("ride_id", "island", "n", r6("t_start"), r6("t_end"), "source")


_TAGS = "tags AS (SELECT ride_id, k, min(t) + 0.2E0 t_start, min(t) + 5.0E0 + 7.0E0 * k t_end, CASE k % 3 WHEN 0 THEN 'coast' WHEN 1 THEN 'pedal' ELSE 'other' END label FROM p, unnest(range(12)) u(k) GROUP BY ride_id, k)"


def _tags(spark, sf_dir):
    """Twelve tags a ride, longer and longer."""
    first = points(spark, sf_dir).groupBy("ride_id").agg(F.min("t").alias("t0")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return first.select("ride_id", "k", (F.col("t0") + 0.2).alias("t_start"), (F.col("t0") + 5.0 + 7.0 * F.col("k")).alias("t_end"), F.when(F.col("k") % 3 == 0, "coast").when(F.col("k") % 3 == 1, "pedal").otherwise("other").alias("label"))


@query(P + ", " + _TAGS + ", j AS (SELECT p.*, k, tags.label FROM p JOIN tags ON p.ride_id = tags.ride_id AND t BETWEEN t_start AND t_end WHERE tags.label IN ('coast', 'pedal')), " + _features("ride_id, k, label", "j") + " SELECT ride_id, k, CASE WHEN label = 'coast' THEN 1 ELSE 0 END y, n, round(mean_hr, 6) mean_hr, round(low, 6) low_share, round(sd, 6) accel_sd FROM f WHERE n >= 10 AND mean_hr IS NOT NULL")
def training_examples(spark, sf_dir):
    found = efforts.training_examples(points(spark, sf_dir), _tags(spark, sf_dir), "ride_id", "t", "hr", "speed", MAX_HR)
    return found.select("ride_id", "k", "y", "n", r6("mean_hr"), r6("low_share"), r6("accel_sd"))


_FORCES = "atan(least(greatest(grade, -1.0E0), 1.0E0))"


@query(P + ", " + _runs("grade > 0.03") + f""", e AS (SELECT *, (0.5E0 * 1.2E0 * 0.35E0 * speed * speed + 86 * 9.80665E0 * sin({_FORCES})) * speed known, 86 * 9.80665E0 * cos({_FORCES}) * speed mult FROM i),
h AS (SELECT *, lead(t) OVER w - t dt, lead(watts) OVER w w2, lead(known) OVER w k2, lead(mult) OVER w m2, lead(dist) OVER w - dist dd, lead(elev) OVER w - elev dz FROM e WINDOW w AS (PARTITION BY ride_id, island ORDER BY idx)),
g AS (SELECT ride_id, island, count(*) n, sum(coalesce(dt * (watts + w2) / 2, 0.0E0)) sw, sum(coalesce(dt * (known + k2) / 2, 0.0E0)) sk, sum(coalesce(dt * (mult + m2) / 2, 0.0E0)) sm, sum(greatest(coalesce(dd, 0.0E0), 0.0E0)) d, sum(greatest(coalesce(dz, 0.0E0), 0.0E0)) z FROM h GROUP BY ride_id, island),
c AS (SELECT ride_id, n, (0.97E0 * sw - sk) / sm crr FROM g WHERE n >= 10 AND d > 50 AND z > 1 AND sw > 0 AND sm > 0), o AS (SELECT ride_id, median(crr) med, count(*) n_segments, CAST(sum(n) AS BIGINT) n_points FROM c GROUP BY ride_id)
SELECT ride_id, round(any_value(med), 6) + 0.0E0 crr, round(1.4826E0 * median(abs(crr - med)), 6) + 0.0E0 crr_sigma, any_value(n_segments) n_segments, any_value(n_points) n_points FROM c JOIN o USING (ride_id) GROUP BY ride_id""")
def climb_diagnostic(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("accel", F.lit(0.0))
    found = efforts.climb_diagnostic(p, "ride_id", "idx", "t", "grade", "speed", "elev", "dist", "watts", "accel", 1.2, 86.0)
    return found.select("ride_id", r6("crr"), r6("crr_sigma"), "n_segments", "n_points")


_FITS = "fits AS (SELECT ride_id, CASE ride_id % 4 WHEN 0 THEN 'loop' WHEN 1 THEN 'pooled' WHEN 2 THEN 'climb' ELSE 'guess' END kind, (ride_id % 13) / 1000.0E0 crr, 0.15E0 + (ride_id % 11) / 20.0E0 cda, CASE WHEN ride_id % 17 = 0 THEN NULL ELSE (ride_id % 10) / 10.0E0 + 0.05E0 END r2, ride_id % 6 n_segments, ride_id % 5 n_rides FROM r)"


@query(R + ", " + _FITS + """ SELECT ride_id, coalesce(CASE kind WHEN 'climb' THEN n_segments >= 2 AND crr BETWEEN 0.0005E0 AND 0.05E0 WHEN 'guess' THEN false
ELSE coalesce(r2, 0) > 0.6 AND n_segments >= 3 AND crr BETWEEN 0.002E0 AND 0.01E0 AND cda BETWEEN 0.2E0 AND 0.55E0 AND (kind = 'loop' OR n_rides >= 2) END, false) ok FROM fits""")
def acceptable_fits(spark, sf_dir):
    n = F.col("ride_id")
    kind = F.element_at(F.array(F.lit("loop"), F.lit("pooled"), F.lit("climb"), F.lit("guess")), (n % 4 + 1).cast("int"))
    ok = efforts.acceptable(kind, (n % 13) / 1000.0, 0.15 + (n % 11) / 20.0, F.when(n % 17 != 0, (n % 10) / 10.0 + 0.05), n % 6, n % 5)
    return rides(spark, sf_dir).select("ride_id", ok.alias("ok"))


# --- fits of power over heart rate

def _irls_sql() -> str:
    """Six rounds of reweighting after a plain fit; weights enter squared."""
    parts = ["v AS (SELECT ride_id, idx, hr x, watts y, 1.0E0 w FROM p WHERE mode = 'pedal' AND watts > 0 AND hr > 60)", "enough AS (SELECT ride_id FROM v GROUP BY ride_id HAVING count(*) >= 20)", "r0 AS (SELECT * FROM v SEMI JOIN enough USING (ride_id))"]
    for k in range(7):
        parts.append(f"s{k} AS (SELECT ride_id, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my FROM r{k} GROUP BY ride_id)")
        parts.append(f"f{k} AS MATERIALIZED (SELECT ride_id, slope, any_value(my) - slope * any_value(mx) base FROM (SELECT ride_id, my, mx, sum(w * (x - mx) * (y - my)) OVER q / sum(w * (x - mx) * (x - mx)) OVER q slope FROM r{k} JOIN s{k} USING (ride_id) WINDOW q AS (PARTITION BY ride_id)) GROUP BY ride_id, slope)")
        parts.append(f"d{k} AS (SELECT ride_id, idx, x, y, y - slope * x - base e FROM r{k} JOIN f{k} USING (ride_id))")
        parts.append(f"m{k} AS (SELECT ride_id, greatest(1.4826E0 * median(abs(e)), 1e-9) s FROM d{k} GROUP BY ride_id)")
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT ride_id, idx, x, y, 1 / greatest(1.0E0, (e / s) * (e / s)) w FROM d{k} JOIN m{k} USING (ride_id))")
    parts.append("z AS (SELECT ride_id, count(*) n, avg(x) mx, 1 - sum(e * e) / CASE WHEN var_pop(y) = 0 THEN 1e-9 ELSE var_pop(y) * count(*) END r2, stddev_pop(e) sd FROM d6 GROUP BY ride_id)")
    parts.append("a AS (SELECT DISTINCT ride_id FROM p)")
    return ", ".join(parts) + """ SELECT a.ride_id, CAST(h AS INTEGER) hr, round(slope * h + base, 4) + 0.0E0 watts, round(greatest(slope * h + base - 2 * sd * (1 + abs(h - mx) / 20), 0.0E0), 4) lo, round(slope * h + base + 2 * sd * (1 + abs(h - mx) / 20), 4) + 0.0E0 hi,
round(r2, 6) + 0.0E0 r2, coalesce(n, 0) n FROM a CROSS JOIN unnest([130, 140, 150, 160]) u(h) LEFT JOIN f6 USING (ride_id) LEFT JOIN z USING (ride_id)"""


@query(P + ", " + _irls_sql())
def watts_at_fixed_hr(spark, sf_dir):
    from .operators.fits import watts_at_fixed_hr as fit

    p = points(spark, sf_dir).withColumn("confidence", F.lit("high"))
    four = lambda c: (F.round(c, 4) + F.lit(0.0)).alias(c)
    return fit(p, "ride_id", "hr", "watts", "confidence", "mode").select("ride_id", "hr", four("watts"), four("lo"), four("hi"), r6("r2"), "n")


# --- rides as a whole

@query(P + ", b AS (SELECT ride_id, avg(watts) w FROM p GROUP BY ride_id) SELECT ride_id, round(10.8E0 * (w / 75) + 7.0E0, 6) vo2max FROM b")
def vo2max(spark, sf_dir):
    best = points(spark, sf_dir).groupBy("ride_id").agg(F.avg("watts").alias("w"))
    return best.select("ride_id", r6(H.vo2max("w"), "vo2max"))


@query(P + " SELECT ride_id, round(avg(CASE WHEN mode = 'pedal' THEN 1.0E0 ELSE 0.0E0 END), 6) pedalling, round(avg(grade), 6) + 0.0E0 mean_grade, round(max(speed), 6) max_speed, round(avg(lat), 6) lat, round(avg(lon), 6) + 0.0E0 lon FROM p GROUP BY ride_id")
def ride_shape(spark, sf_dir):
    return aggregates.ride_shape(points(spark, sf_dir), "ride_id", "mode", "grade", "speed", "lat", "lon").select("ride_id", *map(r6, ("pedalling", "mean_grade", "max_speed", "lat", "lon")))


@query(R + " SELECT count(*) n, count(*) FILTER (has_hr) n_hr FROM r")
def ride_count(spark, sf_dir):
    return rides(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("has_hr").alias("n_hr"))


@query(R + ", n AS (SELECT route_id, count(*) n, max(day) last FROM r GROUP BY route_id) SELECT route_id, n, row_number() OVER (ORDER BY n = 1, last DESC, route_id) place FROM n")
def repeated_then_solo(spark, sf_dir):
    """Routes that were ridden more than once before those that were not, the latest first. A place is the count of earlier days' routes plus the place within the day, so no task orders all routes."""
    n = rides(spark, sf_dir).groupBy("route_id").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    n = n.withColumns({"solo": F.col("n") == 1, "on": -F.floor("last")})
    days = n.groupBy("solo", "on").agg(F.count("*").alias("_n"))  # a row a day
    before = days.select("solo", "on", (F.sum("_n").over(Window.orderBy("solo", "on")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("solo", "on").orderBy(F.desc("last"), "route_id"))
    return n.withColumn("_within", within).join(before, ["solo", "on"]).select("route_id", "n", (F.col("_before") + F.col("_within")).alias("place"))


@query(R + " SELECT DISTINCT day x FROM (SELECT day FROM r WHERE has_hr UNION ALL SELECT day + 0.5E0 FROM r WHERE NOT has_hr)")
def merged_x(spark, sf_dir):
    r = rides(spark, sf_dir)
    return selection.merged_axis(r.where("has_hr").select(F.col("day").alias("x")), r.where("NOT has_hr").select((F.col("day") + 0.5).alias("x")))


@query(R + ", m AS (SELECT max(day) d FROM r) SELECT ride_id, day FROM r, m WHERE day >= d - 2.0E0")
def retained_48h(spark, sf_dir):
    r = rides(spark, sf_dir)
    return selection.younger_than(r, "day", r.agg(F.max("day").alias("now")), 2.0).select("ride_id", "day")


_OLD = "old AS (SELECT user_id ride_id, epoch_us(ts) / 3.6E9 t, 'old' label FROM events WHERE event_type = 'click'), new AS (SELECT user_id ride_id, epoch_us(ts) / 3.6E9 t, 'new' label FROM events WHERE event_type = 'purchase')"


@query("WITH " + _OLD + ", kept AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.ride_id = o.ride_id AND abs(n.t - o.t) <= 2)) SELECT ride_id, round(t, 6) t, label FROM kept UNION ALL SELECT ride_id, round(t, 6), label FROM new")
def merged_tags(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("ride_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), "event_type")
    pick = lambda kind, label: e.where(F.col("event_type") == kind).select("ride_id", "t", F.lit(label).alias("label"))
    return joins.merged_near(pick("click", "old"), pick("purchase", "new"), "ride_id", "t", 2.0).select("ride_id", r6("t"), "label")


@query(P + f""", g AS (SELECT *, CASE WHEN idx % 5 = 0 THEN NULL WHEN idx % 7 = 0 THEN 0.2E0 ELSE speed END v, CASE WHEN idx % 3 = 0 THEN NULL ELSE dist END d FROM p),
s AS (SELECT *, d - last_value(d IGNORE NULLS) OVER ({BY} idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) step, {_hav('lag(lat) OVER (' + BY + ' idx)', 'lag(lon) OVER (' + BY + ' idx)', 'lat', 'lon')} metres FROM g),
u AS (SELECT *, CASE WHEN step >= 0 AND step < 100000 THEN step END ok FROM s)
SELECT ride_id, idx, CASE WHEN v IS NOT NULL THEN v >= 0.6 OR coalesce(ok >= 1, false) WHEN ok IS NOT NULL THEN ok >= 1 ELSE coalesce(metres >= 5, false) END moving FROM u""")
def moving_flags(spark, sf_dir):
    from .functions.geo import haversine

    p = points(spark, sf_dir)
    p = p.withColumn("v", F.when(F.col("idx") % 5 == 0, None).when(F.col("idx") % 7 == 0, 0.2).otherwise(F.col("speed"))).withColumn("d", F.when(F.col("idx") % 3 != 0, F.col("dist")))
    w = W.ordered("ride_id", "idx")
    metres = haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return efforts.moving(p, "ride_id", "idx", "v", "d", metres).select("ride_id", "idx", "moving")


# --- checks of single values

@query("SELECT c_custkey, CASE WHEN len(z) = 5 AND list_bool_and(list_transform(z, lambda x: x.lo >= 30 AND x.lo < x.hi AND x.hi <= 250)) THEN CAST(z[5].hi AS DOUBLE) END top FROM (SELECT c_custkey, list_transform(range(4 + c_custkey % 2), lambda k: {'lo': 25 + c_custkey % 40 + 30 * k, 'hi': 25 + c_custkey % 40 + 30 * (k + 1)}) z FROM customer)")
def valid_hr_zones(spark, sf_dir):
    k = F.col("c_custkey")
    zone = lambda i: F.struct((25 + k % 40 + 30 * i).alias("lo"), (25 + k % 40 + 30 * (i + 1)).alias("hi"))
    zones = F.transform(F.sequence(F.lit(0), (3 + k % 2).cast("int")), zone)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.element_at(checks.valid_zones(zones), 5)["hi"].cast("double").alias("top"))


@query(P + " SELECT ride_id, idx, CASE WHEN watts * 4 - 200 BETWEEN -100 AND 1000 AND (NOT (lat BETWEEN 49.5 AND 61.0 AND lon BETWEEN -8.7 AND 2.1) OR watts * 4 - 200 <= 700) THEN round(watts * 4 - 200, 6) END elev, CASE WHEN watts * 4 - 200 BETWEEN 0 AND 400 THEN round(watts * 4 - 200, 6) END usable FROM p")
def tight_elevation(spark, sf_dir):
    z = F.col("watts") * 4 - 200
    return points(spark, sf_dir).select("ride_id", "idx", r6(checks.tight_elevation(z, "lat", "lon"), "elev"), r6(checks.usable_elevation(z), "usable"))


@query(R + ", m AS (SELECT max(day) d FROM r) SELECT ride_id, CASE WHEN ride_id % 9 = 0 THEN true WHEN ride_id % 3 = 1 THEN (d - day) * 24 >= 6 WHEN ride_id % 2 = 0 THEN (d - day) * 24 >= 1 ELSE false END refetch FROM r, m")
def stale_cache(spark, sf_dir):
    r = rides(spark, sf_dir)
    n = F.col("ride_id")
    source = F.when(n % 9 == 0, None).when(n % 3 == 1, "default").otherwise("open-meteo")
    now = r.agg(F.max("day").alias("now"))  # one row
    return r.crossJoin(F.broadcast(now)).select("ride_id", checks.stale(source, n % 2 == 0, F.col("day") * 86400, F.col("now") * 86400).alias("refetch"))


@query("SELECT event_id, round(coalesce(CAST(json_extract_string(props, '$.missing') AS DOUBLE), CAST(json_extract_string(props, '$.k') AS DOUBLE), \"value\"), 6) metric, round(\"value\", 6) plain FROM events")
def document_fallbacks(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", r6(checks.first_of("props", ["$.missing", "$.k"], "value"), "metric"), r6(checks.first_of("props", ["$.missing"], "value"), "plain"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') said FROM (SELECT event_id, CAST(round_even(\"value\" * 60, 0) AS BIGINT) s FROM events)")
def duration_text(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", checks.duration_text(F.col("value") * 60).alias("said"))


# --- weather

_HOURLY = "h AS (SELECT user_id, list(CASE WHEN event_id % 7 = 0 THEN NULL ELSE \"value\" END ORDER BY ts, event_id) s, list(CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 37) % 360 END ORDER BY ts, event_id) d FROM events GROUP BY user_id)"


def _hourly(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("s"), F.when(F.col("event_id") % 5 != 0, (F.col("event_id") * 37) % 360).alias("d")))).alias("h"))


@query("WITH " + _HOURLY + ", k AS (SELECT user_id, list_filter(list_zip(s, d), lambda x: x[1] IS NOT NULL AND x[2] IS NOT NULL) z FROM h) SELECT user_id, CAST(len(z) AS INTEGER) n, round(z[3][1], 6) speed, CAST(z[3][2] AS BIGINT) direction FROM k")
def aligned_weather(spark, sf_dir):
    pairs = checks.aligned_pairs(F.col("h.s"), F.col("h.d"))
    return _hourly(spark, sf_dir).select("user_id", pairs.alias("z")).select("user_id", F.size("z").alias("n"), r6(F.col("z")[2]["speed"], "speed"), F.col("z")[2]["direction"].alias("direction"))


@query("WITH " + _HOURLY + """, k AS (SELECT user_id, list_filter(s, lambda x: x IS NOT NULL) s FROM h), m AS (SELECT user_id, s, CASE WHEN len(s) >= 3 THEN least(greatest(list_aggregate(s, 'stddev_pop') * 0.01E0 * 0.7E0 + 0.5E0, 0.5E0), 4.0E0) END hourly, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 20 / 2.0E0 END gust FROM k)
SELECT user_id, round(CASE WHEN gust IS NULL THEN hourly ELSE greatest(coalesce(hourly, 0), least(greatest(greatest(gust - 3, 0.0E0) * 0.4E0, 0.5E0), 4.0E0)) END, 6) sigma FROM m""")
def gust_sigma(spark, sf_dir):
    speeds = F.transform(F.col("h.s"), lambda x: x * 0.01)
    gust = F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 20 / 2.0)
    return _hourly(spark, sf_dir).select("user_id", r6(checks.gust_sigma(speeds, gust, 3.0), "sigma"))
