"""Registered queries: time series and runs over the ride view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, r6
from .functions.geo import haversine
from .operators import frames as W
from .operators import islands as I
from .plans.views import POINTS_SQL, points
from .schemas import C

P = f"WITH p AS ({POINTS_SQL})\n"
BY = "PARTITION BY ride_id ORDER BY"
INTEGRAL = f""", a AS (SELECT *, coalesce((t - lag(t) OVER w) * (watts + lag(watts) OVER w) / 2, 0.0E0) area FROM p WINDOW w AS ({BY} t)),
c AS (SELECT *, sum(area) OVER ({BY} t ROWS UNBOUNDED PRECEDING) cum FROM a)"""


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * {C.earth_m!r}::DOUBLE * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


@query(P + f"SELECT ride_id, idx, round(sum(coalesce({_hav('pl', 'po', 'lat', 'lon')}, 0.0E0)) OVER ({BY} idx ROWS UNBOUNDED PRECEDING), 6) cum_dist FROM (SELECT *, lag(lat) OVER ({BY} idx) pl, lag(lon) OVER ({BY} idx) po FROM p)")
def cum_distance(spark, sf_dir):
    return W.cumulative_distance(points(spark, sf_dir), "ride_id", "idx", "lat", "lon").select("ride_id", "idx", r6("cum_dist"))


@query(P + f"SELECT ride_id, idx, round(CASE WHEN count(*) OVER (PARTITION BY ride_id) < 3 THEN watts ELSE avg(watts) OVER ({BY} dist RANGE BETWEEN 100.0E0 PRECEDING AND 100.0E0 FOLLOWING) END, 6) smooth FROM p")
def rolling_mean_distance(spark, sf_dir):
    return W.mean_around(points(spark, sf_dir), "ride_id", "dist", "watts", 200.0, "smooth").select("ride_id", "idx", r6("smooth"))


@query(P + f"SELECT ride_id, idx, round(median(watts) OVER ({BY} dist RANGE BETWEEN 100.0E0 PRECEDING AND 100.0E0 FOLLOWING), 6) med FROM p")
def rolling_median(spark, sf_dir):
    return W.median_around(points(spark, sf_dir), "ride_id", "dist", "watts", 200.0, "med").select("ride_id", "idx", r6("med"))


@query(P + f""", s AS (SELECT *, CASE WHEN count(elev) OVER w >= 3 AND max(dist) OVER w - min(dist) OVER w > 3 THEN regr_slope(elev, dist) OVER w END own FROM p WINDOW w AS ({BY} dist RANGE BETWEEN 100.0E0 PRECEDING AND 100.0E0 FOLLOWING))
SELECT ride_id, idx, round(coalesce(last_value(own IGNORE NULLS) OVER ({BY} dist ROWS UNBOUNDED PRECEDING), 0.0E0), 6) + 0.0E0 slope FROM s""")
def window_slope_carry(spark, sf_dir):
    return W.slope_around(points(spark, sf_dir), "ride_id", "dist", "elev", 200.0, "slope").select("ride_id", "idx", r6("slope"))


def _rolling(frame: str) -> str:
    return P + INTEGRAL + f""" SELECT ride_id, idx, round(CASE WHEN last_value(t) OVER w > first_value(t) OVER w THEN (last_value(cum) OVER w - first_value(cum) OVER w) / (last_value(t) OVER w - first_value(t) OVER w) ELSE watts END, 6) mean
FROM c WINDOW w AS ({BY} t RANGE BETWEEN {frame})"""


@query(_rolling("30.0E0 PRECEDING AND CURRENT ROW"))
def rolling_mean_time_trailing(spark, sf_dir):
    return W.rolling_mean_time(points(spark, sf_dir), "ride_id", "t", "watts", 30.0, "mean").select("ride_id", "idx", r6("mean"))


@query(_rolling("30.0E0 PRECEDING AND 30.0E0 FOLLOWING"))
def rolling_mean_time_centered(spark, sf_dir):
    return W.rolling_mean_time(points(spark, sf_dir), "ride_id", "t", "watts", 60.0, "mean", centered=True).select("ride_id", "idx", r6("mean"))


def _best(seconds: int) -> str:
    n = f"{seconds}.0E0"
    return P + INTEGRAL + f""", l AS (SELECT *, last_value(t) OVER lo lt, last_value(cum) OVER lo lc, first_value(t) OVER hi ht, first_value(cum) OVER hi hc FROM c
WINDOW lo AS ({BY} t RANGE BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING), hi AS ({BY} t RANGE BETWEEN {n} PRECEDING AND CURRENT ROW)),
m AS (SELECT *, (cum - (lc + (hc - lc) * coalesce((t - {n} - lt) / nullif(ht - lt, 0), 0.0E0))) / {n} mean FROM l)
SELECT ride_id, round(greatest(CASE WHEN max(t) - min(t) < {n} THEN CASE WHEN max(t) > min(t) THEN max_by(cum, t) / nullif(max(t) - min(t), 0) ELSE max(watts) END ELSE max(mean) END, 0.0E0), 6) best FROM m GROUP BY ride_id"""


def _register_best(minutes: int) -> None:
    @query(_best(60 * minutes), name=f"best_window_{minutes}m")
    def best(spark, sf_dir):
        return W.best_window(points(spark, sf_dir), "ride_id", "t", "watts", 60.0 * minutes).select("ride_id", r6("best"))


for _m in C.curve_minutes:
    _register_best(_m)


@query(P + f""", s AS (SELECT *, CASE WHEN mode = 'pedal' AND lag(mode) OVER ({BY} idx) = 'pedal' THEN t - lag(t) OVER ({BY} idx) ELSE 0.0E0 END step FROM p)
SELECT ride_id, idx, round(sum(step) OVER ({BY} idx ROWS UNBOUNDED PRECEDING) + 1.0E-8, 6) effort_t FROM s""")
def effort_clock(spark, sf_dir):
    return W.effort_clock(points(spark, sf_dir), "ride_id", "t", "idx", F.col("mode") == "pedal").select("ride_id", "idx", r6(F.col("effort_t") + 1e-8, "effort_t"))  # away from halves


@query(P + f"SELECT ride_id, idx, round(CASE WHEN lead(t) OVER w > t THEN least(greatest((lead(speed) OVER w - speed) / (lead(t) OVER w - t), -2.0E0), 2.0E0) ELSE 0.0E0 END, 6) + 0.0E0 accel FROM p WINDOW w AS ({BY} t)")
def acceleration_clamped(spark, sf_dir):
    return W.acceleration(points(spark, sf_dir), "ride_id", "t", "speed").select("ride_id", "idx", r6("accel"))


@query(P + f""", n AS (SELECT *, radians(lat) p1, radians(lead(lat) OVER ({BY} idx)) p2, radians(lead(lon) OVER ({BY} idx) - lon) dl FROM p),
b AS (SELECT *, atan2(sin(dl) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(dl)) b FROM n)
SELECT ride_id, idx, round(coalesce(b, lag(b) OVER ({BY} idx), 0.0E0), 6) + 0.0E0 bearing FROM b""")
def bearing(spark, sf_dir):
    return W.forward_bearing(points(spark, sf_dir), "ride_id", "idx", "lat", "lon").select("ride_id", "idx", r6("bearing"))


def _savgol() -> str:
    def term(weights, shift, sign=1):
        parts = []
        for k, c in enumerate(weights):
            o = sign * (k - shift)
            v = "watts" if o == 0 else f"lead(watts, {o}) OVER w" if o > 0 else f"lag(watts, {-o}) OVER w"
            parts.append(f"{c / 429.0!r}::DOUBLE * {v}")
        return " + ".join(parts)

    edges = "".join(f" WHEN i = {r} THEN {term(e, r)} WHEN n - 1 - i = {r} THEN {term(e, r, -1)}" for r, e in enumerate(W.SAVGOL_EDGE))
    return P + f""", q AS (SELECT *, row_number() OVER ({BY} idx) - 1 i, count(*) OVER (PARTITION BY ride_id) n FROM p)
SELECT ride_id, idx, round(CASE WHEN n < 11 THEN avg(watts) OVER ({BY} idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) WHEN i >= 5 AND n - 1 - i >= 5 THEN {term(W.SAVGOL, 5)}{edges} END, 6) smooth FROM q WINDOW w AS ({BY} idx)"""


@query(_savgol())
def savgol_11_2(spark, sf_dir):
    return W.savgol(points(spark, sf_dir), "ride_id", "idx", "watts").select("ride_id", "idx", r6("smooth"))


@query(P + f"SELECT ride_id, idx, coalesce(t - lag(t) OVER ({BY} t) > 10, false) after_gap FROM p")
def gap_flag(spark, sf_dir):
    return W.gaps(points(spark, sf_dir), "ride_id", "t", 10.0).select("ride_id", "idx", "after_gap")


@query(P + f""", f AS (SELECT *, last_value(CASE WHEN hr IS NOT NULL THEN idx END IGNORE NULLS) OVER a ax, last_value(hr IGNORE NULLS) OVER a ay, first_value(CASE WHEN hr IS NOT NULL THEN idx END IGNORE NULLS) OVER b bx, first_value(hr IGNORE NULLS) OVER b AS "by"
FROM p WINDOW a AS ({BY} idx ROWS UNBOUNDED PRECEDING), b AS ({BY} idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ride_id, idx, round(coalesce(hr, ay + ("by" - ay) * (idx - ax) / nullif(CAST(bx - ax AS DOUBLE), 0), ay, "by"), 6) filled FROM f""")
def fill_linear(spark, sf_dir):
    return W.fill_linear(points(spark, sf_dir), "ride_id", "idx", "hr").select("ride_id", "idx", r6("filled"))


@query(P + f"""SELECT ride_id, idx, round(coalesce(last_value(CASE WHEN speed >= 4 THEN watts END IGNORE NULLS) OVER ({BY} idx ROWS UNBOUNDED PRECEDING),
first_value(CASE WHEN speed >= 4 THEN watts END IGNORE NULLS) OVER ({BY} idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) held FROM p""")
def forward_fill(spark, sf_dir):
    return W.fill_forward(points(spark, sf_dir), "ride_id", "idx", F.when(F.col("speed") >= 4, F.col("watts"))).select("ride_id", "idx", r6("held"))


@query(P + f"SELECT ride_id, idx, round(max(elev) OVER ({BY} idx ROWS UNBOUNDED PRECEDING), 6) top FROM p")
def running_max(spark, sf_dir):
    return W.running_max(points(spark, sf_dir), "ride_id", "idx", "elev").select("ride_id", "idx", r6("top"))


@query(P + """, e AS (SELECT ride_id, min(dist) lo, max(dist) hi, count(*) n FROM p GROUP BY ride_id),
g AS (SELECT ride_id, k, lo + (hi - lo) * k / 39 dist FROM e, range(40) r(k) WHERE n > 40),
f AS (SELECT g.ride_id, g.k, g.dist, a.dist ad, a.lat alat, a.lon alon, b.dist bd, b.lat blat, b.lon blon FROM g ASOF LEFT JOIN p a ON g.ride_id = a.ride_id AND g.dist >= a.dist ASOF LEFT JOIN p b ON g.ride_id = b.ride_id AND g.dist <= b.dist)
SELECT ride_id, CAST(k AS INTEGER) k, round(coalesce(alat + (blat - alat) * coalesce((dist - ad) / nullif(bd - ad, 0), 0.0E0), alat, blat), 6) lat, round(coalesce(alon + (blon - alon) * coalesce((dist - ad) / nullif(bd - ad, 0), 0.0E0), alon, blon), 6) lon FROM f
UNION ALL SELECT p.ride_id, CAST(idx AS INTEGER), round(lat, 6), round(lon, 6) FROM p JOIN e ON p.ride_id = e.ride_id WHERE n <= 40""")
def resample_40(spark, sf_dir):
    return W.resample(points(spark, sf_dir), "ride_id", "dist", ["lat", "lon"], 40).select("ride_id", "k", r6("lat"), r6("lon"))


@query(P + f"""SELECT a.ride_id, a.idx, round(avg(b.hr), 6) shown FROM p a LEFT JOIN p b ON a.ride_id = b.ride_id AND b.idx BETWEEN a.idx - 12 AND a.idx + 12 AND abs(a.t - b.t) <= 16 GROUP BY a.ride_id, a.idx""")
def display_smooth(spark, sf_dir):
    return W.display_mean(points(spark, sf_dir), "ride_id", "idx", "t", "hr").select("ride_id", "idx", r6("shown"))


@query(P + """, h AS (SELECT ride_id, list(v ORDER BY hour) v FROM (SELECT ride_id, hour, CAST((ride_id * 37 + hour * 61) % 360 AS DOUBLE) v FROM (SELECT DISTINCT ride_id FROM p), range(24) r(hour)) GROUP BY ride_id),
x AS (SELECT p.ride_id, idx, v, t / 30 - 24 * floor(t / 30 / 24) a FROM p JOIN h ON p.ride_id = h.ride_id),
y AS (SELECT *, CAST(floor(a) AS BIGINT) f, a - floor(a) s, CAST(least(floor(a), 22) AS BIGINT) b FROM x)
SELECT ride_id, idx, round(CASE WHEN a >= 23 THEN v[24] ELSE v[f + 1] + (v[f + 2] - v[f + 1]) * s END, 6) speed,
round(((v[b + 1] + ((((v[b + 2] - v[b + 1] + 180.0E0) % 360 + 360) % 360) - 180.0E0) * s) % 360 + 360) % 360, 6) direction FROM y""")
def hourly_circular_interp(spark, sf_dir):
    p = points(spark, sf_dir)
    series = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: ((F.col("ride_id") * 37 + h * 61) % 360).cast("double"))
    hour = F.col("t") / 30
    p = p.withColumn("_v", series)
    return p.select("ride_id", "idx", r6(W.hourly_at(F.col("_v"), hour), "speed"), r6(W.hourly_at(F.col("_v"), hour, circular=True), "direction"))


def _runs(on: str) -> str:
    return P + f""", o AS (SELECT *, coalesce({on}, false) is_on FROM p), s AS (SELECT *, CASE WHEN is_on AND NOT coalesce(lag(is_on) OVER ({BY} idx), false) THEN 1 ELSE 0 END fresh FROM o),
i AS (SELECT * FROM (SELECT *, CAST(sum(fresh) OVER ({BY} idx ROWS UNBOUNDED PRECEDING) AS BIGINT) island FROM s) WHERE is_on)"""


SEGMENTS = " SELECT ride_id, island, count(*) n_points, round(min(t), 6) t_start, round(max(t), 6) t_end FROM i GROUP BY ALL HAVING count(*) >= {least}"
COASTING = "grade < -0.01 AND speed > 2 AND (hr IS NULL OR hr < 0.78 * 180)"


def _segments(spark, sf_dir, on, least):
    return I.segments(points(spark, sf_dir), "ride_id", "idx", "t", F.expr(on), least).select("ride_id", "island", "n_points", r6("t_start"), r6("t_end"))


@query(_runs("grade < -0.01 AND speed > 2") + SEGMENTS.format(least=10))
def descent_segments(spark, sf_dir):
    return _segments(spark, sf_dir, "grade < -0.01 AND speed > 2", 10)


@query(_runs(COASTING) + SEGMENTS.format(least=3))
def coast_segments(spark, sf_dir):
    return _segments(spark, sf_dir, COASTING, 3)


@query(_runs("grade > 0.03") + SEGMENTS.format(least=12))
def climb_segments(spark, sf_dir):
    return _segments(spark, sf_dir, "grade > 0.03", 12)


@query(_runs("watts > 60 AND hr BETWEEN 100 AND 170") + f""", g AS (SELECT ride_id, island, count(*) n_points, min(t) t_start, max(t) t_end FROM i GROUP BY ALL),
m AS (SELECT *, coalesce(t_start - max(t_end) OVER ({BY} t_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 90, true) fresh FROM g),
b AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER ({BY} t_start ROWS UNBOUNDED PRECEDING) AS BIGINT) block FROM m)
SELECT ride_id, block, round(min(t_start), 6) t_start, round(max(t_end), 6) t_end, count(*) n_islands, CAST(sum(n_points) AS BIGINT) n_points FROM b GROUP BY ride_id, block""")
def merged_islands_90s(spark, sf_dir):
    runs = I.segments(points(spark, sf_dir), "ride_id", "idx", "t", F.expr("watts > 60 AND hr BETWEEN 100 AND 170"), 1)
    return I.merge_near(runs, "ride_id", "t_start", "t_end", 90.0).select("ride_id", "block", r6("t_start"), r6("t_end"), "n_islands", "n_points")


@query(_runs("grade < -0.01 AND speed > 2") + """, v AS (SELECT *, coalesce(pow(speed, 3) * (lead(t) OVER (PARTITION BY ride_id, island ORDER BY idx) - t), 0.0E0) v3 FROM i)
SELECT ride_id, island, count(*) n_points, round(max_by(elev, idx) - min_by(elev, idx), 6) + 0.0E0 rise, round(max_by(dist, idx) - min_by(dist, idx), 6) AS length, round(sum(v3), 6) v3 FROM v GROUP BY ALL HAVING count(*) >= 10""")
def segment_integrals(spark, sf_dir):
    found = I.segment_integrals(points(spark, sf_dir), "ride_id", "idx", "t", F.expr("grade < -0.01 AND speed > 2"), "elev", "dist", "speed")
    return found.select("ride_id", "island", "n_points", r6("rise"), r6("length"), r6("v3"))


@query(_runs("grade > 0.03") + """, r AS (SELECT ride_id, island, count(*) n, max(t) - min(t) dt, max_by(elev, idx) - min_by(elev, idx) dz FROM i GROUP BY ALL)
SELECT ride_id, round(median(dz / dt * 3600), 6) vam_mh FROM r WHERE n >= 2 AND dt > 5 AND dz > 1 GROUP BY ride_id""")
def vam_median(spark, sf_dir):
    return I.vam(points(spark, sf_dir), "ride_id", "idx", "t", "grade", "elev", C.climb).select("ride_id", r6("vam_mh"))


@query(P + f"SELECT ride_id, idx, round({_hav('52.0E0', '-1.5E0', 'lat', 'lon')}, 6) metres FROM p", name="haversine")
def haversine_from_start(spark, sf_dir):
    return points(spark, sf_dir).select("ride_id", "idx", r6(haversine(F.lit(52.0), F.lit(-1.5), "lat", "lon"), "metres"))
