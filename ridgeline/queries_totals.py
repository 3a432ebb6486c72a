"""Registered queries: aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, r6
from .functions.physio import hr_zones, vo2max
from .operators import aggregates as A
from .operators import islands as I
from .operators.frames import ordered
from .plans.views import RIDES_SQL, points, rides
from .queries_time import BY, INTEGRAL, P, _runs
from .schemas import C

R = f"WITH r AS ({RIDES_SQL})\n"
STEPS = f", s AS (SELECT *, coalesce(least(greatest(t - lag(t) OVER ({BY} t), 0.0E0), 10.0E0), 0.0E0) dt FROM p WHERE hr IS NOT NULL)"


@query(P + "SELECT ride_id, round(avg(hr), 6) avg_hr, round(max(hr), 6) max_hr, round(min(hr), 6) min_hr FROM p GROUP BY ride_id")
def hr_summary(spark, sf_dir):
    return A.hr_summary(points(spark, sf_dir), "ride_id", "hr").select("ride_id", r6("avg_hr"), r6("max_hr"), r6("min_hr"))


def _trimp(c: float, k: float) -> str:
    return P + STEPS + f", x AS (SELECT *, least(greatest((hr - 55.0E0) / 125.0E0, 0.0E0), 1.0E0) q FROM s) SELECT ride_id, round(sum(dt / 60 * q * {c}::DOUBLE * exp({k}::DOUBLE * q)), 6) trimp FROM x GROUP BY ride_id"


@query(_trimp(*C.trimp_male))
def trimp(spark, sf_dir):
    return A.trimp(points(spark, sf_dir), "ride_id", "t", "hr", 180.0).select("ride_id", r6("trimp"))


@query(_trimp(*C.trimp_female))
def trimp_female(spark, sf_dir):
    return A.trimp(points(spark, sf_dir), "ride_id", "t", "hr", 180.0, female=True).select("ride_id", r6("trimp"))


def _zones() -> str:
    bound = lambda k: f"CAST(round_even(55.0E0 + 125.0E0 * (0.5E0 + 0.1E0 * {k}), 0) AS INTEGER)"
    cols = [f"round(sum(CASE WHEN hr >= {bound(k)} AND {'true' if k == 4 else 'hr < ' + bound(k + 1)} THEN dt ELSE 0.0E0 END), 6) z{k + 1}" for k in range(5)]
    return P + STEPS + f" SELECT ride_id, {', '.join(cols)} FROM s GROUP BY ride_id"


@query(_zones())
def time_in_zone(spark, sf_dir):
    zones = hr_zones(F.lit(180.0), F.lit(55.0))
    return A.time_in_zone(points(spark, sf_dir), "ride_id", "t", "hr", zones).select("ride_id", *[r6(f"z{k}") for k in range(1, 6)])


@query(P + "SELECT ride_id, round(avg(CASE WHEN mode = 'pedal' THEN watts END), 6) watts, round(avg(CASE WHEN mode = 'pedal' THEN 1.0E0 ELSE 0.0E0 END), 6) pedalling, round(avg(grade), 6) + 0.0E0 avg_grade, round(max(speed), 6) max_speed FROM p GROUP BY ride_id")
def mean_power_pedalling(spark, sf_dir):
    pedal = F.col("mode") == "pedal"
    return points(spark, sf_dir).groupBy("ride_id").agg(r6(F.avg(F.when(pedal, F.col("watts"))), "watts"), r6(F.avg(pedal.cast("double")), "pedalling"), r6(F.avg("grade"), "avg_grade"), r6(F.max("speed"), "max_speed"))


NP = f""", m AS (SELECT ride_id, t, pow(CASE WHEN last_value(t) OVER w > first_value(t) OVER w THEN (last_value(cum) OVER w - first_value(cum) OVER w) / (last_value(t) OVER w - first_value(t) OVER w) ELSE watts END, 4) q FROM c WINDOW w AS ({BY} t RANGE BETWEEN 30.0E0 PRECEDING AND CURRENT ROW)),
n AS (SELECT *, coalesce((t - lag(t) OVER ({BY} t)) * (q + lag(q) OVER ({BY} t)) / 2, 0.0E0) area FROM m)"""


@query(P + INTEGRAL + NP + " SELECT ride_id, round(pow(CASE WHEN max(t) > min(t) THEN sum(area) / nullif(max(t) - min(t), 0) ELSE avg(q) END, 0.25E0), 6) AS np FROM n GROUP BY ride_id")
def normalized_power(spark, sf_dir):
    return A.normalized_power(points(spark, sf_dir), "ride_id", "t", "watts").select("ride_id", r6("np"))


WORK = f", k AS (SELECT ride_id, sum(j) / 1000 work_kj FROM (SELECT *, coalesce(least(greatest(t - lag(t) OVER ({BY} t), 0.0E0), 30.0E0) * (watts + lag(watts) OVER ({BY} t)) / 2, 0.0E0) j FROM p) GROUP BY ride_id)"
_a, _b, _c, _d = A.HR_ENERGY["male"]
ENERGY = f""", e AS (SELECT ride_id, sum(CASE WHEN hr IS NOT NULL THEN greatest({_a}::DOUBLE + {_b}::DOUBLE * hr + {_c}::DOUBLE * 75 + {_d}::DOUBLE * 40, 0.0E0) * dt / 60 END) / 4.184E0 hr_kcal, sum(CASE WHEN hr IS NOT NULL THEN dt ELSE 0.0E0 END) covered_s, max(t) - min(t) span_s
FROM (SELECT *, coalesce(least(greatest(t - lag(t) OVER ({BY} t), 0.0E0), 10.0E0), 0.0E0) dt FROM p) GROUP BY ride_id)"""


@query(P + WORK + " SELECT ride_id, round(work_kj, 6) work_kj FROM k")
def work_kj(spark, sf_dir):
    return A.work_kj(points(spark, sf_dir), "ride_id", "t", "watts").select("ride_id", r6("work_kj"))


@query(P + ENERGY + " SELECT ride_id, round(hr_kcal, 6) hr_kcal, round(covered_s, 6) covered_s, round(span_s, 6) span_s FROM e")
def hr_energy(spark, sf_dir):
    return A.hr_energy(points(spark, sf_dir), "ride_id", "t", "hr").select("ride_id", r6("hr_kcal"), r6("covered_s"), r6("span_s"))


_BELOW, _ABOVE = ((C.hr_energy_share_unknown**2 + ((e - C.gross_efficiency) / C.gross_efficiency) ** 2) ** 0.5 for e in C.efficiency_range)


@query(P + WORK + ENERGY + f""", v AS (SELECT ride_id, sum(CASE WHEN mode = 'static' THEN 0.0E0 ELSE dt END) moving_s FROM (SELECT *, coalesce(t - lag(t) OVER ({BY} t), 0.0E0) dt FROM p) GROUP BY ride_id),
c AS (SELECT *, CASE WHEN moving_s > 0 THEN covered_s / nullif(moving_s, 0) ELSE 0.0E0 END cover, work_kj / 4.184E0 / 0.239E0 w FROM e JOIN k USING (ride_id) JOIN v USING (ride_id)), b AS (SELECT *, coalesce(hr_kcal > 0 AND cover >= 0.5, false) by_hr FROM c),
h AS (SELECT *, CASE WHEN by_hr AND moving_s > 0 THEN hr_kcal * 4.184E0 * 0.239E0 * 1000 / nullif(moving_s, 0) END hw FROM b)
SELECT ride_id, CASE WHEN by_hr THEN 'hr' ELSE 'power' END "method", round(CASE WHEN by_hr THEN hr_kcal ELSE w END, 6) kcal, round(CASE WHEN by_hr THEN hr_kcal * 0.78E0 ELSE w * 0.8E0 END, 6) lo, round(CASE WHEN by_hr THEN hr_kcal * 1.22E0 ELSE w * 1.3E0 END, 6) hi,
round(CASE WHEN hr_kcal > 0 THEN hr_kcal END, 6) hr_kcal, round(cover, 6) hr_coverage, round(hw, 6) hr_watts, round(hw * (1 - {_BELOW!r}::DOUBLE), 6) hr_watts_lo, round(hw * (1 + {_ABOVE!r}::DOUBLE), 6) hr_watts_hi, round(w, 6) power_kcal FROM h""")
def calories(spark, sf_dir):
    """For a rider of unknown sex, with a power band and the time without standing."""
    p = points(spark, sf_dir).withColumn("low", F.col("watts") * 0.8).withColumn("high", F.col("watts") * 1.3)
    step = F.when(F.col("mode") == "static", F.lit(0.0)).otherwise(F.coalesce(F.col("t") - F.lag("t").over(ordered("ride_id", "t")), F.lit(0.0)))
    moving = p.withColumn("_s", step).groupBy("ride_id").agg(F.sum("_s").alias("moving_s"))
    found = A.calories(p, "ride_id", "t", "hr", "watts", "low", "high", moving, sex=None)
    return found.select("ride_id", "method", *map(r6, ("kcal", "lo", "hi", "hr_kcal", "hr_coverage", "hr_watts", "hr_watts_lo", "hr_watts_hi", "power_kcal")))


@query(P + """, g AS (SELECT ride_id, least(CAST(floor((least(greatest(watts / 1000 - 0.2E0, -0.2E0), 0.2E0) + 0.2E0) / 0.02E0) AS INTEGER), 19) bin FROM p)
SELECT k.ride_id, CAST(k.bin AS INTEGER) bin, count(g.bin) n FROM (SELECT DISTINCT ride_id, b.bin FROM p, range(20) b(bin)) k LEFT JOIN g ON k.ride_id = g.ride_id AND k.bin = g.bin GROUP BY ALL""")
def grade_histogram(spark, sf_dir):
    return A.histogram(points(spark, sf_dir), F.col("watts") / 1000 - 0.2, -0.2, 0.2, 20, "ride_id")


@query(P + """, e AS (SELECT ride_id, min(dist) lo, greatest(CAST(ceil((max(dist) - min(dist)) / 100.0E0) AS INTEGER), 1) n FROM p GROUP BY ride_id),
m AS (SELECT ride_id, least(CAST(floor((dist - lo) / 100.0E0) AS INTEGER), n - 1) bin, avg(elev) z FROM p JOIN e USING (ride_id) GROUP BY ALL),
g AS (SELECT ride_id, bin, z FROM (SELECT ride_id, unnest(range(n)) bin FROM e) LEFT JOIN m USING (ride_id, bin)),
f AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN bin END IGNORE NULLS) OVER a ax, last_value(z IGNORE NULLS) OVER a ay, first_value(CASE WHEN z IS NOT NULL THEN bin END IGNORE NULLS) OVER b bx, first_value(z IGNORE NULLS) OVER b AS "by"
FROM g WINDOW a AS (PARTITION BY ride_id ORDER BY bin ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY ride_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT ride_id, bin, coalesce(z, ay + ("by" - ay) * (bin - ax) / nullif(CAST(bx - ax AS DOUBLE), 0), ay, "by") z FROM f),
i AS (SELECT *, z - lag(z) OVER (PARTITION BY ride_id ORDER BY bin) r FROM h) SELECT ride_id, round(coalesce(sum(CASE WHEN r > 0.2E0 THEN r END), 0.0E0), 6) gain_m FROM i GROUP BY ride_id""")
def elevation_gain(spark, sf_dir):
    return A.elevation_gain(points(spark, sf_dir), "ride_id", "dist", "elev", 100.0).select("ride_id", r6("gain_m"))


@query(P + f"SELECT ride_id, round(coalesce(sum(s), 0.0E0), 6) length_m FROM (SELECT ride_id, greatest(dist - lag(dist) OVER ({BY} idx), 0.0E0) s FROM p) GROUP BY ride_id")
def track_length(spark, sf_dir):
    return A.track_length(points(spark, sf_dir), "ride_id", "idx", "dist").select("ride_id", r6("length_m"))


@query(P + "SELECT ride_id, round(stddev_pop(watts) / nullif(avg(watts), 0), 6) cv FROM p GROUP BY ride_id")
def coefficient_of_variation(spark, sf_dir):
    return A.variation(points(spark, sf_dir), "ride_id", "watts").select("ride_id", r6("cv"))


@query(P + ", m AS (SELECT ride_id, median(watts) med FROM p GROUP BY ride_id) SELECT ride_id, round(any_value(med), 6) med, round(1.4826E0 * median(abs(watts - med)), 6) sigma FROM p JOIN m USING (ride_id) GROUP BY ride_id")
def mad_sigma(spark, sf_dir):
    return A.mad_sigma(points(spark, sf_dir), "ride_id", "watts").select("ride_id", r6("med"), r6("sigma"))


@query(R + """, l AS (SELECT ride_id, 'trimp' metric, trimp "value" FROM r UNION ALL SELECT ride_id, 'distance_m', distance_m FROM r UNION ALL SELECT ride_id, 'vo2max', 10.8E0 * (trimp / 75.0E0) + 7.0E0 FROM r)
SELECT metric, ride_id, round("value", 6) "value" FROM l WHERE "value" > 0 QUALIFY row_number() OVER (PARTITION BY metric ORDER BY "value" DESC, ride_id) = 1""")
def personal_records(spark, sf_dir):
    r = rides(spark, sf_dir).withColumn("vo2max", vo2max("trimp"))
    return A.personal_records(r, "ride_id", ["trimp", "distance_m", "vo2max"]).select("metric", "ride_id", r6("value"))


@query(R + "SELECT route_id, count(*) n_rides, round(min(day), 6) first_day, round(max(day), 6) last_day, round(sum(distance_m), 4) distance_m, round(max(trimp), 6) max_trimp FROM r GROUP BY route_id")
def route_rollup(spark, sf_dir):
    return rides(spark, sf_dir).groupBy("route_id").agg(F.count("*").alias("n_rides"), r6(F.min("day"), "first_day"), r6(F.max("day"), "last_day"), F.round(F.sum("distance_m"), 4).alias("distance_m"), r6(F.max("trimp"), "max_trimp"))


@query(R + "SELECT count(*) n, round(sum(distance_m), 2) distance_m, round(sum(trimp), 4) trimp FROM r WHERE day > (SELECT max(day) FROM r) - 30")
def last_30d_totals(spark, sf_dir):
    found = A.last_days(rides(spark, sf_dir), "day", 30.0, distance_m="distance_m", trimp="trimp")
    return found.select("n", F.round("distance_m", 2).alias("distance_m"), F.round("trimp", 4).alias("trimp"))


@query(P + "SELECT ride_id, round(quantile_cont(watts, 0.02), 6) lo, round(quantile_cont(watts, 0.98), 6) hi FROM p GROUP BY ride_id")
def quantile_domain(spark, sf_dir):
    return A.quantile_domain(points(spark, sf_dir), "ride_id", "watts").select("ride_id", r6("lo"), r6("hi"))


@query(P + f""", b AS (SELECT ride_id, (watts * 7 - floor(watts * 7 / 6.283185307179586E0) * 6.283185307179586E0) - 3.141592653589793E0 b FROM p),
s AS (SELECT ride_id, b, lead(b) OVER (PARTITION BY ride_id ORDER BY b) - b g FROM b)
SELECT ride_id, round(greatest(coalesce(max(g), 0.0E0), min(b) + 6.283185307179586E0 - max(b)), 6) gap FROM s GROUP BY ride_id""")
def heading_gap(spark, sf_dir):
    turn = F.col("watts") * 7
    b = points(spark, sf_dir).select("ride_id", (turn - F.floor(turn / 6.283185307179586) * 6.283185307179586 - 3.141592653589793).alias("b"))
    return A.heading_gap(b, "ride_id", "b").select("ride_id", r6("gap"))


@query(P + "SELECT ride_id, round(least(greatest(0.7E0 * stddev_pop(watts / 100) + 0.5E0, 0.5E0), 4.0E0), 6) sigma FROM p GROUP BY ride_id")
def wind_sigma(spark, sf_dir):
    return A.wind_sigma(points(spark, sf_dir).withColumn("wind", F.col("watts") / 100), "ride_id", "wind").select("ride_id", r6("sigma"))


@query(_runs("grade < -0.01 AND speed > 2") + """, d AS (SELECT *, (speed - lag(speed) OVER w) / nullif(t - lag(t) OVER w, 0) a FROM i WINDOW w AS (PARTITION BY ride_id, island ORDER BY t))
SELECT ride_id, island, count(*) n, round(avg(hr), 6) mean_hr, round(avg(CASE WHEN hr IS NULL THEN NULL WHEN hr < 140 THEN 1.0E0 ELSE 0.0E0 END), 6) low_share, round(regr_slope(hr, t), 6) + 0.0E0 hr_slope, round(stddev_pop(a), 6) accel_sd FROM d GROUP BY ride_id, island""")
def segment_features(spark, sf_dir):
    runs = I.islands(points(spark, sf_dir), "ride_id", "idx", F.expr("grade < -0.01 AND speed > 2"))
    found = A.segment_features(runs, ["ride_id", "island"], "t", "hr", "speed", 140.0)
    return found.select("ride_id", "island", "n", r6("mean_hr"), r6("low_share"), r6("hr_slope"), r6("accel_sd"))


_FLAG_P = P + INTEGRAL
FLAGSHIP = (
    _FLAG_P + NP
    + ", np AS (SELECT ride_id, pow(CASE WHEN max(t) > min(t) THEN sum(area) / nullif(max(t) - min(t), 0) ELSE avg(q) END, 0.25E0) v FROM n GROUP BY ride_id)"
    + STEPS
    + ", x AS (SELECT *, least(greatest((hr - 55.0E0) / 125.0E0, 0.0E0), 1.0E0) q FROM s), tr AS (SELECT ride_id, sum(dt / 60 * q * 0.64E0 * exp(1.92E0 * q)) v FROM x GROUP BY ride_id)"
    + WORK
    + " SELECT ride_id, round(np.v, 6) normalized_power, round(tr.v, 6) trimp, round(work_kj, 6) work_kj FROM np JOIN k USING (ride_id) LEFT JOIN tr USING (ride_id)"
)


@query(FLAGSHIP)
def ride_metrics(spark, sf_dir):
    """Normalised power, training impulse and work of every ride: the flagship."""
    p = points(spark, sf_dir)
    np, tr, work = A.normalized_power(p, "ride_id", "t", "watts"), A.trimp(p, "ride_id", "t", "hr", 180.0), A.work_kj(p, "ride_id", "t", "watts")
    return np.join(work, "ride_id").join(tr, "ride_id", "left").select("ride_id", r6("np", "normalized_power"), r6("trimp"), r6("work_kj"))


