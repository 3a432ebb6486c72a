"""Registered queries: whole documents of rides, whose SQL is put together from the SQL of their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_rides, queries_time, queries_totals  # noqa: F401  (the parts' SQL)
from .catalog import ORACLES, query, r6
from .plans.read_models import metrics_document as document
from .plans.views import EFFORTS_SQL, POINTS_SQL, efforts
from .schemas import C


def _part(name: str) -> str:
    """A part's SQL over the samples of efforts."""
    sql = ORACLES[name]
    return "(" + (sql if EFFORTS_SQL in sql else sql.replace(POINTS_SQL, EFFORTS_SQL)) + ")"


_BEST = [1, 5, 20]
_LEFT = " ".join(f"LEFT JOIN {_part(n)} {a} USING (ride_id)" for n, a in [("hr_summary", "h"), ("trimp", "t"), ("time_in_zone", "z"), ("normalized_power", "n"), ("work_kj", "k"), ("cardiac_drift", "d"), *[(f"best_window_{m}m", f"b{m}") for m in _BEST]])
_LINE = "(SELECT ride_id, " + ", ".join(f"max(CASE WHEN hr = {h} THEN watts END) w{h}" for h in C.hr_grid) + f" FROM {_part('watts_at_fixed_hr')} GROUP BY ride_id)"


@query(f"WITH s AS (SELECT ride_id, count(*) n_points, round(max(t) - min(t), 6) duration_s, count(hr) > 0 has_hr, round(avg(CASE WHEN mode = 'pedal' THEN watts END), 6) watts, round(avg(CASE WHEN mode = 'pedal' THEN 1.0E0 ELSE 0.0E0 END), 6) pedalling FROM ({EFFORTS_SQL}) GROUP BY ride_id) SELECT ride_id, s.n_points, s.duration_s, coalesce(s.watts, -1.0E0) watts, pedalling, coalesce(avg_hr, -1.0E0) avg_hr, coalesce(max_hr, -1.0E0) max_hr, CASE WHEN has_hr THEN coalesce(trimp, 0.0E0) ELSE -1.0E0 END trimp, "
    + ", ".join(f"coalesce(z{k}, -1.0E0) z{k}" for k in range(1, 6)) + ", coalesce(\"np\", -1.0E0) AS \"np\", coalesce(work_kj, -1.0E0) work_kj, " + ", ".join(f"coalesce(b{m}.best, -1.0E0) best_{m}" for m in _BEST) + ", round(10.8E0 * (b5.best / 75) + 7.0E0, 4) vo2max, " + ", ".join(f"coalesce(w{h}, -1.0E0) w{h}" for h in C.hr_grid)
    + f", coalesce(drift_bpm_per_hr, -999.0E0) drift_bpm_per_hr, coalesce(drift_pct_per_hr, -999.0E0) drift_pct_per_hr, coalesce(n_windows, 0) n_windows FROM s {_LEFT} LEFT JOIN {_LINE} l USING (ride_id)")
def metrics_document(spark, sf_dir):
    """Each ride's document, laid flat: heart rate and zones, power and its curve, power at fixed heart rates, cardiac drift."""
    d = document(efforts(spark, sf_dir))
    num = lambda c, to, none=-1.0: F.coalesce(r6(F.col(c) if isinstance(c, str) else c, to), F.lit(none)).alias(to)
    at = lambda h: F.get(F.filter("watts_at_hr", lambda x: x["hr"] == h), F.lit(0))["watts"]
    return d.select(
        "ride_id", "n_points", r6("duration_s"), num("power.avg", "watts"), num("power.pedalling", "pedalling"), num("heart.avg", "avg_hr"), num("heart.max", "max_hr"), num("heart.trimp", "trimp"), *[num(F.col("heart.zones")[k], f"z{k + 1}") for k in range(5)],
        num("power.normalized", "np"), num("power.work_kj", "work_kj"), *[num(F.col("power.curve")[m], f"best_{m}") for m in _BEST], F.round("power.vo2max", 4).alias("vo2max"), *[F.coalesce(F.round(at(h), 4) + F.lit(0.0), F.lit(-1.0)).alias(f"w{h}") for h in C.hr_grid],
        num("drift.drift_bpm_per_hr", "drift_bpm_per_hr", -999.0), num("drift.drift_pct_per_hr", "drift_pct_per_hr", -999.0), F.coalesce("drift.n_windows", F.lit(0)).alias("n_windows"),
    )
