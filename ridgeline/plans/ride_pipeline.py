"""From recorded samples to one row of metrics a ride: elevation, power with its band, metrics. Every step is keyed by ride."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import air_density, clip
from ..functions.physio import confidence, mode, power_band
from ..operators import aggregates as A
from ..operators import frames as W
from ..operators import islands as I
from ..schemas import C


def with_elevation(points: DataFrame, key: str = "ride_id", order: str = "idx", raw: str = "elev") -> DataFrame:
    """Gaps filled, spikes taken out, smoothed along the distance; the grade from slopes over its base, limited."""
    p = W.running_max(points.drop("grade"), key, order, "dist", "along")
    p = W.fill_linear(p, key, order, raw, "elev_filled")
    p = W.median_around(p, key, "along", "elev_filled", C.median_m, "elev_med")
    p = W.mean_around(p, key, "along", "elev_med", C.smooth_m, "elev_smooth")
    p = W.slope_around(p, key, "along", "elev_smooth", C.grade_base_m, "grade_raw")
    return p.withColumn("grade", clip(F.col("grade_raw"), -C.grade_limit, C.grade_limit)).drop("elev_filled", "elev_med", "grade_raw")


def with_power(points: DataFrame, key: str = "ride_id", time: str = "t", order: str = "idx", headwind: Column | None = None, temp_c: float = 15.0, pressure: float = 1013.0, label: str | None = None) -> DataFrame:
    """``powered`` by the smoothed speed and its acceleration, with the air's density by altitude."""
    p = W.acceleration(W.savgol(points, key, order, "speed", "v"), key, time, "v")
    return powered(p, "v", "accel", air_density(temp_c, pressure, "elev_smooth"), headwind=headwind, label=label)


def powered(points: DataFrame, speed: str, accel: str | float, rho: Column | float, mass: float = C.weight_kg + C.bike_kg + C.kit_kg, headwind: Column | None = None, label: str | None = None) -> DataFrame:
    """watts_est, watts_lo, watts_hi, mode and confidence of every sample; no power while coasting or standing.

    label: the column of tags; a descent that is tagged ``pedal`` is pedalled, with the power that its energy balance leaves."""
    parts = power_band(speed, accel, "grade", rho, mass, headwind=F.lit(0.0) if headwind is None else headwind)
    state = mode("grade", speed)
    if label:
        state = F.when(F.coalesce(F.col(label) == "pedal", F.lit(False)), mode(F.lit(0.0), speed)).otherwise(state)
    on = lambda c: F.when(state == "pedal", F.greatest(c, F.lit(0.0))).otherwise(F.lit(0.0))
    return points.withColumns({"watts_est": on(parts["watts"]), "watts_lo": on(parts["lo"]), "watts_hi": on(parts["hi"]), "confidence": confidence(parts["gravity"], parts["watts"]), "mode": state})


def metrics(points: DataFrame, key: str = "ride_id", time: str = "t", max_hr: float = 180.0) -> DataFrame:
    """One row a ride."""
    base = points.groupBy(key).agg(
        (F.max("along") - F.min("along")).alias("distance_m"), (F.max(time) - F.min(time)).alias("duration_s"), F.avg("hr").alias("avg_hr"),
        F.max("speed").alias("max_speed"), F.avg(F.when(F.col("mode") == "pedal", F.col("watts_est"))).alias("avg_watts"), F.avg((F.col("mode") == "pedal").cast("double")).alias("pedalling"),
    )
    tables = [
        A.normalized_power(points, key, time, "watts_est"),
        A.trimp(points, key, time, "hr", max_hr),
        A.calories(points, key, time, "hr", "watts_est", "watts_lo", "watts_hi").select(key, "method", "kcal"),
        A.elevation_gain(points, key, "along", "elev_smooth"),
        I.vam(points, key, "idx", time, "grade", "elev_smooth", C.climb),
        W.best_window(points, key, time, "watts_est", 300.0, "best_5m"),
    ]
    for t in tables:
        base = base.join(t, key, "left")
    return base


def run(points: DataFrame) -> DataFrame:
    """All steps over points(ride_id, idx, t, lat, lon, elev, speed, dist, hr)."""
    return metrics(with_power(with_elevation(points)))
