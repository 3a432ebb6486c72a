"""Constants and table schemas of the ride-analytics engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Constants:
    """Fixed values that results depend on."""

    earth_m: float = 6371000.0
    metres_per_degree: float = 111320.0
    gravity: float = 9.80665
    kit_kg: float = 2.0
    # elevation
    smooth_m: float = 25.0
    median_m: float = 30.0
    grade_base_m: float = 60.0
    gain_step_m: float = 0.2
    grade_limit: float = 0.35
    downhill: float = -0.01
    climb: float = 0.03
    # rider and bike
    age: int = 40
    weight_kg: float = 75.0
    resting_hr: float = 55.0
    bike_kg: float = 9.0
    crr: float = 0.005
    cda: float = 0.35
    efficiency: float = 0.97
    # standard deviations of the power model's inputs
    sigma_wind: float = 2.0
    sigma_cda: float = 0.20
    sigma_cda_calibrated: float = 0.06
    sigma_crr: float = 0.25
    sigma_crr_calibrated: float = 0.08
    sigma_grade: float = 0.005
    sigma_mass: float = 1.5
    sigma_rho: float = 0.015
    # load and energy
    trimp_male: tuple[float, float] = (0.64, 1.92)
    trimp_female: tuple[float, float] = (0.86, 1.67)
    ctl_days: float = 42.0
    atl_days: float = 7.0
    kj_per_kcal: float = 4.184
    gross_efficiency: float = 0.239
    efficiency_range: tuple[float, float] = (0.20, 0.25)
    hr_energy_share: float = 0.15
    hr_energy_share_unknown: float = 0.22
    hr_coverage: float = 0.5
    hr_grid: tuple[int, ...] = (130, 140, 150, 160)
    curve_minutes: tuple[int, ...] = (1, 2, 5, 10, 20, 30, 60)
    # cardiac drift
    drift_minutes: float = 8.0
    drift_skip_s: float = 240.0
    drift_watts: float = 60.0
    drift_hr: float = 100.0
    drift_smooth_s: float = 60.0
    drift_gap_s: float = 90.0
    drift_cv_power: float = 0.25
    drift_cv_speed: float = 0.35
    # routes
    route_points: int = 120
    route_mean_m: float = 25.0
    route_p95_m: float = 45.0
    route_length_ratio: float = 1.25
    route_pad_m: float = 60.0
    snap_m: float = 30.0
    # descents
    coast_accept: float = 0.90
    coast_reject: float = 0.10
    coast_weights: tuple[float, ...] = (16.356, 0.8, -0.8, 1.0, -1.636)
    coast_scales: tuple[float, ...] = (0.15, 0.4, 0.4, 0.4)
    coast_radius: float = 3.0
    trend_s: float = 30.0


C = Constants()

POINT = T.StructType(
    [T.StructField("ride_id", T.LongType()), T.StructField("idx", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("t", "lat", "lon", "elev_raw", "elev", "grade", "speed", "dist")]
)
COAST_SEGMENT = T.StructType(
    [T.StructField("ride_id", T.LongType()), T.StructField("t_start", T.DoubleType()), T.StructField("t_end", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("source", T.StringType()), T.StructField("score", T.DoubleType())]
)
