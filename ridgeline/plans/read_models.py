"""What a reader of a ride asks for at once: all of its metrics as one document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physio import hr_zones, vo2max
from ..operators import aggregates as A
from ..operators import efforts
from ..operators import frames as W
from ..operators.fits import watts_at_fixed_hr
from ..schemas import C


def _curve(p: DataFrame, key: str, time: str, watts: str) -> DataFrame:
    """key, curve: a map of minutes to the best mean power over them."""
    parts = [W.best_window(p, key, time, watts, 60.0 * m, f"best_{m}") for m in C.curve_minutes]
    joined = reduce(lambda a, b: a.join(b, key, "left"), parts)
    return joined.select(key, F.map_from_arrays(F.array(*[F.lit(m) for m in C.curve_minutes]), F.array(*[F.col(f"best_{m}") for m in C.curve_minutes])).alias("curve"))


def metrics_document(samples: DataFrame, key: str = "ride_id", time: str = "t", hr: str = "hr", watts: str = "watts", speed: str = "speed", mode: str = "mode", confidence: Column | None = None, max_hr: float = 180.0, resting_hr: float = C.resting_hr, weight_kg: float = C.weight_kg) -> DataFrame:
    """One row a ride: n_points, duration_s, max_speed, has_hr, heart(avg, max, min, trimp, zones), power(avg, normalized, pedalling, work_kj, vo2max, curve), watts_at_hr, drift.

    The parts are structs, so a reader's column selection prunes them. zones: seconds in each of five zones. curve: best mean power by minutes; a ride that is shorter has its whole mean there.
    watts_at_hr: an array of structs by heart rate, null where too few samples carry the line. drift: null without a steady block. Heart is null for a ride without heart rates, and so is drift.
    confidence: which samples the line trusts (default: all). Samples are dealt by ride once; every part's frames and sums use that partitioning. A null key is no ride."""
    trusted = F.lit("high") if confidence is None else confidence
    p = samples.where(F.col(f"`{key}`").isNotNull()).select(key, time, hr, watts, speed, mode, trusted.alias("_trust")).repartition(key)
    pedal = F.col(mode) == "pedal"
    base = p.groupBy(key).agg(
        F.count("*").alias("n_points"), (F.max(time) - F.min(time)).alias("duration_s"), F.max(speed).alias("max_speed"), (F.count(hr) > 0).alias("has_hr"), F.avg(F.when(pedal, F.col(watts))).alias("_avg"), F.avg(pedal.cast("double")).alias("_pedalling")
    )
    zones = A.time_in_zone(p, key, time, hr, hr_zones(F.lit(max_hr), F.lit(resting_hr)))
    line = watts_at_fixed_hr(p, key, hr, watts, "_trust", mode).groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("hr", "watts", "lo", "hi", "r2", "n")))).alias("_line"))  # four rows a ride
    steady = efforts.cardiac_drift(p, key, time, hr, watts, speed, mode, max_hr)
    drift = steady.select(key, F.struct(*[c for c in steady.columns if c != key]).alias("drift"))
    parts = [
        A.hr_summary(p, key, hr), A.trimp(p, key, time, hr, max_hr, resting_hr), zones, A.normalized_power(p, key, time, watts), A.work_kj(p, key, time, watts), _curve(p, key, time, watts), line, drift,
    ]
    d = reduce(lambda a, b: a.join(b, key, "left"), parts, base)
    heart = F.struct(F.col("avg_hr").alias("avg"), F.col("max_hr").alias("max"), F.col("min_hr").alias("min"), "trimp", F.array(*[f"z{k}" for k in range(1, 6)]).alias("zones"))
    power = F.struct(F.col("_avg").alias("avg"), F.col("np").alias("normalized"), F.col("_pedalling").alias("pedalling"), "work_kj", vo2max(F.col("curve")[5], weight_kg).alias("vo2max"), "curve")
    return d.select(
        key, "n_points", "duration_s", "max_speed", "has_hr", F.when(F.col("has_hr"), heart).alias("heart"), power.alias("power"), F.when(F.size("_line") > 0, F.col("_line")).alias("watts_at_hr"), F.when(F.col("has_hr"), F.col("drift")).alias("drift")
    )
