"""Steady efforts and descents: cardiac drift, tagged coasts, training examples, and the climbing check of rolling resistance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import clip
from ..functions.physio import coast_label, logistic, power
from ..schemas import C
from .aggregates import segment_features
from .frames import ordered, rolling_mean_time
from .islands import islands


def steady_blocks(df: DataFrame, key: str, time: str, hr: str, watts: str, mode: str, max_hr: Column) -> DataFrame:
    """The samples of steady effort (past the warm-up, pedalling at a workload, aerobic heart rate), numbered by block: stops of up to
    ``C.drift_gap_s`` between two runs don't end a block. Adds block and smooth (the power's mean around each sample)."""
    w = ordered(key, time)
    frame = rolling_mean_time(df, key, time, watts, C.drift_smooth_s, "smooth", centered=True)
    since = F.col(time) - F.min(time).over(Window.partitionBy(key))
    ready = (since >= C.drift_skip_s) & (F.col(mode) == "pedal") & (F.col("smooth") >= C.drift_watts) & F.col(hr).between(C.drift_hr, 0.94 * max_hr)
    frame = frame.withColumn("_since", since).withColumn("_ready", F.coalesce(ready, F.lit(False)))
    last = F.last(F.when(F.col("_ready"), F.col(time)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("_ready") & ~F.coalesce(F.lag("_ready").over(w), F.lit(False)) & (last.isNull() | (F.col(time) - last > C.drift_gap_s))
    frame = frame.withColumn("_fresh", fresh.cast("long"))
    return frame.withColumn("block", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_ready").drop("_fresh", "_ready")


def cardiac_drift(df: DataFrame, key: str = "ride_id", time: str = "t", hr: str = "hr", watts: str = "watts", speed: str = "speed", mode: str = "mode", max_hr: float = 180.0) -> DataFrame:
    """The rise of the heart rate at a steady effort, one row for each ride that has a steady block of ``C.drift_minutes``.

    A block counts if smoothed power and speed vary little. Along a ride's blocks the later one is better if its drift is over 0.5 bpm/h
    stronger, or no more than 0.5 stronger and of more samples (however weak: a long block speaks for itself). n_windows: all blocks."""
    blocks = steady_blocks(df, key, time, hr, watts, mode, F.lit(max_hr)).groupBy(key, "block").agg(
        F.count("*").alias("n_points"), F.min(time).alias("_a"), F.max(time).alias("_b"), F.min("_since").alias("_since"), F.avg("smooth").alias("_power"), F.avg(hr).alias("_hr"),
        (F.stddev_pop("smooth") / F.greatest(F.avg("smooth"), F.lit(1e-9))).alias("_cv_power"), (F.stddev_pop(speed) / F.greatest(F.avg(speed), F.lit(1e-9))).alias("_cv_speed"),
        F.regr_slope(hr, time).alias("_slope"), F.avg(time).alias("_mid"), F.regr_sxy(hr, time).alias("_sxy"), F.regr_syy(hr, time).alias("_syy"),
    )
    blocks = blocks.withColumn("n_windows", F.count("*").over(Window.partitionBy(key)))
    start = F.col("_hr") + F.col("_slope") * (F.col("_a") - F.col("_mid"))
    good = blocks.where((F.col("_b") - F.col("_a") >= C.drift_minutes * 60) & (F.col("n_points") >= 2) & (F.col("_cv_power") <= C.drift_cv_power) & (F.col("_cv_speed") <= C.drift_cv_speed)).where(start > 0)
    whole = F.when(F.col("_syy") == 0, F.lit(1e-9)).otherwise(F.col("_syy"))
    fields = {
        "block": F.col("block"), "drift_bpm_per_hr": F.round(F.col("_slope") * 3600, 1), "drift_pct_per_hr": F.round(100 * F.col("_slope") * 3600 / start, 1),
        "duration_min": F.round((F.col("_b") - F.col("_a")) / 60, 1), "start_min": F.round(F.col("_since") / 60, 1), "mean_power": F.round("_power", 0), "mean_hr": F.round("_hr", 0), "start_hr": F.round(start, 0),
        "end_hr": F.round(start + F.col("_slope") * (F.col("_b") - F.col("_a")), 0), "r2": F.round(1 - (F.col("_syy") - F.col("_slope") * F.col("_sxy")) / whole, 3), "n_points": F.col("n_points"), "n_windows": F.col("n_windows"),
    }
    line = good.select(key, F.struct(*[c.alias(n) for n, c in fields.items()]).alias("w")).groupBy(key).agg(F.array_sort(F.collect_list("w")).alias("ws"))  # a row for each eight minutes at most

    def better(s: Column, e: Column) -> Column:
        gain = F.abs(e["drift_bpm_per_hr"]) - F.abs(s["drift_bpm_per_hr"])
        return F.when((gain > 0.5) | ((gain <= 0.5) & (e["n_points"] > s["n_points"])), e).otherwise(s)

    best = F.aggregate(F.slice("ws", F.lit(2), F.size("ws")), F.col("ws")[0], better)
    return line.select(key, best.alias("w")).select(key, *[F.col(f"w.{n}").alias(n) for n in fields if n != "block"])


def is_coasting(grade: str, speed: str, hr: str, label: str, max_hr: float | None) -> Column:
    """A moving descent without pedalling: a tag decides, else a heart rate (none passes) under 0.78 of the maximum."""
    down = F.coalesce((F.col(grade) < C.downhill) & (F.col(speed) > 2.0), F.lit(False))
    calm = F.lit(True) if max_hr is None else F.col(hr).isNull() | (F.col(hr) < 0.78 * max_hr)
    return F.when(F.col(label) == "coast", down).when(F.col(label).isin("pedal", "brake"), F.lit(False)).otherwise(down & calm)


def coast_score(max_hr: float) -> Column:
    """Probability of a coast from a segment's features (mean_hr, hr_slope, hr_span, n_hr, accel_sd, low_share), by the cold-start weights."""
    margin, trend, jitter, low, bias = C.coast_weights
    falling = F.when((F.col("n_hr") >= 3) & (F.col("hr_span") > C.trend_s), clip(-6.0 * F.col("hr_slope"), -1.0, 1.0)).otherwise(F.lit(0.0))
    return logistic(margin * (0.78 - F.col("mean_hr") / max_hr) + trend * falling + jitter * F.coalesce(F.col("accel_sd") / 0.3, F.lit(0.0)) + low * F.col("low_share") + bias)


def effective_coasts(df: DataFrame, key: str, order: str, time: str, grade: str, speed: str, hr: str, label: str, max_hr: float, least: int = 10) -> DataFrame:
    """Descents that a fit may trust as coasts: never one with a pedal or brake tag, always one with a coast tag, else one that the classifier is sure of:
    key, island, n, t_start, t_end, source (manual, auto)."""
    runs = islands(df, key, order, (F.col(grade) < C.downhill) & (F.col(speed) > 2.0))
    tags = runs.groupBy(key, "island").agg(F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.max(F.col(label).isin("pedal", "brake").cast("int")).alias("_veto"), F.max((F.col(label) == "coast").cast("int")).alias("_coast"), F.count(hr).alias("n_hr"), (F.max(F.when(F.col(hr).isNotNull(), F.col(time))) - F.min(F.when(F.col(hr).isNotNull(), F.col(time)))).alias("hr_span"))
    features = segment_features(runs, [key, "island"], time, hr, speed, 0.78 * max_hr).where(F.col("n") >= least)
    both = features.join(tags, [key, "island"]).withColumn("_auto", coast_label(coast_score(max_hr), F.col("mean_hr").isNotNull()) == "coast")
    manual = F.coalesce(F.col("_coast"), F.lit(0)) == 1
    return both.where((F.coalesce("_veto", F.lit(0)) == 0) & (manual | F.col("_auto"))).select(key, "island", "n", "t_start", "t_end", F.when(manual, "manual").otherwise("auto").alias("source"))


def training_examples(df: DataFrame, tags: DataFrame, key: str, time: str, hr: str, speed: str, max_hr: float, least: int = 10, width: float = 300.0) -> DataFrame:
    """Features and answer (1 coast, 0 pedal or brake) of each tag(key, k, t_start, t_end, label) that holds ``least`` samples, some of them with
    a heart rate. Tags are dealt to the time slots that they touch, so the join is by equality."""
    slots = tags.where(F.col("label").isin("coast", "pedal", "brake")).select(key, "k", "t_start", "t_end", "label", F.explode(F.sequence(F.floor(F.col("t_start") / width), F.floor(F.col("t_end") / width))).alias("_slot"))
    inside = df.withColumn("_slot", F.floor(F.col(time) / width)).join(slots, [key, "_slot"]).where(F.col(time).between(F.col("t_start"), F.col("t_end")))
    features = segment_features(inside, [key, "k", "label"], time, hr, speed, 0.78 * max_hr)
    return features.where((F.col("n") >= least) & F.col("mean_hr").isNotNull()).withColumn("y", (F.col("label") == "coast").cast("int"))


def climb_diagnostic(df: DataFrame, key: str, order: str, time: str, grade: str, speed: str, elev: str, dist: str, watts: str, accel: str, rho: float, mass: float, least: int = 10) -> DataFrame:
    """Rolling resistance that each climb's wheel work implies: key, crr (median), crr_sigma (1.4826 MAD), n_segments, n_points. It tells whether
    the model agrees with itself and is never applied. Climbs of 50 m and 1 m of rise at least count."""
    parts = power(speed, accel, grade, rho, mass, crr=1.0)
    runs = islands(df, key, order, F.col(grade) > C.climb).withColumn("_known", parts["aero"] + parts["gravity"] + parts["inertia"]).withColumn("_mult", parts["rolling"])
    w = Window.partitionBy(key, "island").orderBy(order)
    ahead = lambda c: F.lead(c).over(w)
    dt = ahead(time) - F.col(time)
    area = lambda c: F.coalesce(dt * (F.col(c) + ahead(c)) / 2, F.lit(0.0))
    rise = lambda c: F.coalesce(F.greatest(ahead(c) - F.col(c), F.lit(0.0)), F.lit(0.0))
    steps = runs.select(key, "island", area(watts).alias("_w"), area("_known").alias("_k"), area("_mult").alias("_m"), rise(dist).alias("_d"), rise(elev).alias("_z"))
    sums = steps.groupBy(key, "island").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("_w", "_k", "_m", "_d", "_z")])
    climbs = sums.where((F.col("n") >= least) & (F.col("_d") > 50) & (F.col("_z") > 1) & (F.col("_w") > 0) & (F.col("_m") > 0)).withColumn("_crr", (C.efficiency * F.col("_w") - F.col("_k")) / F.col("_m"))
    middle = climbs.groupBy(key).agg(F.percentile("_crr", F.lit(0.5)).alias("crr"), F.count("*").alias("n_segments"), F.sum("n").alias("n_points"))
    spread = climbs.join(middle, key).groupBy(key).agg((1.4826 * F.percentile(F.abs(F.col("_crr") - F.col("crr")), F.lit(0.5))).alias("crr_sigma"))
    return middle.join(spread, key)


def acceptable(kind: Column, crr: Column, cda: Column, r2: Column, n_segments: Column, n_rides: Column) -> Column:
    """May a fit be applied (loop, pooled) or recorded (climb)? Unknown kinds never."""
    fine = (F.coalesce(r2, F.lit(0.0)) > 0.6) & (n_segments >= 3) & crr.between(0.002, 0.01) & cda.between(0.2, 0.55)
    climb = (n_segments >= 2) & crr.between(0.0005, 0.05)
    return F.coalesce(F.when(kind == "loop", fine).when(kind == "pooled", fine & (n_rides >= 2)).when(kind == "climb", climb), F.lit(False))


def moving(df: DataFrame, key: str, order: str, speed: str, dist: str, metres: Column, to: str = "moving", least_speed: float = 0.6, least_dist: float = 1.0, least_metres: float = 5.0) -> DataFrame:
    """Is a sample moving: by speed; by distance since the last sample that has one, where speed is lacking or says no; by place, where both are lacking.
    metres: distance to the sample before by their places."""
    w = ordered(key, order)
    step = F.col(dist) - F.last(dist, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when((step >= 0) & (step < 100_000), step)
    known = F.col(speed).isNotNull() & ~F.isnan(speed)
    farther = F.coalesce(step >= least_dist, F.lit(False))
    return df.withColumn(to, F.when(known, (F.col(speed) >= least_speed) | farther).when(step.isNotNull(), farther).otherwise(F.coalesce(metres >= least_metres, F.lit(False))))


