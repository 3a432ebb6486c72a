"""Per-ride and cross-ride aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import clip
from ..functions.physio import trimp_step, zone_of
from ..schemas import C
from .frames import fill_linear, ordered, rolling_mean_time


def hr_summary(df: DataFrame, key: str, hr: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(hr).alias("avg_hr"), F.max(hr).alias("max_hr"), F.min(hr).alias("min_hr"))


def hr_steps(df: DataFrame, key: str, time: str, hr: str, cap: float = 10.0) -> DataFrame:
    """Rows that have a heart rate, with the seconds since the one before (0 to the cap; 0 at first)."""
    rows = df.where(F.col(hr).isNotNull())
    return rows.withColumn("dt", F.coalesce(clip(F.col(time) - F.lag(time).over(ordered(key, time)), 0.0, cap), F.lit(0.0)))


def trimp(df: DataFrame, key: str, time: str, hr: str, max_hr: float, resting_hr: float = C.resting_hr, female: bool = False) -> DataFrame:
    return hr_steps(df, key, time, hr).groupBy(key).agg(F.sum(trimp_step(hr, "dt", max_hr, resting_hr, female)).alias("trimp"))


def time_in_zone(df: DataFrame, key: str, time: str, hr: str, zones: Column) -> DataFrame:
    """Seconds in each of five zones, as columns z1..z5."""
    rows = hr_steps(df, key, time, hr).withColumn("_z", zone_of(hr, zones))
    return rows.groupBy(key).agg(*[F.sum(F.when(F.col("_z") == k, F.col("dt")).otherwise(F.lit(0.0))).alias(f"z{k + 1}") for k in range(5)])


def ride_shape(df: DataFrame, key: str, mode: str, grade: str, speed: str, lat: str, lon: str) -> DataFrame:
    """Share of pedalling, mean grade, highest speed and centre of each ride."""
    return df.groupBy(key).agg(F.avg((F.col(mode) == "pedal").cast("double")).alias("pedalling"), F.avg(grade).alias("mean_grade"), F.max(speed).alias("max_speed"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def mean_where(df: DataFrame, key: str, value: str, on: Column, to: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(F.when(on, F.col(value))).alias(to))


def normalized_power(df: DataFrame, key: str, time: str, watts: str, width: float = 30.0) -> DataFrame:
    """Fourth root of the time mean of the fourth power of the trailing mean."""
    frame = rolling_mean_time(df, key, time, watts, width, "_m")
    w = ordered(key, time)
    q = F.pow("_m", F.lit(4.0))
    frame = frame.withColumn("_q", q).withColumn("_area", F.coalesce((F.col(time) - F.lag(time).over(w)) * (F.col("_q") + F.lag("_q").over(w)) / 2, F.lit(0.0)))
    span = F.max(time) - F.min(time)
    mean = F.when(span > 0, F.sum("_area") / F.when(span > 0, span)).otherwise(F.avg("_q"))
    return frame.groupBy(key).agg(F.pow(mean, F.lit(0.25)).alias("np"))


def work_kj(df: DataFrame, key: str, time: str, watts: str, cap: float = 30.0) -> DataFrame:
    """Trapezoid work, with steps in time limited."""
    w = ordered(key, time)
    dt = clip(F.col(time) - F.lag(time).over(w), 0.0, cap)
    frame = df.withColumn("_j", F.coalesce(dt * (F.col(watts) + F.lag(watts).over(w)) / 2, F.lit(0.0)))
    return frame.groupBy(key).agg((F.sum("_j") / 1000).alias("work_kj"))


#: Energy by heart rate, kJ a minute = a + b*hr + c*weight + d*age, by sex.
HR_ENERGY = {"male": (-55.0969, 0.6309, 0.1988, 0.2017), "female": (-20.4022, 0.4472, -0.1263, 0.074)}


def hr_energy(df: DataFrame, key: str, time: str, hr: str, sex: str = "male", weight: float = C.weight_kg, age: float = C.age, cap: float = 10.0) -> DataFrame:
    """kcal by the heart-rate equation and the seconds it covers; steps run over every row, with or without heart rate."""
    a, b, c, d = HR_ENERGY[sex]
    dt = F.coalesce(clip(F.col(time) - F.lag(time).over(ordered(key, time)), 0.0, cap), F.lit(0.0))
    rate = F.greatest(a + b * F.col(hr) + c * weight + d * age, F.lit(0.0))
    frame = df.withColumn("_dt", dt)
    sums = frame.groupBy(key).agg(F.sum(F.when(F.col(hr).isNotNull(), rate * F.col("_dt") / 60)).alias("_kj"), F.sum(F.when(F.col(hr).isNotNull(), F.col("_dt")).otherwise(F.lit(0.0))).alias("covered_s"), (F.max(time) - F.min(time)).alias("span_s"))
    return sums.select(key, (F.col("_kj") / C.kj_per_kcal).alias("hr_kcal"), "covered_s", "span_s")


def calories(df: DataFrame, key: str, time: str, hr: str, watts: str, low: str, high: str, moving: DataFrame | None = None, sex: str | None = "male", weight: float = C.weight_kg, age: float = C.age) -> DataFrame:
    """kcal by heart rate where it covers half of the moving time, else by work at the gross efficiency; both ways are reported.

    low, high: the power's band, which becomes the work's. moving: key, moving_s (else the span of the samples). Without a sex the male equation holds
    and the band is wider. By heart rate there is also the mean power that the energy implies, with a band of energy and efficiency together."""
    both = hr_energy(df, key, time, hr, sex or "male", weight, age)
    for column, name in ((watts, "work"), (low, "work_lo"), (high, "work_hi")):
        both = both.join(work_kj(df, key, time, column).withColumnRenamed("work_kj", name), key)
    both = both.join(moving, key, "left") if moving is not None else both.withColumn("moving_s", F.lit(None).cast("double"))
    seconds = F.coalesce("moving_s", "span_s")
    both = both.withColumn("_s", seconds).withColumn("hr_coverage", F.when(seconds > 0, F.col("covered_s") / F.when(seconds > 0, seconds)).otherwise(F.lit(0.0)))
    by_hr = F.coalesce((F.col("hr_kcal") > 0) & (F.col("hr_coverage") >= C.hr_coverage), F.lit(False))
    share = C.hr_energy_share if sex else C.hr_energy_share_unknown
    of_work = lambda c: F.col(c) / C.kj_per_kcal / C.gross_efficiency
    implied = F.when(by_hr & (F.col("_s") > 0), F.col("hr_kcal") * C.kj_per_kcal * C.gross_efficiency * 1000 / F.when(F.col("_s") > 0, F.col("_s")))
    below, above = ((share**2 + ((e - C.gross_efficiency) / C.gross_efficiency) ** 2) ** 0.5 for e in C.efficiency_range)
    return both.select(
        key, F.when(by_hr, "hr").otherwise("power").alias("method"), F.when(by_hr, F.col("hr_kcal")).otherwise(of_work("work")).alias("kcal"),
        F.greatest(F.when(by_hr, F.col("hr_kcal") * (1 - share)).otherwise(of_work("work_lo")), F.lit(0.0)).alias("lo"), F.greatest(F.when(by_hr, F.col("hr_kcal") * (1 + share)).otherwise(of_work("work_hi")), F.lit(0.0)).alias("hi"),
        F.when(F.col("hr_kcal") > 0, F.col("hr_kcal")).alias("hr_kcal"), "hr_coverage", implied.alias("hr_watts"), (implied * (1 - below)).alias("hr_watts_lo"), (implied * (1 + above)).alias("hr_watts_hi"),
        of_work("work").alias("power_kcal"), of_work("work_lo").alias("power_lo"), of_work("work_hi").alias("power_hi"),
    )


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, key: str | None = None) -> DataFrame:
    """Counts in equal bins, values clipped to the range, the last bin closed; bins without values count 0."""
    width = (high - low) / bins
    at = F.least(F.floor((clip(value, low, high) - low) / width).cast("int"), F.lit(bins - 1))
    keys = [key] if key else []
    counts = df.select(*keys, at.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    every = df.select(key).distinct().select(key, grid) if key else df.sparkSession.range(1).select(grid)
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def elevation_gain(df: DataFrame, key: str, dist: str, elev: str, step: float = 25.0, least: float = C.gain_step_m) -> DataFrame:
    """Sum of rises over ``least`` between bins of equal length, empty bins filled on the line."""
    ends = df.groupBy(key).agg(F.min(dist).alias("_lo"), F.max(dist).alias("_hi"))
    n = F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / step).cast("int"), F.lit(1))
    ends = ends.withColumn("_n", n)
    binned = df.join(ends, key).withColumn("bin", F.least(F.floor((F.col(dist) - F.col("_lo")) / step).cast("int"), F.col("_n") - 1))
    means = binned.groupBy(key, "bin").agg(F.avg(elev).alias("z"))
    grid = ends.select(key, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("bin"))
    full = fill_linear(grid.join(means, [key, "bin"], "left"), key, "bin", "z", "z_filled")
    rise = F.col("z_filled") - F.lag("z_filled").over(ordered(key, "bin"))
    return full.withColumn("_r", rise).groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("_r") > least, F.col("_r"))), F.lit(0.0)).alias("gain_m"))


def track_length(df: DataFrame, key: str, order: str, dist: str) -> DataFrame:
    """Sum of the distance's forward steps."""
    step = F.greatest(F.col(dist) - F.lag(dist).over(ordered(key, order)), F.lit(0.0))
    return df.withColumn("_s", step).groupBy(key).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length_m"))


def mad_sigma(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median, and 1.4826 times the median distance from it."""
    middle = df.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    return df.join(middle, key).groupBy(key).agg(F.first("med").alias("med"), (1.4826 * F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5))).alias("sigma"))


def variation(df: DataFrame, key: str, value: str) -> DataFrame:
    """Population deviation over the mean."""
    mean = F.avg(value)
    return df.groupBy(key).agg((F.stddev_pop(value) / F.when(mean != 0, mean)).alias("cv"))


def personal_records(rides: DataFrame, ride: str, metrics: list[str]) -> DataFrame:
    """The ride with the highest positive value of each metric; the first ride wins ties."""
    long = rides.select(ride, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(ride, "x.*").where("value > 0")
    best = long.groupBy("metric").agg(F.max(F.struct("value", (-F.col(ride)).alias("_minus"))).alias("b"))
    return best.select("metric", (-F.col("b._minus")).alias(ride), F.col("b.value").alias("value"))


def heading_gap(df: DataFrame, key: str, bearing: str) -> DataFrame:
    """The widest gap between neighbouring bearings round the circle."""
    w = Window.partitionBy(key).orderBy(bearing)
    ends = df.groupBy(key).agg(F.min(bearing).alias("_lo"), F.max(bearing).alias("_hi"))
    steps = df.withColumn("_g", F.lead(bearing).over(w) - F.col(bearing)).groupBy(key).agg(F.max("_g").alias("_g"))
    return ends.join(steps, key).select(key, F.greatest(F.coalesce("_g", F.lit(0.0)), F.col("_lo") + 6.283185307179586 - F.col("_hi")).alias("gap"))


def wind_sigma(df: DataFrame, key: str, speed: str) -> DataFrame:
    """Uncertainty of a wind from its hourly spread: 0.7 deviations and a half, between 0.5 and 4."""
    return df.groupBy(key).agg(clip(0.7 * F.stddev_pop(speed) + 0.5, 0.5, 4.0).alias("sigma"))


def segment_features(segments: DataFrame, keys: list[str], time: str, hr: str, speed: str, low_hr: float) -> DataFrame:
    """What tells a coast from a pedalled descent: mean heart rate, share below a level, its slope, and the spread of accelerations."""
    w = Window.partitionBy(*keys).orderBy(time)
    dt = F.col(time) - F.lag(time).over(w)
    rows = segments.withColumn("_a", (F.col(speed) - F.lag(speed).over(w)) / F.when(dt > 0, dt))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hr).alias("mean_hr"), F.avg(F.when(F.col(hr).isNotNull(), (F.col(hr) < low_hr).cast("double"))).alias("low_share"), F.regr_slope(hr, time).alias("hr_slope"), F.stddev_pop("_a").alias("accel_sd"))


def quantile_domain(df: DataFrame, key: str, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Axis limits without outliers."""
    return df.groupBy(key).agg(F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi"))


def last_days(rides: DataFrame, day: str, days: float, **sums: str) -> DataFrame:
    """Totals over the last days before the latest ride: one row."""
    latest = rides.agg(F.max(day).alias("_last"))
    recent = rides.join(F.broadcast(latest), F.col(day) > F.col("_last") - days)
    return recent.agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])


def axis_domain(df: DataFrame, key: str, value: str, low: str, high: str, clip_share: float = 0.7) -> DataFrame:
    """A chart's limits: the values' 2nd and 98th percentile, widened to the middle ``clip_share`` of the band's edges and padded by 6 %; eight values
    at most count whole; equal limits get room."""
    edges = df.select(key, F.col(value).cast("double").alias("v"), F.explode(F.array(F.lit(None).cast("double"), F.col(low).cast("double"), F.col(high).cast("double"))).alias("e"))
    tail = (1 - clip_share) / 2
    once = F.when(F.col("e").isNull(), F.col("v"))
    sums = edges.groupBy(key).agg(F.count(once).alias("n"), F.min(once).alias("a"), F.max(once).alias("b"), F.percentile(once, F.lit(0.02)).alias("p"), F.percentile(once, F.lit(0.98)).alias("q"), F.count("e").alias("m"), F.percentile("e", F.lit(tail)).alias("lo"), F.percentile("e", F.lit(1 - tail)).alias("hi"))
    robust = F.col("n") > 8
    least, most = F.when(robust, F.col("p")).otherwise(F.col("a")), F.when(robust, F.col("q")).otherwise(F.col("b"))
    least, most = F.when(F.col("m") > 4, F.least(least, "lo")).otherwise(least), F.when(F.col("m") > 4, F.greatest(most, "hi")).otherwise(most)
    pad = F.when(least == most, F.greatest(F.abs(least) * 0.08, F.lit(1.0))).otherwise((most - least) * F.when(robust, 0.06).otherwise(0.08))
    return sums.select(key, (least - pad).alias("lo"), (most + pad).alias("hi"))


def nearest_rank(df: DataFrame, key: str, value: str, share: float = 0.95) -> DataFrame:
    """Mean, and the value at the rank that a share of the rows reaches: key, mean, rank_value."""
    w = Window.partitionBy(key)
    rows = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    at = F.least(F.floor(F.col("_n") * share).cast("long") + 1, F.col("_n"))
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.max(F.when(F.col("_r") == at, F.col(value))).alias("rank_value"))
