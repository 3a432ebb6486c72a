"""Window operators over ordered samples: every one takes the key, order and value columns by name and adds columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing, clip, haversine

#: The 11-point quadratic smoothing weights (x 429) of interior rows and of the first five rows.
SAVGOL = (-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36)
SAVGOL_EDGE = (
    (249, 162, 90, 33, -9, -36, -48, -45, -27, 6, 54),
    (162, 119.4, 82.8, 52.2, 27.6, 9, -3.6, -10.2, -10.8, -5.4, 6),
    (90, 82.8, 74.6, 65.4, 55.2, 44, 31.8, 18.6, 4.4, -10.8, -27),
    (33, 52.2, 65.4, 72.6, 73.8, 69, 58.2, 41.4, 18.6, -10.2, -45),
    (-9, 27.6, 55.2, 73.8, 83.4, 84, 75.6, 58.2, 31.8, -3.6, -48),
)


def ordered(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def ranged(what: str, key: str, axis: str, low: float | None, high: float | None) -> Column:
    """An aggregate (SQL) over the rows within a range of a double axis: low and high are offsets, None is without bound."""

    def bound(x: float | None, side: str) -> str:
        if x is None:
            return f"UNBOUNDED {side}"
        return "CURRENT ROW" if x == 0 else f"{abs(float(x))!r}D {'PRECEDING' if x < 0 else 'FOLLOWING'}"

    return F.expr(f"{what} OVER (PARTITION BY `{key}` ORDER BY `{axis}` RANGE BETWEEN {bound(low, 'PRECEDING')} AND {bound(high, 'FOLLOWING')})")


def cumulative_distance(df: DataFrame, key: str, order: str, lat: str, lon: str, to: str = "cum_dist") -> DataFrame:
    """Metres along the track so far."""
    w = ordered(key, order)
    step = haversine(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon)
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(to, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def mean_around(df: DataFrame, key: str, axis: str, value: str, width: float, to: str) -> DataFrame:
    """Mean of the values within half a width on either side along an axis; a width of 0 or less changes nothing."""
    if width <= 0:
        return df.withColumn(to, F.col(value))
    mean = ranged(f"avg(`{value}`)", key, axis, -width / 2, width / 2)
    return df.withColumn(to, F.when(F.count("*").over(Window.partitionBy(key)) < 3, F.col(value)).otherwise(mean))


def median_around(df: DataFrame, key: str, axis: str, value: str, width: float, to: str) -> DataFrame:
    """Median of the values within half a width on either side along an axis."""
    return df.withColumn(to, ranged(f"percentile(`{value}`, 0.5D)", key, axis, -width / 2, width / 2))


def slope_around(df: DataFrame, key: str, axis: str, value: str, width: float, to: str, min_span: float = 3.0) -> DataFrame:
    """Least-squares slope within half a width on either side; where under three points or a span of ``min_span`` at most: the last one (0 at first)."""
    over = lambda what: ranged(what, key, axis, -width / 2, width / 2)
    enough = (over(f"count(`{value}`)") >= 3) & (over(f"max(`{axis}`)") - over(f"min(`{axis}`)") > min_span)
    own = F.when(enough, over(f"regr_slope(`{value}`, `{axis}`)"))
    carried = F.last("_slope", True).over(ordered(key, axis).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_slope", own).withColumn(to, F.coalesce(carried, F.lit(0.0))).drop("_slope")


def with_integral(df: DataFrame, key: str, time: str, value: str, to: str = "_cum") -> DataFrame:
    """Trapezoid integral of a value over time, from the key's first sample."""
    w = ordered(key, time)
    area = (F.col(time) - F.lag(time).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return df.withColumn("_area", F.coalesce(area, F.lit(0.0))).withColumn(to, F.sum("_area").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_area")


def rolling_mean_time(df: DataFrame, key: str, time: str, value: str, width: float, to: str, centered: bool = False) -> DataFrame:
    """Trapezoid mean over the last ``width`` seconds, or over that width around each sample."""
    low, high = (-width / 2, width / 2) if centered else (-width, 0)
    over = lambda what: ranged(what, key, time, low, high)
    frame = with_integral(df, key, time, value)
    span = over(f"last(`{time}`)") - over(f"first(`{time}`)")
    mean = (over("last(_cum)") - over("first(_cum)")) / F.when(span > 0, span)
    return frame.withColumn(to, F.coalesce(mean, F.col(value))).drop("_cum")


def best_window(df: DataFrame, key: str, time: str, value: str, seconds: float, to: str = "best") -> DataFrame:
    """One row for each key: the highest mean over any window of so many seconds that ends at a sample, its start interpolated;
    the whole mean where the key is shorter (its value where it has one sample); at least 0."""
    frame = with_integral(df, key, time, value)
    low = ranged(f"last(struct(`{time}`, _cum))", key, time, None, -seconds)
    high = ranged(f"first(struct(`{time}`, _cum))", key, time, -seconds, 0)
    frame = frame.select(key, time, "_cum", F.col(value).alias("_v"), low.alias("_low"), high.alias("_high"))
    left = F.col(time) - seconds
    gap = F.col(f"_high.{time}") - F.col(f"_low.{time}")
    at = F.col("_low._cum") + (F.col("_high._cum") - F.col("_low._cum")) * F.coalesce((left - F.col(f"_low.{time}")) / F.when(gap > 0, gap), F.lit(0.0))
    span = F.max(time) - F.min(time)
    whole = F.when(span > 0, F.max_by("_cum", time) / F.when(span > 0, span)).otherwise(F.max("_v"))
    best = F.max((F.col("_cum") - at) / seconds)
    return frame.groupBy(key).agg(F.greatest(F.when(span < seconds, whole).otherwise(best), F.lit(0.0)).alias(to))


def effort_clock(df: DataFrame, key: str, time: str, order: str, active: Column, to: str = "effort_t") -> DataFrame:
    """Seconds so far between samples that are both active."""
    w = ordered(key, order)
    frame = df.withColumn("_on", active)
    step = F.when(F.col("_on") & F.lag("_on").over(w), F.col(time) - F.lag(time).over(w)).otherwise(F.lit(0.0))
    return frame.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(to, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_on", "_step")


def acceleration(df: DataFrame, key: str, time: str, speed: str, to: str = "accel", limit: float = 2.0) -> DataFrame:
    """Change of speed to the next sample, limited; 0 at the last."""
    w = ordered(key, time)
    dt = F.lead(time).over(w) - F.col(time)
    return df.withColumn(to, F.coalesce(clip((F.lead(speed).over(w) - F.col(speed)) / F.when(dt > 0, dt), -limit, limit), F.lit(0.0)))


def forward_bearing(df: DataFrame, key: str, order: str, lat: str, lon: str, to: str = "bearing") -> DataFrame:
    """Bearing to the next sample; the last repeats the one before it."""
    w = ordered(key, order)
    frame = df.withColumn("_b", F.when(F.lead(lat).over(w).isNotNull(), bearing(lat, lon, F.lead(lat).over(w), F.lead(lon).over(w))))
    return frame.withColumn(to, F.coalesce("_b", F.lag("_b").over(w), F.lit(0.0))).drop("_b")


def savgol(df: DataFrame, key: str, order: str, value: str, to: str = "smooth") -> DataFrame:
    """11-point quadratic smoothing, the edges by the polynomial of the first and last 11; under 11 rows: 5-point mean."""
    w = ordered(key, order)
    v = lambda k: F.lag(value, -k).over(w) if k else F.col(value)
    frame = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("_j", F.col("_n") - 1 - F.col("_i"))
    short = F.avg(value).over(w.rowsBetween(-2, 2))
    inner = sum((F.lit(c / 429.0) * v(k - 5) for k, c in enumerate(SAVGOL)), F.lit(0.0))
    out = F.when(F.col("_n") < 11, short).when((F.col("_i") >= 5) & (F.col("_j") >= 5), inner)
    for r, weights in enumerate(SAVGOL_EDGE):
        out = out.when(F.col("_i") == r, sum((F.lit(c / 429.0) * v(k - r) for k, c in enumerate(weights)), F.lit(0.0)))
        out = out.when(F.col("_j") == r, sum((F.lit(c / 429.0) * v(r - k) for k, c in enumerate(weights)), F.lit(0.0)))
    return frame.withColumn(to, out).drop("_i", "_n", "_j")


def gaps(df: DataFrame, key: str, time: str, longest: float, to: str = "after_gap") -> DataFrame:
    """Whether a sample follows a gap."""
    return df.withColumn(to, F.coalesce(F.col(time) - F.lag(time).over(ordered(key, time)) > longest, F.lit(False)))


def fill_linear(df: DataFrame, key: str, axis: str, value: str, to: str = "filled") -> DataFrame:
    """Nulls filled on the line between the neighbours along an axis; beyond the ends the nearest value."""
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(axis).cast("double").alias("x"), F.col(value).alias("y")))
    before = F.last(here, True).over(ordered(key, axis).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(here, True).over(ordered(key, axis).rowsBetween(0, Window.unboundedFollowing))
    frame = df.withColumn("_a", before).withColumn("_b", after)
    width = F.col("_b.x") - F.col("_a.x")
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(axis) - F.col("_a.x")) / F.when(width > 0, width)
    return frame.withColumn(to, F.coalesce(value, line, F.col("_a.y"), F.col("_b.y"))).drop("_a", "_b")


def fill_forward(df: DataFrame, key: str, order: str, value: Column, to: str = "held") -> DataFrame:
    """Nulls take the last value before them, at the start the first after them."""
    frame = df.withColumn("_v", value)
    w = ordered(key, order)
    held = F.coalesce(F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_v", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return frame.withColumn(to, held).drop("_v")


def running_max(df: DataFrame, key: str, order: str, value: str, to: str = "top") -> DataFrame:
    return df.withColumn(to, F.max(value).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def resample(df: DataFrame, key: str, axis: str, values: list[str], n: int) -> DataFrame:
    """n evenly spaced places along each key's axis (all samples where there are no more than n): key, k, axis, values."""
    ends = df.groupBy(key).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"), F.count("*").alias("_n"))
    grid = ends.where(F.col("_n") > n).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / (n - 1))).alias("k", axis))
    samples = df.join(ends.where(F.col("_n") > n).select(key), key, "left_semi").select(key, axis, *values, F.lit(None).cast("int").alias("k"))
    every = samples.unionByName(grid.select(key, axis, *[F.lit(None).cast("double").alias(v) for v in values], "k"))
    point = F.when(F.col("k").isNull(), F.struct(F.col(axis).alias("x"), *values))
    w = ordered(key, axis)
    every = every.withColumn("_p", point)
    low, high = ranged("last(_p, true)", key, axis, None, 0), ranged("first(_p, true)", key, axis, 0, None)
    found = every.withColumn("_a", low).withColumn("_b", high).where("k IS NOT NULL")
    width = F.col("_b.x") - F.col("_a.x")
    share = F.coalesce((F.col(axis) - F.col("_a.x")) / F.when(width > 0, width), F.lit(0.0))
    lines = [F.coalesce(F.col(f"_a.{v}") + (F.col(f"_b.{v}") - F.col(f"_a.{v}")) * share, F.col(f"_a.{v}"), F.col(f"_b.{v}")).alias(v) for v in values]
    raw = df.join(ends.where(F.col("_n") <= n).select(key), key, "left_semi").select(key, (F.row_number().over(w) - 1).alias("k"), axis, *values)
    return found.select(key, "k", axis, *lines).unionByName(raw)


def display_mean(df: DataFrame, key: str, order: str, time: str, value: str, to: str = "shown", rows: int = 12, seconds: float = 16.0) -> DataFrame:
    """Mean of the values within so many rows and so many seconds on either side; nulls do not count."""
    near = F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).over(ordered(key, order).rowsBetween(-rows, rows))
    frame = df.withColumn("_near", near)
    kept = F.filter("_near", lambda s: s["v"].isNotNull() & (F.abs(s["t"] - F.col(time)) <= seconds))
    total = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["v"])
    return frame.withColumn(to, F.when(F.size(kept) > 0, total / F.size(kept))).drop("_near")


def hourly_at(values: Column, hour: Column, circular: bool = False) -> Column:
    """An hourly series (array) at a fractional hour, modulo 24; circular: degrees that turn the short way, the last hour taken as reached from the one before."""
    n = F.size(values)
    at = F.pmod(hour, F.lit(24.0))
    base = F.least(F.floor(at).cast("int"), n - 2) if circular else F.least(F.floor(at).cast("int"), n - 1)
    low, share = F.get(values, base), at - F.floor(at)
    high = F.get(values, F.least(base + 1, n - 1))
    if circular:
        turn = F.pmod(high - low + 180.0, F.lit(360.0)) - 180.0
        return F.pmod(low + turn * share, F.lit(360.0))
    return F.when(at >= n - 1, F.get(values, n - 1)).otherwise(low + (high - low) * share)
