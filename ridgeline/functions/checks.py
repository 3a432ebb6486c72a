"""Column functions that validate, clean or project single values: zones, elevations, cache entries, names, times and ride documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c, in_uk


def valid_zones(zones: Column) -> Column:
    """An array<struct<lo, hi>> of five zones with 30 <= lo < hi <= 250, else null."""
    fine = F.forall(zones, lambda z: F.coalesce((z["lo"] >= 30) & (z["lo"] < z["hi"]) & (z["hi"] <= 250), F.lit(False)))
    return F.when((F.size(zones) == 5) & fine, zones)


def tight_elevation(elev, lat, lon) -> Column:
    """The elevation if a provider may have meant it: -100 to 1000 m, in the UK up to 700 m; else null."""
    z = _c(elev)
    return F.when(z.between(-100.0, 1000.0) & ~F.isnan(z) & (~F.coalesce(in_uk(lat, lon), F.lit(False)) | (z <= 700.0)), z)


def usable_elevation(elev, low: float = 0.0, high: float = 400.0) -> Column:
    """The elevation if it is in range, else null, to be interpolated."""
    return F.when(_c(elev).between(low, high) & ~F.isnan(_c(elev)), _c(elev))


def stale(source, recent, fetched_at, now, failed_s: float = 6 * 3600.0, recent_s: float = 3600.0) -> Column:
    """Is a cached weather entry to be fetched again: defaults after six hours, days that may still be completed after one, an entry without data at once."""
    age = _c(now) - F.coalesce(_c(fetched_at), F.lit(0.0))
    return F.when(_c(source).isNull(), F.lit(True)).when(_c(source) != "open-meteo", age >= failed_s).when(F.coalesce(_c(recent), F.lit(False)), age >= recent_s).otherwise(F.lit(False))


def file_name(path, longest: int = 120) -> Column:
    """The last part of a path with unusual characters as underscores, no dots around it; 'upload' where nothing is left."""
    base = F.regexp_replace(_c(path), r".*[/\\]", "")
    clean = F.regexp_replace(F.trim(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), F.lit(".")), "^$", "upload")
    return F.substring(clean, 1, longest)


def local_time(ts, zone) -> Column:
    """A UTC time in a zone (a column or a name)."""
    return F.from_utc_timestamp(_c(ts).cast("timestamp"), zone)


def first_of(document, paths: list[str], *others) -> Column:
    """The first of a JSON document's values at these paths, then of the other columns, that is not null."""
    return F.coalesce(*[F.get_json_object(_c(document), p).cast("double") for p in paths], *[_c(o).cast("double") for o in others])


def duration_text(seconds) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.bround(_c(seconds)).cast("long")
    minutes = F.floor(s / 60) % 60
    return F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600).cast("string"), F.lpad(minutes.cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))).otherwise(F.concat_ws(":", minutes.cast("string"), F.lpad((s % 60).cast("string"), 2, "0")))


def gust_sigma(speeds: Column, gust, wind) -> Column:
    """Uncertainty of a ride's wind: 0.7 deviations of the hourly speeds and a half (three hours at least), no less than 0.4 of the gusts' excess; 0.5 to 4."""
    known = F.filter(speeds, lambda x: x.isNotNull())
    n = F.nullif(F.size(known), F.lit(0))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    hourly = F.when(n >= 3, F.least(F.greatest(spread * 0.7 + 0.5, F.lit(0.5)), F.lit(4.0)))
    excess = _c(gust) - _c(wind)
    margin = F.when(excess.isNotNull(), F.greatest(excess, F.lit(0.0))) * 0.4  # greatest skips nulls
    gusty = F.least(F.greatest(margin, F.lit(0.5)), F.lit(4.0))
    return F.when(margin.isNull(), hourly).otherwise(F.greatest(F.coalesce(hourly, F.lit(0.0)), gusty))


def aligned_pairs(speeds: Column, directions: Column) -> Column:
    """Pairs of the hours that have both values: array<struct<speed, direction>>, so entry i of both is the same hour."""
    both = F.arrays_zip(speeds.alias("speed"), directions.alias("direction"))
    return F.filter(both, lambda p: p["speed"].isNotNull() & p["direction"].isNotNull())
