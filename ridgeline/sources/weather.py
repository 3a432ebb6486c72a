"""Hourly weather as an archive service answers for a place and a day: JSON to rows of hours, and to the weather of each ride.

A request is known by its latitude and longitude to three places and the ride's local date. Answers are a table (place columns, ``day``, ``body``, ``fetched_at``, ``recent``), so the service itself
is any job that fills it; ``to_fetch`` says what it has to ask for. Speeds come in km/h and are m/s here.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import aligned_pairs, gust_sigma, local_time, stale
from ..functions.geo import _c, in_uk

#: The names of the answer's series, and what is taken where nothing is known.
SERIES = {"temp": "temperature_2m", "wind_speed": "wind_speed_10m", "wind_dir": "wind_direction_10m", "pressure": "pressure_msl", "gust": "wind_gusts_10m"}
DEFAULTS = {"temp_c": 15.0, "wind_speed_mps": 0.0, "wind_dir_deg": 0.0, "pressure_hpa": 1013.0}
SOURCE, NO_SOURCE = "open-meteo", "defaults"
RECENT_DAYS = 6
RESPONSE = "timezone string, hourly struct<time: array<string>, " + ", ".join(f"{s}: array<double>" for s in SERIES.values()) + ">"
KEY = ["lat_e3", "lon_e3", "day"]


def known_zone(name: Column) -> Column:
    """The name of a zone, or null for one that is not known, as converting by it would end the job."""
    return F.when(name.isin(sorted(available_timezones())) | name.rlike(r"^[+-](0[0-9]|1[0-7]):[0-5][0-9]$"), name)


def zone(lat, lon, other: Column | str = "UTC") -> Column:
    """The time zone of a place: the UK's, else the given one (a name or a column; null or unknown: UTC)."""
    rest = F.coalesce(known_zone(F.lit(other) if isinstance(other, str) else other), F.lit("UTC"))
    return F.when(F.coalesce(in_uk(lat, lon), F.lit(False)), "Europe/London").otherwise(rest)


def asked(rides: DataFrame, lat: str = "lat", lon: str = "lon", start: str = "start", other_zone: Column | str = "UTC") -> DataFrame:
    """Rides with lat_e3, lon_e3, day and zone of their request; without a place or a start all are null. start: a UTC time stamp."""
    z = zone(lat, lon, other_zone)
    known = _c(lat).isNotNull() & _c(lon).isNotNull() & ~F.isnan(_c(lat)) & ~F.isnan(_c(lon)) & _c(start).isNotNull()
    place = lambda c: F.when(known, F.round(_c(c).cast("double") * 1000).cast("long"))
    return rides.withColumns({"lat_e3": place(lat), "lon_e3": place(lon), "day": F.when(known, local_time(start, z).cast("date")), "zone": F.when(known, z)})


def latest(answers: DataFrame) -> DataFrame:
    """One answer a request: the one that was fetched last (the greater body, at one time)."""
    newest = F.max(F.struct("fetched_at", "body", "recent")).alias("_a")
    return answers.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY)).groupBy(*KEY).agg(newest).select(*KEY, "_a.*")


def parsed(answers: DataFrame) -> DataFrame:
    """The answers with their source, zone and series, missing or broken ones without; speeds in m/s."""
    r = F.from_json("body", RESPONSE)
    metric = lambda name: F.transform(F.col(f"_r.hourly.{SERIES[name]}"), lambda x: x / 3.6)
    series = {n: metric(n) if n in ("wind_speed", "gust") else F.col(f"_r.hourly.{s}") for n, s in SERIES.items()}
    found = answers.withColumn("_r", r)
    source = F.when(F.col("_r.hourly").isNotNull(), SOURCE).otherwise(NO_SOURCE)
    return found.withColumns({"source": source, "answer_zone": F.col("_r.timezone"), "times": F.col("_r.hourly.time"), **series}).drop("_r")


def hourly(answers: DataFrame) -> DataFrame:
    """lat_e3, lon_e3, day, hour, time, temp, wind_speed, wind_dir, pressure, gust: a row an hour of each readable answer; a value that a shorter series lacks is null."""
    names = ["times", *SERIES]
    a = parsed(latest(answers)).where(F.col("source") == SOURCE)
    h = a.select(*KEY, F.posexplode(F.arrays_zip(*[F.coalesce(F.col(n), F.array().cast("array<string>" if n == "times" else "array<double>")).alias(n) for n in names])).alias("hour", "_h"))
    return h.select(*KEY, "hour", F.col("_h.times").alias("time"), *[f"_h.{n}" for n in SERIES])


def _at(values: Column, index: Column) -> Column:
    """The value at an index, the last one beyond the end, null in an empty series."""
    return F.get(values, F.least(index, F.size(values) - 1))


def at_rides(rides: DataFrame, answers: DataFrame, start: str = "start") -> DataFrame:
    """Rides that ``asked`` has keyed, each with its weather: temp_c, wind_speed_mps, wind_dir_deg, pressure_hpa, wind_sigma_mps, ride_hour, wind_speed_hourly, wind_dir_hourly, source.

    The hour is the start's in the zone that the answer names. Where a value or the whole answer is missing the default stands; a ride is never lost. The two hourly series hold the
    hours that have both values, so entry i of both is the same hour."""
    a = parsed(latest(answers)).select(*KEY, "source", "answer_zone", "times", *SERIES)
    clash = [c for c in a.columns if c not in KEY and c in rides.columns]
    if clash:
        raise ValueError(f"rides already have {clash}")
    j = rides.join(a, KEY, "left")
    known = F.coalesce(F.col("source") == SOURCE, F.lit(False))
    hour = F.hour(local_time(start, F.coalesce(known_zone(F.col("answer_zone")), F.col("zone"))))
    n = F.size(F.coalesce("times", F.array().cast("array<string>")))
    index = F.when(hour < n, hour).otherwise(F.greatest(n - 1, F.lit(0)))
    value = {s: _at(F.col(s), index) for s in SERIES}
    pairs = aligned_pairs(F.col("wind_speed"), F.col("wind_dir"))
    or_default = lambda name, to: F.when(known, F.coalesce(value[name], F.lit(DEFAULTS[to]))).otherwise(DEFAULTS[to]).alias(to)
    part = lambda field: F.when(known & (F.size(pairs) > 0), F.transform(pairs, lambda p: p[field]))
    return j.select(
        *[F.col(f"`{c}`") for c in rides.columns], or_default("temp", "temp_c"), or_default("wind_speed", "wind_speed_mps"), or_default("wind_dir", "wind_dir_deg"), or_default("pressure", "pressure_hpa"),
        F.when(known, gust_sigma(F.coalesce("wind_speed", F.array().cast("array<double>")), value["gust"], value["wind_speed"])).alias("wind_sigma_mps"), F.when(known, hour).alias("ride_hour"),
        part("speed").alias("wind_speed_hourly"), part("direction").alias("wind_dir_hourly"), F.coalesce("source", F.lit(NO_SOURCE)).alias("source"),
    )


def recent(day, today) -> Column:
    """Is a day one that the archive may still complete?"""
    return F.datediff(_c(today), _c(day)) <= RECENT_DAYS


def to_fetch(rides: DataFrame, answers: DataFrame, now: float) -> DataFrame:
    """lat_e3, lon_e3, day, zone: each request of the keyed rides once, if it has no answer yet or a stale one (``checks.stale``)."""
    wanted = rides.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY)).groupBy(*KEY).agg(F.min("zone").alias("zone"))
    held = parsed(latest(answers))
    fresh = held.where(~stale(F.col("source"), F.col("recent"), F.col("fetched_at"), F.lit(now))).select(*KEY)
    return wanted.join(fresh, KEY, "left_anti")
