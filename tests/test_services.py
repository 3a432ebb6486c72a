"""Weather answers and point elevations against plain Python: chunks, retries, caches, broken answers."""

import datetime
import json
import statistics
import tempfile
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from ridgeline.sources import point_elevation as E
from ridgeline.sources import weather as W


def at(text):
    return datetime.datetime.fromisoformat(text)


def body(hours=24, zone="Europe/London", **series):
    names = {n: series.get(n, [float(i) for i in range(hours)]) for n in W.SERIES}
    return json.dumps({"timezone": zone, "hourly": {"time": [f"T{i:02d}" for i in range(hours)], **{W.SERIES[n]: v for n, v in names.items()}}})


def asked(spark, rows, **how):
    return W.asked(spark.createDataFrame(rows, "ride_id long, lat double, lon double, start timestamp"), **how)


def answers(spark, rows):
    return spark.createDataFrame(rows, "lat_e3 long, lon_e3 long, day date, body string, fetched_at double, recent boolean")


def test_the_day_is_the_places_own(spark):
    rows = [(1, 51.5, -0.1, at("2024-06-30T23:30:00")), (2, 51.5, -0.1, at("2024-01-31T23:30:00")), (3, 35.0, 139.0, at("2024-01-31T15:30:00")), (4, None, 1.0, at("2024-01-31T15:30:00")), (5, float("nan"), 1.0, at("2024-01-31T15:30:00")), (6, 51.5, -0.1, None)]
    found = {r["ride_id"]: (str(r["day"]), r["zone"], r["lat_e3"]) for r in asked(spark, rows, other_zone="Asia/Tokyo").collect()}
    assert found == {1: ("2024-07-01", "Europe/London", 51500), 2: ("2024-01-31", "Europe/London", 51500), 3: ("2024-02-01", "Asia/Tokyo", 35000), **{i: ("None", None, None) for i in (4, 5, 6)}}
    assert asked(spark, rows[2:3], other_zone="auto").first()["zone"] == "UTC"


def weathers(spark, bodies, start="2024-06-30T08:00:00"):
    """The weather that each body gives to a ride at 08:00 UTC, 09:00 in London."""
    rides = asked(spark, [(i, 50.0 + i / 100, -1.0, at(start)) for i in range(len(bodies))])
    held = answers(spark, [(50000 + 10 * i, -1000, at(start).date(), b, 1.0, False) for i, b in enumerate(bodies)])
    return [r.asDict() for r in W.at_rides(rides, held).orderBy("ride_id").collect()]


def test_values_of_the_hour_in_metres_a_second(spark):
    wind = [float(i * 3.6) for i in range(24)]
    gust = [w + 36.0 for w in wind]
    holes = [None if i % 2 else 5.0 for i in range(24)]
    full, short, hole, elsewhere, strange = weathers(spark, [body(wind_speed=wind, gust=gust), body(3), body(wind_speed=holes, wind_dir=[None if i % 3 else float(i) for i in range(24)]), body(zone="America/New_York"), body(zone="Not/There")])
    sigma = max(min(4.0, 0.7 * statistics.pstdev(range(24)) + 0.5), min(4.0, 0.4 * 10))
    assert (full["temp_c"], round(full["wind_speed_mps"], 9), full["ride_hour"], full["source"], round(full["wind_sigma_mps"], 9)) == (9.0, 9.0, 9, "open-meteo", round(sigma, 9))
    assert short["temp_c"] == 2.0 and len(short["wind_speed_hourly"]) == 3
    assert hole["wind_speed_mps"] == 0.0 and hole["wind_dir_deg"] == 9.0 and hole["wind_dir_hourly"] == [0.0, 6.0, 12.0, 18.0]  # hour 9 has no speed; pairs keep their hours
    assert elsewhere["ride_hour"] == 4 and strange["ride_hour"] == 9


def test_broken_answers_give_defaults(spark):
    rows = weathers(spark, ["", "{", "[]", "{}", None, '{"hourly": 3}', '{"hourly": {}}', body(0), body(wind_speed=[None] * 24)])
    assert [r["source"] for r in rows] == ["defaults"] * 6 + ["open-meteo"] * 3
    assert {(r["temp_c"], r["wind_speed_mps"], r["wind_dir_deg"], r["pressure_hpa"]) for r in rows[:8]} == {(15.0, 0.0, 0.0, 1013.0)}
    assert rows[8]["wind_speed_hourly"] is None and rows[8]["wind_sigma_mps"] is None
    assert weathers(spark, [None])[0]["wind_sigma_mps"] is None


def test_rows_of_hours_and_the_latest_answer(spark):
    day = datetime.date(2024, 1, 1)
    held = answers(spark, [(1, 2, day, body(2), 1.0, False), (1, 2, day, body(3, temp=[7.0]), 2.0, False), (1, 3, day, "{", 1.0, False), (None, 3, day, body(2), 1.0, False)])
    found = [(r["hour"], r["time"], r["temp"], r["pressure"]) for r in W.hourly(held).orderBy("hour").collect()]
    assert found == [(0, "T00", 7.0, 0.0), (1, "T01", None, 1.0), (2, "T02", None, 2.0)]
    assert W.hourly(held.limit(0)).count() == 0


def test_what_is_to_be_fetched(spark):
    rides = asked(spark, [(i, 50.0 + i, 0.0, at("2024-05-05T12:00:00")) for i in range(5)] + [(9, 51.0, 0.0, at("2024-05-05T13:00:00")), (10, None, None, None)])
    day, now = datetime.date(2024, 5, 5), 100_000.0
    held = answers(spark, [(51000, 0, day, body(), 0.0, False), (52000, 0, day, "{", now - 7 * 3600, False), (53000, 0, day, "{", now - 5 * 3600, False), (54000, 0, day, body(), now - 3601, True)])
    assert sorted(r["lat_e3"] for r in W.to_fetch(rides, held, now).collect()) == [50000, 52000, 54000]
    assert W.to_fetch(rides, held.limit(0), now).count() == 5
    assert [r[0] for r in spark.range(1).select(W.recent(F.lit("2024-05-01").cast("date"), F.lit("2024-05-07").cast("date"))).collect()] == [True]


@pytest.mark.parametrize("failures,tries,waits,right", [([], 3, [], True), ([OSError], 3, [1.0], True), ([E.TooMany, OSError], 3, [2.0, 2.0], True), (["short", "short", "short"], 3, [1.0, 2.0], False), ([OSError], 1, [], False)])
def test_a_chunk_is_whole_or_nothing(failures, tries, waits, right):
    left, waited = list(failures), []

    def fetch(places):
        if left:
            f = left.pop(0)
            if f == "short":
                return [1.0]
            raise f
        return [p[0] for p in places]

    assert E.whole_chunk(fetch, [(1.0, 2.0), (3.0, 4.0)], tries, waited.append) == ([1.0, 3.0] if right else None)
    assert waited == waits


def calls(log):
    def fetch(places):
        with open(log, "a") as f:
            f.write(json.dumps(places) + "\n")
        if any(abs(lat - 50.0105) < 1e-9 for lat, _ in places):
            raise OSError
        return [None if round(lat * 1e4) % 2 else 120.0 for lat, _ in places]

    return fetch


def test_chunks_cache_and_failures(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    log, cache = f"{folder}/log", f"{folder}/cache"
    places = [(50 + i / 1e4, 1.0) for i in range(250)]
    points = spark.createDataFrame([(a, b) for a, b in places * 2] + [(None, 1.0), (50.0, None), (float("nan"), 1.0)], "lat double, lon double")
    made = lambda: [json.loads(line) for line in open(log)]
    how = {"lane": F.lit(0), "interval": 0.0, "tries": 1}
    found = E.sampled(points, cache, "dem", calls(log), **how).groupBy("elev_state").count().collect()
    assert [len(c) for c in made()] == [90, 90, 70] and [tuple(p) for c in made() for p in c] == places
    assert dict(found) == {"fetched": 320, "failed": 180, "none": 3}
    assert E.cached(spark, cache, "dem").count() == 160 and E.cached(spark, cache, "other").count() == 0
    again = E.sampled(points, cache, "dem", calls(log), **how).collect()
    assert [len(c) for c in made()[3:]] == [90]  # the failed chunk's places alone
    assert {(r["elev_state"], r["elev_point"]) for r in again} == {("cached", 120.0), ("cached", None), ("failed", None), ("none", None)}
    E.sampled(points, cache, "dem", calls(log), ask_unknown_again=True, **how)
    assert sum(len(c) for c in made()[4:]) == 90 + 80


def test_lanes_make_the_same_rows(spark):
    cache = lambda: tempfile.mkdtemp(prefix="spark-") + "/cache"
    points = spark.range(1000).select("id", (50 + F.col("id") / 300).alias("lat"), (F.col("id") % 7 / 10).alias("lon"))
    rows = [sorted(tuple(r) for r in E.sampled(points, cache(), "dem", lambda p: [lat + lon for lat, lon in p], lanes=n, interval=0.0).collect()) for n in (1, 3)]
    assert rows[0] == rows[1] and len(rows[0]) == 1000 and all(abs(r[3] - r[1] - r[2]) < 2e-6 for r in rows[0])
    assert E.sampled(points.limit(0), cache(), "dem", lambda p: 1 / 0).count() == 0


def test_london_hours_as_the_zone_tables_say(spark):
    hours = [at("2024-03-31T00:30:00"), at("2024-03-31T01:30:00"), at("2024-10-27T00:30:00"), at("2024-10-27T01:30:00")]
    rows = asked(spark, [(i, 51.0, 0.0, t) for i, t in enumerate(hours)])
    held = answers(spark, [(51000, 0, t.date(), body(), 1.0, False) for t in (hours[0], hours[2])])
    found = [r["ride_hour"] for r in W.at_rides(rows, held).orderBy("ride_id").collect()]
    assert found == [t.replace(tzinfo=datetime.timezone.utc).astimezone(ZoneInfo("Europe/London")).hour for t in hours]
