"""Efforts, descents, ride joins and stored rides on rides with a known answer."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import checks
from ridgeline.operators import aggregates, efforts, fits, folds, joins, routes
from ridgeline.plans import storage
from ridgeline.sources import activity
from ridgeline.streaming import imports

SAMPLES = "ride_id long, idx long, t double, speed double, watts double, hr double, mode string"


def drift_ride(swing=6.0, pause=None, rise=15.0):
    """35 minutes at 200 W, heart rate from 128 up by ``rise`` in 30 minutes; with a pause of so many seconds after 20 minutes."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(2100):
        t = i + (pause if pause and i >= 1200 else 0)
        watts = 200 + (rng.normal(0, swing) if swing < 50 else swing * np.sin(2 * np.pi * i / 300))
        rows.append((1, i, float(t), 8.0, float(watts), float(128 + rise * t / 1800 + rng.normal(0, 0.8)), "pedal"))
        if pause and i == 1199:
            rows += [(1, 10_000 + k, float(1200 + k), 0.0, 0.0, 110.0, "static") for k in range(0, int(pause), 5)]
    return rows


def test_drift_of_a_steady_ride(spark):
    got = efforts.cardiac_drift(spark.createDataFrame(drift_ride(), SAMPLES), max_hr=185.0).first()
    assert got["drift_bpm_per_hr"] == pytest.approx(30, abs=3) and got["r2"] > 0.8 and got["start_min"] == 4.0 and got["n_windows"] == 1


def test_no_drift_where_the_effort_changes(spark):
    rows = [r for r in drift_ride(swing=140.0)]
    assert efforts.cardiac_drift(spark.createDataFrame(rows, SAMPLES), max_hr=185.0).count() == 0
    assert efforts.cardiac_drift(spark.createDataFrame([], SAMPLES)).count() == 0


@pytest.mark.parametrize(("pause", "windows"), [(60, 1), (400, 2)])
def test_drift_bridges_short_stops(spark, pause, windows):
    got = efforts.cardiac_drift(spark.createDataFrame(drift_ride(pause=pause), SAMPLES), max_hr=185.0).first()
    assert got["n_windows"] == windows and got["drift_bpm_per_hr"] == pytest.approx(30, abs=4)


def test_tags_overrule_heart_rate(spark):
    rows = [(1, "coast", 170.0), (2, "pedal", 90.0), (3, None, 170.0), (4, None, None), (5, "brake", 90.0)]
    df = spark.createDataFrame(rows, "id long, label string, hr double").withColumn("grade", F.lit(-0.03)).withColumn("speed", F.lit(9.0))
    got = {r["id"]: r["on"] for r in df.select("id", efforts.is_coasting("grade", "speed", "hr", "label", 180.0).alias("on")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert not df.withColumn("grade", F.lit(0.01)).where(efforts.is_coasting("grade", "speed", "hr", "label", None)).count()


def test_effective_coasts_veto_and_classifier(spark):
    rows = [(n, k, float(k), -0.05, 8.0, hr, label if k == 5 else None) for n, (hr, label) in enumerate([(90.0, None), (160.0, None), (160.0, "coast"), (90.0, "pedal"), (None, None)]) for k in range(40)]
    df = spark.createDataFrame(rows, "ride_id long, idx long, t double, grade double, speed double, hr double, label string")
    got = {r["ride_id"]: r["source"] for r in efforts.effective_coasts(df, "ride_id", "idx", "t", "grade", "speed", "hr", "label", 180.0).collect()}
    assert got == {0: "auto", 2: "manual"}


def test_climb_diagnostic_finds_the_model_s_own_value(spark):
    from ridgeline.functions.physio import power

    rows = [(1, i, float(i), 0.06, 4.0, 100.0 + i * 0.24, i * 4.0) for i in range(120)]
    df = spark.createDataFrame(rows, "ride_id long, idx long, t double, grade double, speed double, elev double, dist double").withColumn("accel", F.lit(0.0))
    df = df.withColumn("watts", power("speed", "accel", "grade", 1.2, 86.0, crr=0.006)["watts"])
    got = efforts.climb_diagnostic(df, "ride_id", "idx", "t", "grade", "speed", "elev", "dist", "watts", "accel", 1.2, 86.0).first()
    assert got["crr"] == pytest.approx(0.006, abs=1e-9) and got["crr_sigma"] == pytest.approx(0, abs=1e-9)


def test_robust_line_shrugs_off_spikes(spark):
    rng = np.random.default_rng(1)
    hr = rng.uniform(110, 170, 200)
    watts = 2 * (hr - 100) + rng.normal(0, 2, 200)
    watts[:12] += 300
    rows = [(1, float(a), float(b), "high", "pedal") for a, b in zip(hr, watts)] + [(2, 120.0, 100.0, "high", "pedal")] + [(1, 150.0, 900.0, "low", "pedal")] * 50
    df = spark.createDataFrame(rows, "ride_id long, hr double, watts double, confidence string, mode string")
    got = {(r["ride_id"], r["hr"]): r for r in fits.watts_at_fixed_hr(df, "ride_id", "hr", "watts", "confidence", "mode").collect()}
    assert got[1, 140]["watts"] == pytest.approx(80, abs=3) and got[1, 140]["n"] == 200 and got[1, 140]["lo"] < 80 < got[1, 140]["hi"]
    assert got[2, 140]["watts"] is None and got[2, 140]["n"] == 0
    assert fits.robust_lines(np.column_stack([hr, np.ones(200)]), watts)[0] == pytest.approx(2, abs=0.1)


def test_line_of_heart_rates_that_hardly_differ(spark):
    """The line through points that lie on it."""
    rng = np.random.default_rng(11)
    hr = 150 + rng.integers(-8, 9, 60) / 2**17
    rows = [(1, float(h), float(200 + 4096 * (h - 150)), "high", "pedal") for h in hr]  # all numbers are exact
    df = spark.createDataFrame(rows, "ride_id long, hr double, watts double, confidence string, mode string")
    got = {r["hr"]: r["watts"] for r in fits.watts_at_fixed_hr(df, "ride_id", "hr", "watts", "confidence", "mode").collect()}
    for h in (130, 140, 150, 160):
        assert got[h] == pytest.approx(200 + 4096 * (h - 150), abs=1e-8)


def test_joins_keep_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 700.0), (2, 5.0), (1, None)], "k long, t double")
    spans = spark.createDataFrame([(1, 0.0, 10.0, "a", 1), (1, 4.0, 400.0, "b", 2)], "k long, s double, e double, label string, o int")
    got = sorted((r["k"], r["t"], r["tag"]) for r in joins.in_intervals(rows.where("t IS NOT NULL"), spans, "k", "t", "s", "e", "label", "o", "tag").collect())
    assert got == sorted([(1, 5.0, "b"), (1, 5.0, "b"), (1, 700.0, None), (2, 5.0, None)], key=lambda r: (r[0], r[1]))
    assert joins.in_intervals(rows, spans, "k", "t", "s", "e", "label", "o", "tag").count() == 5
    left = spark.createDataFrame([(1, 0.0, 9.0), (1, 0.0, 9.0), (1, 50.0, 60.0)], "k long, a double, b double")
    right = spark.createDataFrame([(1, 1.0, 8.0, "x", 2), (1, -1.0, 10.0, "y", 1)], "k long, a double, b double, v string, o int")
    assert sorted(str(r["tag"]) for r in joins.in_band(left, right, "k", ["a", "b"], 2.0, "v", "o", "tag").collect()) == ["None", "y", "y"]


def test_a_clique_of_rides_takes_few_rounds(spark, monkeypatch):
    n, rounds = 200, []
    rides = spark.createDataFrame([(i, float(i)) for i in range(n)], "ride_id long, started_at double")
    edges = spark.createDataFrame([(i, j, True, float(abs(i - j))) for i in range(n) for j in range(i)], "later long, earlier long, same_route boolean, mean_m double")
    real = routes.stored
    monkeypatch.setattr(routes, "stored", lambda df, name: rounds.append(name) or real(df, name))
    got = routes.grouped(rides, edges).collect()
    assert {r["ref_ride_id"] for r in got} == {0} and len(got) == n and len(rounds) < 12


def test_limiter_on_a_long_ride(spark):
    n = 200_000
    rng = np.random.default_rng(2)
    values = np.cumsum(rng.normal(0, 3, n)) + 500 * (rng.random(n) < 0.01)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "ride_id long, idx long, watts double")
    began = time.time()
    got = [r["steady"] for r in folds.limited_jumps(df, "ride_id", "idx", "watts").orderBy("idx").select("steady").collect()]
    assert time.time() - began < 120
    med = [float(np.median(values[max(0, i - 2) : i + 3])) for i in range(n)]
    held = [med[0]]
    for m in med[1:]:
        held.append(min(max(m, held[-1] - 20), held[-1] + 20))
    want = [float(np.mean(held[max(0, i - 2) : i + 3])) for i in range(0, n, 997)]
    assert got[::997] == pytest.approx(want)


def test_training_load_over_many_years(spark):
    """Blocks of time give the same as the recurrence; a repeated day and a gap of years included."""
    rng = np.random.default_rng(5)
    days = np.sort(np.concatenate([rng.integers(0, 9000, 400), [3, 3, 20_000]])).astype(float)
    loads = rng.uniform(0, 200, len(days))
    df = spark.createDataFrame([(1, float(d), i, float(x)) for i, (d, x) in enumerate(zip(days, loads))], "rider long, day double, id long, trimp double")
    got = {r["id"]: (r["ctl"], r["atl"], r["tsb"]) for r in folds.training_load(df, "rider", "day", "id", "trimp").collect()}
    c = a = 0.0
    for i, (d, x) in enumerate(zip(days, loads)):
        gap = d - days[i - 1] if i else 0.0
        c, a = c * np.exp(-gap / 42), a * np.exp(-gap / 7)
        before = c - a
        c, a = c + x * (1 - np.exp(-1 / 42)), a + x * (1 - np.exp(-1 / 7))
        assert got[i] == pytest.approx((c, a, before), abs=1e-6)


def test_calories_of_unknown_sex_and_by_power(spark):
    rows = [(1, float(t), 140.0, 200.0) for t in range(600)] + [(2, float(t), None, 200.0) for t in range(600)]
    df = spark.createDataFrame(rows, "ride_id long, t double, hr double, watts double").withColumn("lo", F.col("watts") * 0.8).withColumn("hi", F.col("watts") * 1.3)
    got = {r["ride_id"]: r for r in aggregates.calories(df, "ride_id", "t", "hr", "watts", "lo", "hi", sex=None).collect()}
    assert got[1]["method"] == "hr" and got[1]["lo"] / got[1]["kcal"] == pytest.approx(0.78) and got[1]["hr_watts_lo"] < got[1]["hr_watts"] < got[1]["hr_watts_hi"]
    assert got[2]["method"] == "power" and got[2]["hr_watts"] is None and got[2]["kcal"] == pytest.approx(200 * 599 / 4184 / 0.239) and got[2]["hi"] / got[2]["kcal"] == pytest.approx(1.3)
    known = aggregates.calories(df.where("ride_id = 1"), "ride_id", "t", "hr", "watts", "lo", "hi", spark.createDataFrame([(1, 2000.0)], "ride_id long, moving_s double")).first()
    assert known["method"] == "power" and known["hr_coverage"] == pytest.approx(599 / 2000)


def test_metadata_of_a_file():
    fields = [(253, 4, 0x86), (5, 4, 0x86)]
    records = [{253: 1000 + k, 5: 100 * k} for k in range(20)]
    session = [(2, 4, 0x86), (5, 1, 0x02), (7, 4, 0x86), (8, 4, 0x86), (17, 1, 0x02)]
    data = activity.encode_all([(activity.FILE_ID, [(0, 1, 0x00), (1, 2, 0x84), (4, 4, 0x86)], [{0: 4, 1: 260, 4: 900}]), (20, fields, records), (activity.SESSION, session, [{2: 990, 7: 19_000, 8: 12_500, 17: 171}]), (activity.SPORT, [(0, 1, 0x00)], [{0: 2}])])
    got = activity.metadata("x", data)
    assert (got["start_t"], got["end_t"]) == (990.0 + activity.EPOCH, 1019.0 + activity.EPOCH)
    assert (got["duration_s"], got["total_elapsed"], got["max_hr"], got["sport"], got["manufacturer"], got["point_count"], got["total_distance"]) == (12.5, 19.0, 171, 2, 260, 20, 19.0)
    plain = activity.metadata("y", activity.encode(records, fields))
    assert plain["duration_s"] == 19.0 and plain["start_t"] == 1000.0 + activity.EPOCH
    with pytest.raises(ValueError, match="activity"):
        activity.metadata("z", b"nothing")


def test_rewriting_some_keys_leaves_the_rest(spark, tmp_path):
    path = f"{tmp_path}/rides"
    df = spark.createDataFrame([(k, i, float(i)) for k in range(30) for i in range(4)], "ride_id long, idx long, watts double")
    storage.write_by_key(df, path, "ride_id")
    storage.rewrite_keys(spark, path, "ride_id", spark.createDataFrame([(3, 0, -1.0), (99, 0, 5.0)], df.schema))
    got = {}
    for r in storage.read_by_key(spark, path).collect():
        got.setdefault(r["ride_id"], []).append(r["watts"])
    assert got[3] == [-1.0] and got[99] == [5.0] and all(sorted(got[k]) == [0.0, 1.0, 2.0, 3.0] for k in range(30) if k != 3) and len(got) == 31


def test_checks_of_odd_values(spark):
    df = spark.createDataFrame([(None, None, None), ("open-meteo", True, 0.0), ("default", False, 99_000.0), ("open-meteo", False, 0.0)], "source string, recent boolean, at double")
    assert [r[0] for r in df.select(checks.stale("source", "recent", "at", 100_000.0)).collect()] == [True, True, False, False]
    names = spark.createDataFrame([("../..",), ("a b.fit",), ("c:\\x\\...",)], "p string")
    assert [r[0] for r in names.select(checks.file_name("p")).collect()] == ["upload", "a_b.fit", "upload"]
    assert [r[0] for r in spark.createDataFrame([(59.6,), (3600.0,), (7.0,)], "s double").select(checks.duration_text("s")).collect()] == ["1:00", "1:00:00", "0:07"]


def test_heavy_fits_only_in_small_libraries(spark):
    assert imports.few_enough(spark.range(50)) and not imports.few_enough(spark.range(51))


def test_import_in_quiet_intervals(spark, tmp_path):
    drop, table = tmp_path / "drop", str(tmp_path / "table")
    drop.mkdir()
    for n in range(3):
        (drop / f"{n}.fit").write_bytes(activity.encode([{253: 100 + 50 * n + k, 0: 10**8, 1: 10**8} for k in range(25)], activity.ALTITUDE_FIELDS))
    batches = []
    stream = imports.import_batches(imports.without_repeats(imports.arriving_files(spark, str(drop))), table, str(tmp_path / "log"), lambda rows, n: batches.append(n), quiet="500 milliseconds")
    try:
        stream.processAllAvailable()
        got = spark.read.parquet(table)
        assert got.count() == 75 and got.select("batch").distinct().count() == 1 and batches[0] == 0
    finally:
        stream.stop()
