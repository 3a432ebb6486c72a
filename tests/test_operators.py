"""Operators without SQL, and known results, against small brute-force versions."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo, physio
from ridgeline.operators import aggregates, fits, folds, frames, joins, routes, selection
from ridgeline.plans import ride_pipeline
from ridgeline.sources import activity, raster
from ridgeline.streaming import imports


DATA = "/root/testdata/sf0.001"


def ride(spark, rows, columns="ride_id long, idx long, t double, watts double"):
    return spark.createDataFrame(rows, columns)


def test_normalized_power_brute_force(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 600, 300))
    w = rng.uniform(0, 400, 300)
    df = ride(spark, [(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, w))])
    cum = np.concatenate([[0], np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2)])
    mean = []
    for i in range(300):
        j = int(np.searchsorted(t, t[i] - 30, "left"))
        mean.append((cum[i] - cum[j]) / (t[i] - t[j]) if t[i] > t[j] else w[i])
    q = np.array(mean) ** 4
    expected = (np.sum(np.diff(t) * (q[1:] + q[:-1]) / 2) / (t[-1] - t[0])) ** 0.25
    assert aggregates.normalized_power(df, "ride_id", "t", "watts").first()["np"] == pytest.approx(expected)


def test_steady_power_is_itself(spark):
    df = ride(spark, [(1, i, float(i), 206.0) for i in range(900)])
    assert aggregates.normalized_power(df, "ride_id", "t", "watts").first()["np"] == pytest.approx(206)
    assert frames.best_window(df, "ride_id", "t", "watts", 300.0).first()["best"] == pytest.approx(206)
    assert aggregates.work_kj(df, "ride_id", "t", "watts").first()["work_kj"] == pytest.approx(206 * 899 / 1000)


def test_best_window_finds_a_surge(spark):
    df = ride(spark, [(1, i, float(i), 309.0 if 400 <= i < 700 else 206.0) for i in range(1200)])
    assert frames.best_window(df, "ride_id", "t", "watts", 300.0).first()["best"] == pytest.approx(309, rel=0.01)


def test_circular_hours(spark):
    df = spark.createDataFrame([(0.5,), (23.0,)], "h double")
    series = F.array(F.lit(350.0), F.lit(10.0), *[F.lit(90.0)] * 22)
    got = [r[0] for r in df.select(frames.hourly_at(series, F.col("h"), circular=True)).collect()]
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(90)


def test_jump_limiter_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 60, 50)
    df = ride(spark, [(1, i, float(i), float(x)) for i, x in enumerate(v)])
    med = [float(np.median(v[max(0, i - 2) : i + 3])) for i in range(50)]
    held = [med[0]]
    for m in med[1:]:
        held.append(min(max(m, held[-1] - 20), held[-1] + 20))
    expected = [float(np.mean(held[max(0, i - 2) : i + 3])) for i in range(50)]
    got = [r["steady"] for r in folds.limited_jumps(df, "ride_id", "idx", "watts").orderBy("idx").collect()]
    assert got == pytest.approx(expected)


def test_drift_window_rule(spark):
    df = spark.createDataFrame([(1, 0, 10.0, 5), (1, 1, 10.3, 9), (1, 2, -20.0, 3), (1, 3, 19.8, 2)], "ride_id long, block long, drift double, n long")
    assert folds.best_of_windows(df, "ride_id", "block", "drift", "n").first()["block"] == 2


def test_robust_line_ignores_outliers(spark):
    rng = np.random.default_rng(1)
    hr = rng.uniform(110, 170, 200)
    w = 2 * (hr - 100) + rng.normal(0, 2, 200)
    w[:12] += 300
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(hr, w)], "ride_id long, hr double, watts double")
    at = {r["hr"]: r["watts"] for r in fits.watts_at_hr(df).collect()}
    assert at[140] == pytest.approx(80, abs=12)


def loop_steps(crr, cda, wind, direction, ride_id=1, segments=8, mass=86.0, rho=1.225):
    rows = []
    for s in range(segments):
        heading = s * 2 * math.pi / segments
        v = 6.0 + s % 3
        for _ in range(20):
            along = v + wind * math.cos(heading - direction)
            across = wind * math.sin(direction - heading)
            force = crr * mass * 9.80665 + 0.5 * rho * cda * math.hypot(along, across) * along
            rise = -0.05 * v
            dv2 = -2 * (force * v + mass * 9.80665 * rise) / mass
            rows.append((ride_id, s, 1.0, v, heading, dv2, rise))
            v = max(3.0, math.sqrt(max(v * v + dv2, 9.0)))
    return rows


STEPS = "ride_id long, segment long, dt double, v double, heading double, dv2 double, rise double"


def test_loop_calibration_recovers_truth(spark):
    got = fits.loop_calibration(spark.createDataFrame(loop_steps(0.005, 0.32, 3.0, 1.0), STEPS)).first()
    assert got["crr"] == pytest.approx(0.005, abs=0.0015) and got["cda"] == pytest.approx(0.32, abs=0.05) and got["r2"] > 0.9


def test_one_heading_is_not_enough(spark):
    rows = [(r, s, d, v, 0.1, a, b) for r, s, d, v, _, a, b in loop_steps(0.005, 0.32, 0.0, 0.0)]
    assert fits.loop_calibration(spark.createDataFrame(rows, STEPS)).count() == 0


def test_pooled_calibration(spark):
    rows = loop_steps(0.005, 0.32, 3.0, 1.0, 1) + loop_steps(0.005, 0.32, 2.0, 4.0, 2)
    got = fits.pooled_calibration(spark.createDataFrame(rows, STEPS))
    assert got["crr"] == pytest.approx(0.005, abs=0.0015) and got["cda"] == pytest.approx(0.32, abs=0.03)


def test_classifier_moves_from_prior(spark):
    df = spark.createDataFrame([(float(x), int(x > 0)) for x in np.random.default_rng(2).normal(0, 1, 200)], "a double, y int")
    w = fits.fit_classifier(df, ["a"], "y", (0.5, 0.0))
    assert 0.5 < w[0] <= 0.5 + 0.6 * 0.5 + 0.5
    assert fits.fit_classifier(df.limit(0), ["a"], "y", (0.5, 0.0)) == pytest.approx([0.5, 0.0])


def square(ride_id, lat, lon, size, shift=0.0, n=200):
    out = []
    for k in range(n):
        s = (k / n + shift) % 1 * 4
        side, f = int(s), s % 1
        y, x = [(0, f), (f, 1), (1, 1 - f), (1 - f, 0)][side]
        out.append((ride_id, k, lat + y * size, lon + x * size))
    return out


def test_routes_group_whatever_their_start(spark):
    rows = square(1, 52.0, -1.5, 0.02) + square(2, 52.0, -1.5, 0.02, 0.3) + square(3, 52.0, -1.5, 0.02, 0.45) + square(4, 52.3, -1.0, 0.03)
    p = spark.createDataFrame(rows, "ride_id long, idx long, lat double, lon double")
    prints = routes.fingerprints(p, n=60)
    starts = spark.createDataFrame([(i, float(i)) for i in range(1, 5)], "ride_id long, started_at double")
    got = {r["ride_id"]: r["ref_ride_id"] for r in routes.grouped(starts, routes.similarities(prints)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_activity_times_and_escape():
    body = bytes([0x40, 0, 0, 20, 0, 3, 253, 4, 0x86, 0, 4, 0x85, 1, 4, 0x85])
    place = struct.pack("<ii", 10**8, 10**8)
    body += b"\0" + struct.pack("<I", 1000) + place + bytes([0x80 | 5]) + place + bytes([0x80 | 31, 56]) + place + bytes([0x80 | 3]) + place
    head = struct.pack("<BBHI4s", 12, 16, 0, len(body), b".FIT")
    rows = activity.records("x", head + body + b"\0\0")
    assert [r[2] - activity.EPOCH for r in rows][:2] == [1000, 1005] and rows[0][-2] is None
    assert [r[2] - activity.EPOCH for r in rows][2:] == [1080, 1083]


def test_activity_source_and_checksum(spark, tmp_path):
    data = activity.encode([{253: 100 + k, 0: 10**8, 1: 10**8, 3: 120 + k} for k in range(30)], activity.ALTITUDE_FIELDS)
    (tmp_path / "a.fit").write_bytes(data)
    (tmp_path / "b.fit").write_bytes(data[:-2] + b"\1\2")
    spark.dataSource.register(activity.ActivitySource)
    got = spark.read.format("activity").load(str(tmp_path))
    assert got.count() == 60 and got.where("crc_valid").count() == 30
    assert activity.read(spark, str(tmp_path)).select("t", "hr", "crc_valid").exceptAll(got.select("t", "hr", "crc_valid")).count() == 0
    assert activity.checksum(data) == (True, "reflected")


def test_raster_deflate_and_lzw():
    def lzw(data):
        out, table, width, acc, bits = bytearray(), {bytes([i]): i for i in range(256)}, 9, 0, 0

        def put(code):
            nonlocal acc, bits
            acc, bits = acc << width | code, bits + width
            while bits >= 8:
                bits -= 8
                out.append(acc >> bits & 255)

        put(256)
        size, word = 258, b""
        for b in data:
            b = bytes([b])
            if word + b in table:
                word += b
            else:
                put(table[word])
                table[word + b] = size
                size += 1
                width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
                word = b
                if size == 4000:
                    put(table[word])
                    put(256)
                    table, size, width, word = {bytes([i]): i for i in range(256)}, 258, 9, b""
        if word:
            put(table[word])
        put(257)
        if bits:
            out.append(acc << 8 - bits & 255)
        return bytes(out)

    z = np.random.default_rng(4).integers(1, 9, (33, 47)).astype("<f4")
    import zlib

    for packing, pack in ((1, bytes), (8, zlib.compress), (5, lzw)):
        raw = pack(z.tobytes())
        tags = [(256, 4, 47), (257, 4, 33), (258, 3, 32), (259, 3, packing), (273, 4, 8 + 2 + 12 * 8 + 4), (278, 4, 33), (279, 4, len(raw)), (339, 3, 3)]
        ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<I", v)) for t, k, v in tags) + b"\0\0\0\0"
        assert np.allclose(raster.read_raster(b"II*\0" + struct.pack("<I", 8) + ifd + raw), z)


def test_bilinear_and_cascade(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], 0.5, 0.5), ([[1.0, 2.0], [3.0, 4.0]], 1.5, 0.0)], "r array<array<double>>, y double, x double")
    assert [r[0] for r in df.select(raster.bilinear(F.col("r"), F.col("y"), F.col("x"))).collect()] == [2.5, None]
    df = spark.createDataFrame([(1, 1.0, 9.0), (1, None, 8.0), (2, None, 7.0), (2, None, None)], "k long, a double, b double")
    assert sorted(r["z"] or 0 for r in raster.cascade(df, "k", "a", ["b"], "z").collect()) == [0, 1.0, 7.0, 8.0]


def test_grid_reference(spark):
    east, north = geo.osgb36(F.lit(52.657977), F.lit(1.716038))
    got = spark.range(1).select(east, north).first()
    assert got[0] == pytest.approx(651409.903, abs=5) and got[1] == pytest.approx(313177.270, abs=5)


def test_altitude_codes(spark):
    df = spark.createDataFrame([(123.4,), (None,)], "z double")
    got = [r[0] for r in df.select(physio.altitude_of(physio.altitude_code("z"))).collect()]
    assert got == [pytest.approx(123.4), None]


def test_sex_changes_trimp(spark):
    df = spark.createDataFrame([(1, float(i), 150.0) for i in range(60)], "ride_id long, t double, hr double")
    male, female = (aggregates.trimp(df, "ride_id", "t", "hr", 180.0, female=f).first()["trimp"] for f in (False, True))
    assert male != female


def test_elevation_gain_of_a_slope(spark):
    df = spark.createDataFrame([(1, float(i) * 2.5, float(i) * 0.05) for i in range(201)], "ride_id long, dist double, elev double")
    assert 9 <= aggregates.elevation_gain(df, "ride_id", "dist", "elev").first()["gain_m"] <= 10.5


def test_interval_join_last_wins(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 500.0)], "k long, t double")
    spans = spark.createDataFrame([(1, 0.0, 10.0, "a", 1), (1, 4.0, 900.0, "b", 2)], "k long, s double, e double, label string, o int")
    assert {r["t"]: r["tag"] for r in joins.in_intervals(rows, spans, "k", "t", "s", "e", "label", "o", "tag").collect()} == {5.0: "b", 500.0: "b"}


def test_retention_keeps_protected(spark):
    df = spark.createDataFrame([(i, i % 50 == 0) for i in range(400)], "id long, busy boolean")
    got = selection.retained(df, F.col("id"), F.col("busy"), 200)
    assert got.count() == 200 and got.where("busy").count() == 8


def test_training_load_stream_equals_batch(spark, tmp_path):
    rows = [(1, float(d), 50.0 + d) for d in range(10)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "rider long, day double, trimp double").coalesce(1).write.parquet(src)
    stream = imports.training_load(spark.readStream.schema("rider long, day double, trimp double").parquet(src))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()
    got = {r["day"]: r["ctl"] for r in spark.read.parquet(out).collect()}
    events = spark.createDataFrame([(a, b, i, c) for i, (a, b, c) in enumerate(rows)], "rider long, day double, id long, trimp double")
    want = {float(r["id"]): r["ctl"] for r in folds.training_load(events, "rider", "day", "id", "trimp").collect()}
    assert got == pytest.approx(want)


def test_import_stream_is_idempotent(spark, tmp_path):
    drop, table = tmp_path / "drop", str(tmp_path / "table")
    drop.mkdir()
    data = activity.encode([{253: 100 + k, 0: 10**8, 1: 10**8} for k in range(25)], activity.ALTITUDE_FIELDS)
    (drop / "a.fit").write_bytes(data)
    (drop / "copy.fit").write_bytes(data)
    files = imports.without_repeats(imports.arriving_files(spark, str(drop)))
    imports.import_batches(files, table, str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(table).count() == 25


def test_pipeline_on_a_steady_ride(spark):
    rows = [(1, i, float(i), 52.0 + i * 5e-5, -1.5, 100.0 + i * 0.05, 5.5, i * 5.5, 140.0) for i in range(400)]
    p = spark.createDataFrame(rows, "ride_id long, idx long, t double, lat double, lon double, elev double, speed double, dist double, hr double")
    got = ride_pipeline.run(p).first()
    assert got["distance_m"] == pytest.approx(399 * 5.5) and got["avg_watts"] > 50 and got["gain_m"] > 15


def test_empty_ride_table(spark):
    df = ride(spark, [])
    assert aggregates.normalized_power(df, "ride_id", "t", "watts").count() == 0
    assert pd.DataFrame(frames.best_window(df, "ride_id", "t", "watts", 60.0).collect()).empty


def test_point_to_segment_all_segments(spark):
    from ridgeline.queries import QUERIES

    found = QUERIES["point_to_segment_all"](spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.where("seg % 50 <> 0").count() > 0
    assert "NestedLoop" not in QUERIES["point_to_segment_all"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_nearest_example_with_many_examples(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, (2500, 3)), rng.normal(0, 1, (10_500, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(-1, None), (-2, [1.0]), (-3, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    examples = spark.createDataFrame([(v.tolist(),) for v in b], "v array<double>")
    got = {r["id"]: r["far"] for r in joins.nearest_example(df, examples, "v", [1.0, 2.0, 0.5], "far").collect()}
    want = [np.sqrt((((b - v) / [1.0, 2.0, 0.5]) ** 2).sum(1).min()) for v in a]
    assert [got[i] for i in range(2500)] == pytest.approx(want) and got[-1] is got[-2] is got[-3] is None
    assert {r["far"] for r in joins.nearest_example(df, examples.limit(0), "v", None, "far").collect()} == {None}


def test_pooled_fit_keeps_rides_off_the_driver(spark, monkeypatch):
    from ridgeline.queries import QUERIES

    rounds, winds = [], fits._winds
    monkeypatch.setattr(fits, "_winds", lambda *a: rounds.append(a) or winds(*a))
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self: pytest.fail("rides on the driver"))
    assert QUERIES["pooled_fit"](spark, DATA).count() == 1 and len(rounds) == 4


def test_routes_and_loops_take_production_parameters(spark, monkeypatch):
    from ridgeline import queries_fits

    rows = [(7, s, 1.0, 5.0, a, -1.0, -0.1) for s, a in enumerate((0.0, math.pi))]  # opposite headings leave no gap over half a circle
    monkeypatch.setattr(queries_fits, "_steps", lambda *_: spark.createDataFrame(rows, STEPS))
    assert queries_fits.loop_fit(spark, DATA).count() == 0
    prints, similar = [], routes.similarities
    monkeypatch.setattr(routes, "similarities", lambda p: prints.append(p) or similar(p))
    few = queries_fits.points(spark, DATA).where("ride_id < 4")
    monkeypatch.setattr(queries_fits, "points", lambda *_: few)
    found = queries_fits.route_clusters(spark, DATA)
    assert found.count() == few.select("ride_id").distinct().count()
    long = few.groupBy("ride_id").count().where("count > 20").count()
    assert long and prints[0].where("size(pts) > 20").count() == long


def test_known_winds_of_few_segments(spark, monkeypatch):
    """Five segments leave a second optimum close to the truth; a fit of several hundred rides takes seconds."""
    from ridgeline import queries_fits

    rides = [(57841, 59)] + [(k, 55 + k % 40) for k in range(500)]
    rows = [(k, i) for k, n in rides for i in range(n)]
    monkeypatch.setattr(queries_fits, "points", lambda *_: spark.createDataFrame(rows, "ride_id long, idx long"))
    loops = {r["ride_id"]: r for r in queries_fits.loop_fit_known(spark, DATA).collect()}
    pool = {r["ride_id"]: r for r in queries_fits.pooled_fit_known(spark, DATA).collect()}
    assert set(loops) == set(pool) == {k for k, _ in rides}
    for k in loops:
        want = (0.005, 0.32, 1.0 + k % 4, 10.0 + k * 37 % 340)
        assert all((r["crr"], r["cda"], r["wind"], r["wind_dir"]) == want for r in (loops[k], pool[k])) and loops[k]["recovered"] and pool[k]["ok"]


def test_a_held_fit_finds_each_wind(spark):
    rows = [(k, *r[1:]) for k in range(3) for r in loop_steps(0.005, 0.32, 3.0, 1.0 + k)]
    got = {r["ride_id"]: r for r in fits._winds(spark.createDataFrame(rows, STEPS), "ride_id", 86.0, 1.225, 0.005, 0.32).collect()}
    assert set(got) == {0, 1, 2}
    for k, r in got.items():
        assert r["wind"] == pytest.approx(3.0, abs=1e-9) and r["dir"] == pytest.approx(1.0 + k, abs=1e-9)


def test_nearest_segment_measures_places_and_lines_once(spark, monkeypatch):
    """Many points on few places and many copies of few lines: each pair of a place and a line is measured once, ties go to the lowest seg."""
    points = spark.range(20_000).select(F.col("id").alias("i"), (52.0 + F.col("id") % 40 * 1e-4).alias("lat"), (-1.5 + F.col("id") % 5 * 1e-4).alias("lon")).unionByName(spark.createDataFrame([(-1, None, 0.0), (-2, 10.0, 10.0)], "i long, lat double, lon double"))
    roads = spark.range(20_000).select((20_000 - F.col("id")).alias("seg"), (52.0 + F.col("id") % 20 * 2e-4).alias("lat1"), F.lit(-1.5).alias("lon1"), (52.0 + F.col("id") % 20 * 2e-4).alias("lat2"), F.lit(-1.4995).alias("lon2"))
    got = joins.nearest_segment(points, roads, ["i"], "lat", "lon")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and got.count() == 20_002
    found = {r["i"]: (r["seg"], r["metres"]) for r in got.where("i < 280").collect()}
    assert found[-1] == found[-2] == (None, None)
    for i in range(280):
        far = {k: abs(i % 40 * 1e-4 - k * 2e-4) * 111320 for k in range(20)}
        least = min(far.values())
        segs = [20_000 - 19_980 - k for k, d in far.items() if d < least + 1e-6]  # the last of a thousand copies has the lowest seg
        assert found[i][1] == pytest.approx(least, abs=1e-6) and found[i][0] in segs


def test_boxes_of_one_place_are_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BOXES", 50)
    rng = np.random.default_rng(8)
    rows = [(int(k), float(a), float(b), float(a + c), float(b + d)) for k, a, b, c, d in zip(rng.permutation(400), rng.uniform(0, 0.1, 400), rng.uniform(0, 0.1, 400), rng.uniform(0, 0.02, 400), rng.uniform(0, 0.02, 400))]
    rows += [rows[0], (None, 0.0, 0.0, 1.0, 1.0)]  # a key that comes twice does not meet itself
    boxes = spark.createDataFrame(rows, "ride_id long, south double, west double, north double, east double")
    pairs = joins.overlapping_boxes(boxes, "ride_id", 0.001)
    meet = lambda p, q: all(p[k] - 0.001 <= q[k + 2] + 0.001 and q[k] - 0.001 <= p[k + 2] + 0.001 for k in (1, 2))
    want = sorted((p[0], q[0]) for p in rows[:-1] for q in rows[:-1] if p[0] < q[0] and meet(p, q))
    assert sorted(tuple(r) for r in pairs.collect()) == want
    assert pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 1


def test_pairs_of_points_and_segments_are_shared_by_tasks(spark):
    from ridgeline.queries import QUERIES

    sizes = QUERIES["point_to_segment_all"](spark, DATA).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in sizes) > 1


def test_equal_tracks_are_measured_once(spark, monkeypatch):
    rng, tables = np.random.default_rng(9), {}
    tracks = [[(52 + 1e-4 * k + rng.normal(0, 2e-5), -1.5 + shift) for k in range(30)] for shift in (0.0, 1e-4, 5e-4)]
    boxes = [(min(p[0] for p in t), min(p[1] for p in t), max(p[0] for p in t), max(p[1] for p in t)) for t in tracks]
    rows = [(r, [(k, *place) for k, place in enumerate(tracks[r % 3])], 330.0 + r % 2, *boxes[r % 3]) for r in range(90)]
    prints = spark.createDataFrame(rows, "ride_id long, pts array<struct<k:int,lat:double,lon:double>>, length_m double, south double, west double, north double, east double")
    stored = routes.stored
    monkeypatch.setattr(routes, "stored", lambda df, name: tables.setdefault(name, stored(df, name)))
    pts = {r: tracks[r % 3] for r in range(90)}
    got = {(r["later"], r["earlier"]): r for r in routes.similarities(prints).collect()}
    assert set(got) == {(a, b) for a in range(90) for b in range(a)}
    assert 3 <= tables["route-pairs"].select("p", "q").distinct().count() <= 9
    assert all(got[a, b]["same_route"] == (abs(a % 3 - b % 3) < 2 and {a % 3, b % 3} != {1, 2}) for a, b in got)
    for a, b in ((1, 0), (3, 0), (5, 1)):
        far = []
        for lat, lon in pts[a]:
            m = np.array([111320 * math.cos(math.radians(lat)), 111320])
            line = (np.array(pts[b])[:, ::-1] - [lon, lat]) * m
            s, d = line[:-1], np.diff(line, axis=0)
            t = np.clip(-(s * d).sum(1) / (d * d).sum(1), 0, 1)
            far.append(np.hypot(*(s + t[:, None] * d).T).min())
        assert got[a, b]["mean_m"] == pytest.approx(np.mean(far), abs=1e-6) and got[a, b]["p95_m"] == pytest.approx(np.percentile(far, 95), abs=1e-6)
