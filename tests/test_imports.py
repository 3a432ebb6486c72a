"""Import jobs, tables that change together, and the activity file's parser and patcher."""

import binascii
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from ridgeline.plans import committed, ride_pipeline
from ridgeline.sources import activity, patch
from ridgeline.streaming import imports, jobs


def ride_file(seed: int, n: int = 30) -> bytes:
    rows = [{253: 1000 + 100 * seed + k, 0: 600_000_000 + 50_000 * k, 1: -18_000_000 + 40_000 * k, 2: 3000 + k, 3: 110 + k % 40, 5: 800 * k, 6: 8000, 78: 3000 + k} for k in range(n)]
    return activity.encode(rows, activity.ALTITUDE_FIELDS)


def by_bit(data: bytes, polynomial: int, reflected: bool) -> int:
    value = 0
    for byte in data:
        value ^= byte if reflected else byte << 8
        for _ in range(8):
            value = (value >> 1 ^ (polynomial if value & 1 else 0)) if reflected else (value << 1 ^ (polynomial if value & 0x8000 else 0)) & 0xFFFF
    return value


def test_checksums(monkeypatch):
    monkeypatch.setattr(activity, "LONG", 700)
    for n in (0, 1, 12, 699, 700, 2047, 2048, 2049, 9999):
        data = os.urandom(n)
        assert activity.crc(data, 0xA001, True) == by_bit(data, 0xA001, True)
        assert activity.crc(data, 0x1021, False) == by_bit(data, 0x1021, False) == binascii.crc_hqx(data, 0)


def test_a_checksum_may_be_zero():
    fields = [(activity.TIMESTAMP, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85)]
    files = (activity.encode([{activity.TIMESTAMP: t, 0: 600_000_000, 1: -20_000_000}], fields) for t in range(1_000_000, 1_200_000))
    whole = next(f for f in files if f[-2:] == b"\0\0")
    assert activity.checksum(whole) == (True, "reflected") and activity.records("a", whole)[0][-2:] == (True, "reflected")
    assert activity.checksum(patch.patched(whole, [100.0])) == (True, "reflected")
    other = activity.encode([{activity.TIMESTAMP: 5, 0: 600_000_000, 1: -20_000_000}], fields)
    assert activity.checksum(other[:-2] + b"\0\0") == (None, None)  # none was written


def test_broken_files_raise_value_errors_only():
    rng, data = random.Random(1), ride_file(0)
    broken = [data[:n] for n in range(len(data))]
    for _ in range(1500):
        b = bytearray(data)
        for _ in range(rng.randrange(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        broken.append(bytes(b))
    for b in broken:
        for f in (lambda x: activity.records("x", x), lambda x: activity.metadata("x", x), lambda x: patch.patched(x, [1.0])):
            try:
                f(b)
            except ValueError:
                pass


def test_broken_file_harms_no_other(spark):
    files = spark.createDataFrame([("good", ride_file(0)), ("cut", ride_file(0)[:30]), ("none", None), ("text", b"hello there, no activity")], "path string, content binary")
    got = {r["path"]: (r["n"], r["error"]) for r in activity.outcomes(files).groupBy("path").agg(F.count("t").alias("n"), F.max("error").alias("error")).collect()}
    assert got == {"good": (30, None), "cut": (0, "the file ends within a definition"), "none": (0, "not an activity file"), "text": (0, "not an activity file")}
    assert activity.decode(files).count() == 30


# --- patching


def sections(data: bytes) -> list[tuple]:
    return [(m, {k: v for k, v in values.items() if m != 20 or k not in (2, 78)}, t) for m, values, t in activity.messages(data)]


def altitudes_of(data: bytes) -> list[float | None]:
    return [r[7] for r in activity.records("x", data)]


def mixed_file() -> bytes:
    """Both byte orders, developer fields, another message between, compressed headers, records without a place, bytes behind the checksum."""
    body = bytes([0x60, 0, 1]) + struct.pack(">H", 20) + bytes([3, 253, 4, 0x86, 0, 4, 0x85, 1, 4, 0x85, 1, 7, 2, 0])
    body += b"".join(bytes([0]) + struct.pack(">Iii", 1000 + k, 10**8 + k, 2 * 10**8) + bytes([k, 99]) for k in range(3))
    body += bytes([0x41, 0, 0]) + struct.pack("<H", 49) + bytes([1, 0, 3, 0x0D]) + bytes([1, 7, 8, 9])
    body += bytes([0x42, 0, 0]) + struct.pack("<H", 20) + bytes([4, 253, 4, 0x86, 2, 2, 0x84, 0, 4, 0x85, 1, 4, 0x85])
    body += bytes([0x80 | 2 << 5 | 4]) + struct.pack("<Hii", 5555, 10**8, 10**8) + bytes([2]) + struct.pack("<IHii", 1010, 5555, 0x7FFFFFFF, 0x7FFFFFFF)
    head = struct.pack("<BBHI4s", 14, 0x10, 2132, len(body), b".FIT")
    head += struct.pack("<H", activity.crc(head, 0x1021, False))
    return head + body + struct.pack("<H", activity.crc(head + body, 0x1021, False)) + b"tail"


def test_patch_keeps_all_but_altitudes():
    data = mixed_file()
    assert len(patch.places(data)) == 4
    out = patch.patched(data, [10.0, None, 99_999.0, -20.0])
    assert sections(out) == sections(data) and out.endswith(b"tail")
    assert altitudes_of(out) == [10.0, None, 99_999.0, -20.0, None]
    assert activity.checksum(out[:-4]) == (True, "plain") and activity.crc(out[:12], 0x1021, False) == struct.unpack_from("<H", out, 12)[0]
    assert bytes([1, 7, 8, 9]) in out and out.count(b"\x00c") + out.count(b"\x01c") + out.count(b"\x02c") >= 3  # the other message, the developer's bytes
    again = patch.patched(out, [10.0, None, 99_999.0, -20.0])
    assert again == out
    assert altitudes_of(patch.patched(data, [])) == [None] * 5


def test_patch_of_a_plain_file_by_spark(spark):
    plain = [f for f in activity.ALTITUDE_FIELDS if f[0] not in (2, 78)]
    data = activity.encode([{253: 100 + k, 0: 10**8 + k, 1: 10**8} for k in range(40)], plain)
    files = spark.createDataFrame([("a", data), ("b", data[:60])], "path string, content binary")
    places = patch.file_places(files)
    assert places.count() == 40
    got = {r["path"]: r for r in patch.patched_files(files, places.withColumn("altitude", F.col("k") * 2.0)).collect()}
    assert got["b"]["content"] is None and got["b"]["error"] == "the file is cut short"
    assert altitudes_of(bytes(got["a"]["content"])) == [2.0 * k for k in range(40)]
    assert activity.checksum(bytes(got["a"]["content"])) == (True, "reflected")


# --- jobs and tables that change together


@pytest.fixture
def drop(tmp_path):
    d = tmp_path / "drop"
    d.mkdir()
    return d


def start(spark, drop, tmp_path, **more):
    stream = imports.arriving_files(spark, str(drop))
    jobs.import_files(stream.select("path", "file_hash", "content"), str(tmp_path / "tables"), str(tmp_path / "log"), **more).awaitTermination()


def present(spark, tmp_path):
    root = str(tmp_path / "tables")
    return {os.path.basename(r["path"]): (r["status"], r["message"]) for r in jobs.states(jobs.events(spark, root)).collect()}, {n: committed.read(spark, root, n).count() for n in committed.RIDE_TABLES}


def test_one_final_state_for_each_file(spark, drop, tmp_path):
    for n in range(3):
        (drop / f"good{n}.fit").write_bytes(ride_file(n))
    (drop / "good1-again.fit").write_bytes(ride_file(1))
    (drop / "cut.fit").write_bytes(ride_file(7)[:30])
    (drop / "short.fit").write_bytes(ride_file(8, 5))
    (drop / "large.fit").write_bytes(ride_file(9, 200))
    start(spark, drop, tmp_path, max_bytes=3000)
    states, rows = present(spark, tmp_path)
    assert states == {
        "good0.fit": ("done", "Imported"), "good1.fit": ("duplicate", "Already imported"), "good1-again.fit": ("done", "Imported"), "good2.fit": ("done", "Imported"),
        "cut.fit": ("error", "the file ends within a definition"), "short.fit": ("error", "Too few records: 5"), "large.fit": ("error", f"File too large: {46 + 26 * 200} bytes"),
    }
    assert rows == {"ride": 3, "gps_point": 90, "hr_point": 90, "power_point": 90, "weather": 3}
    (drop / "later.fit").write_bytes(ride_file(2))
    (drop / "new.fit").write_bytes(ride_file(5))
    start(spark, drop, tmp_path, max_bytes=3000)
    states, rows = present(spark, tmp_path)
    assert states["later.fit"][0] == "duplicate" and states["new.fit"][0] == "done" and len(states) == 9 and rows["ride"] == 4 and rows["gps_point"] == 120


def test_failure_between_tables_leaves_nothing(spark, drop, tmp_path, monkeypatch):
    (drop / "a.fit").write_bytes(ride_file(0))
    whole, calls = committed.stage, []

    def failing(root, batch, name, rows):
        calls.append(name)
        if len(calls) == 4:
            raise RuntimeError("an executor's disk is full")
        whole(root, batch, name, rows)

    monkeypatch.setattr(committed, "stage", failing)
    with pytest.raises(Exception, match="disk is full"):
        start(spark, drop, tmp_path)
    states, rows = present(spark, tmp_path)
    assert states == {"a.fit": ("running", "Parsed")} and set(rows.values()) == {0}
    assert (tmp_path / "tables" / "gps_point").exists()  # staged, and not seen
    monkeypatch.setattr(committed, "stage", whole)
    start(spark, drop, tmp_path)
    states, rows = present(spark, tmp_path)
    assert states == {"a.fit": ("done", "Imported")} and rows == {"ride": 1, "gps_point": 30, "hr_point": 30, "power_point": 30, "weather": 1}


def test_a_committed_batch_is_not_written_again(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([(1,)], "ride_id long")
    assert committed.insert(spark, root, 3, {"x": rows}) and not committed.insert(spark, root, 3, {"x": rows.union(rows)})
    assert committed.read(spark, root, "x", "ride_id long").count() == 1
    committed.stage(root, 4, "x", rows)
    assert committed.read(spark, root, "x", "ride_id long").count() == 1


LOG = "job_id string, path string, file_hash string, status string, progress int, message string, batch long"


def test_states_never_go_back(spark, tmp_path):
    order = [("j1", "running", 1), ("j1", "queued", 1), ("j1", "done", 1), ("j1", "error", 2), ("j1", "running", 2), ("j2", "queued", 1), ("j3", "error", 5), ("j3", "done", 5)]
    log = [(j, "p", "h", s, 0, f"{s}{b}", b) for j, s, b in order]
    got = {r["job_id"]: r["message"] for r in jobs.states(spark.createDataFrame(log, LOG)).collect()}
    assert got == {"j1": "done1", "j2": "queued1", "j3": "done5"}
    src = str(tmp_path / "events")
    for part in (log[:3], log[3:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(src)
        query = jobs.followed(spark.readStream.schema(LOG).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    last = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("changes").collect():
        last[r["job_id"]] = r["message"]
    assert last == got


def test_a_tag_gives_a_descent_its_power(spark):
    rows = [(1, k, float(k), 52.0, -1.5, 100 - 0.15 * k, 7.0, 7.0 * k, 130.0, "pedal" if k >= 60 else None) for k in range(120)]
    p = ride_pipeline.with_elevation(spark.createDataFrame(rows, "ride_id long, idx long, t double, lat double, lon double, elev double, speed double, dist double, hr double, label string"))
    plain, told = (ride_pipeline.with_power(p, headwind=F.lit(6.0), label=c).where("idx BETWEEN 70 AND 110").agg(F.min("watts_est"), F.max("mode"), F.min("watts_hi")).first() for c in (None, "label"))
    assert (plain[0], plain[1]) == (0.0, "coast") and told[0] > 50 and told[1] == "pedal" and told[2] > told[0]
