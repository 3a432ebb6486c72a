"""The binary activity format as a Spark data source: self-describing messages become typed records.

``spark.read.format("activity").load(path)`` reads every file under a path (one partition a file); ``decode`` does the same for
files that ``binaryFile`` has read, so that any store Spark reads will do.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: epoch of its clock, message and field numbers, base types (size, struct code, invalid value).
EPOCH = 631065600
RECORD, SESSION, FILE_ID, SPORT = 20, 18, 0, 12
TIMESTAMP = 253
TYPES = {0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF), 0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0)}
FIELDS = {0: "lat_raw", 1: "lon_raw", 2: "alt_code", 3: "hr", 4: "cadence", 5: "dist_raw", 6: "speed_raw", 9: "grade_raw", 73: "speed2_raw", 78: "alt2_code"}
SCHEMA = "path string, idx int, t double, lat double, lon double, speed double, dist double, alt_raw double, hr int, cadence int, grade_device double, crc_valid boolean, crc_kind string"


LANES, LONG = 2048, 1 << 16  # files of so many bytes have the checksums of that many stretches computed side by side


@functools.cache
def _crc_table(polynomial: int, reflected: bool) -> np.ndarray:
    """What each byte does to a checksum of 0."""
    value = np.arange(256, dtype=np.uint16) if reflected else np.arange(256, dtype=np.uint16) << 8
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ polynomial, value >> 1) if reflected else np.where(value & 0x8000, value << 1 ^ polynomial, value << 1)
        value = value.astype(np.uint16)
    return value


def crc(data: bytes, polynomial: int, reflected: bool) -> int:
    """CRC-16 with a start of 0: most significant bit first, or reflected.

    Such a checksum is linear: equal stretches go through the table side by side, and so do the 16 single bits followed by as many zero bytes, which
    tell what a stretch does to the checksum before it. Zeros in front change nothing, so the first stretch is filled up with them."""
    table = _crc_table(polynomial, reflected)
    if len(data) < LONG:
        value, by = 0, table.tolist()
        for byte in data:
            value = value >> 8 ^ by[(value ^ byte) & 0xFF] if reflected else value << 8 & 0xFFFF ^ by[value >> 8 ^ byte]
        return value
    steps = -(-len(data) // LANES)
    body = np.concatenate([np.zeros(steps * LANES - len(data), np.uint8), np.frombuffer(data, np.uint8)])
    body = np.ascontiguousarray(np.concatenate([body.reshape(LANES, steps), np.zeros((16, steps), np.uint8)]).T)
    state = np.concatenate([np.zeros(LANES, np.uint16), np.uint16(1) << np.arange(16, dtype=np.uint16)])
    for row in body:
        state = state >> 8 ^ table[(state ^ row) & 0xFF] if reflected else state << 8 ^ table[state >> 8 ^ row]
    after, value = state[LANES:].tolist(), 0
    for lane in state[:LANES].tolist():
        for k in range(16):
            lane ^= after[k] if value >> k & 1 else 0
        value = lane
    return value


def checksum(data: bytes) -> tuple[bool | None, str | None]:
    """Whether the file's checksum holds and which of the two polynomials in use it is; a checksum of 0 is none, unless 0 is what the bytes give."""
    if len(data) < 14:
        return None, None
    stored = struct.unpack_from("<H", data, len(data) - 2)[0]
    for kind, polynomial, reflected in (("reflected", 0xA001, True), ("plain", 0x1021, False)):
        if crc(data[:-2], polynomial, reflected) == stored:
            return True, kind
    return (False if stored else None), None


def whole(data: bytes, end: int) -> None:
    if end > len(data):
        raise ValueError("the file ends within a definition")


class Definition:
    """Layout of one local message type; ValueError if the file ends within it."""

    def __init__(self, data: bytes, at: int, developer: bool):
        whole(data, at + 5)
        self.order = ">" if data[at + 1] else "<"
        self.message = struct.unpack_from(self.order + "H", data, at + 2)[0]
        n = data[at + 4]
        whole(data, at + 5 + 3 * n + developer)
        self.fields = [tuple(data[at + 5 + 3 * k : at + 8 + 3 * k]) for k in range(n)]
        self.end = at + 5 + 3 * n
        self.extra = 0
        if developer:
            m = data[self.end]
            whole(data, self.end + 1 + 3 * m)
            self.extra = sum(data[self.end + 2 + 3 * k] for k in range(m))
            self.end += 1 + 3 * m

    def size(self, compressed: bool) -> int:
        return sum(s for f, s, _ in self.fields if not (compressed and f == TIMESTAMP)) + self.extra

    def values(self, data: bytes, at: int, compressed: bool) -> dict[int, int]:
        """Field values; invalid ones are left out. Under a compressed header the time stamp takes no bytes."""
        out = {}
        for field, size, base in self.fields:
            if compressed and field == TIMESTAMP:
                continue
            code, invalid = TYPES.get(base, ("", 0))
            if code and struct.calcsize(code) == size:
                value = struct.unpack_from(self.order + code, data, at)[0]
                if value != invalid:
                    out[field] = value
            at += size
        return out


def messages(data: bytes) -> Iterator[tuple[int, dict[int, int], int | None]]:
    """Message number, fields and time of each data message.

    A compressed header adds its five bits to the running time; an offset of 31 escapes: the next byte replaces the time's low byte."""
    if len(data) < 12 or data[8:12] != b".FIT":
        raise ValueError("not an activity file")
    if data[0] < 12:
        raise ValueError("the header is too short")
    at, end = data[0], min(data[0] + struct.unpack_from("<I", data, 4)[0], len(data))
    local: dict[int, Definition] = {}
    clock: int | None = None
    while at < end:
        header = data[at]
        at += 1
        if header & 0x80:
            kind, offset = header >> 5 & 3, header & 0x1F
            if offset == 31:
                if at >= end:
                    return
                base = (clock or 0) & ~0xFF | data[at]
                if clock is not None:
                    clock = base + 256 if base < clock else base
                at += 1
            elif clock is not None:
                clock += offset
            d = local.get(kind)
            if d is None or at + d.size(True) > end:
                return
            values = d.values(data, at, True)
            at += d.size(True)
            if clock is not None:
                yield d.message, values, clock
        elif header & 0x40:
            d = Definition(data, at, bool(header & 0x20))
            local[header & 15], at = d, d.end
        else:
            d = local.get(header & 15)
            if d is None or at + d.size(False) > end:
                return
            values = d.values(data, at, False)
            at += d.size(False)
            clock = values.get(TIMESTAMP, clock)
            yield d.message, values, values.get(TIMESTAMP)


def records(path: str, data: bytes) -> list[tuple]:
    """Rows of SCHEMA, in the order of time."""
    valid, kind = checksum(data)
    rows = []
    for message, v, clock in messages(data):
        if message != RECORD or clock is None:
            continue
        lat, lon = (v[k] * 180.0 / 2**31 if k in v else None for k in (0, 1))
        if lat is None or lon is None or (lat == 0 and lon == 0) or abs(lat) > 90 or abs(lon) > 180:
            lat = lon = None
        speed, alt = v.get(73, v.get(6)), v.get(78, v.get(2))
        rows.append((float(clock + EPOCH), lat, lon, speed / 1000 if speed is not None else None, v[5] / 100 if 5 in v else None, alt / 5 - 500 if alt is not None else None, v.get(3), v.get(4), v[9] / 100 if 9 in v else None))
    rows.sort(key=lambda r: r[0])
    return [(path, i, *r, valid, kind) for i, r in enumerate(rows)]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "**", "*.fit"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from records(partition.path, f.read())


class ActivitySource(DataSource):
    """Format name ``activity``; for folders that every executor can open. Elsewhere: binaryFile and ``decode``."""

    @classmethod
    def name(cls) -> str:
        return "activity"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


_ARROW = pa.schema([("path", pa.string()), ("idx", pa.int32()), *[(c, pa.float64()) for c in ("t", "lat", "lon", "speed", "dist", "alt_raw")], ("hr", pa.int32()), ("cadence", pa.int32()), ("grade_device", pa.float64()), ("crc_valid", pa.bool_()), ("crc_kind", pa.string())])


def decode(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Records of files that are rows with a path and their bytes; files that are not activities, or end within a definition, give no rows."""
    return outcomes(files, path, content).where("error IS NULL").drop("error")


def outcomes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The records of all files, with a column error: a file that can't be read is one row with its path and the reason, and harms no other."""
    schema = _ARROW.append(pa.field("error", pa.string()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = [(*r, None) for r in records(p, body or b"")]
                except ValueError as e:
                    found = [(p, *[None] * (len(schema) - 2), str(e))]
                columns = list(zip(*found, strict=True)) if found else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(rows, SCHEMA + ", error string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all activity files under a path of any store."""
    return decode(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.fit").load(path))


#: Fields of the session and file messages, and what their numbers are divided by.
SESSION_FIELDS = {"total_elapsed": (7, 1000.0), "total_timer": (8, 1000.0), "total_distance": (9, 100.0), "avg_speed": (14, 1000.0), "max_speed": (15, 1000.0), "avg_hr": (16, 1.0), "max_hr": (17, 1.0), "total_ascent": (22, 1.0), "total_descent": (23, 1.0)}
FILE_FIELDS = {"type": 0, "manufacturer": 1, "product": 2, "serial": 3}
METADATA = "path string, start_t double, end_t double, duration_s double, point_count int, sport int, created_t double, " + ", ".join(f"{n} double" for n in SESSION_FIELDS) + ", " + ", ".join(f"{n} long" for n in FILE_FIELDS)


def metadata(path: str, data: bytes) -> dict[str, object]:
    """A row of METADATA. Later messages of a kind win. The duration is the device's timer (moving time); where it has none, the records' span."""
    row: dict[str, object] = {"path": path}
    times, far = [], None
    for message, v, clock in messages(data):
        if message == SESSION:
            row |= {n: v[k] / by for n, (k, by) in SESSION_FIELDS.items() if k in v} | ({"start_t": float(v[2] + EPOCH)} if 2 in v else {}) | ({"sport": v[5]} if 5 in v else {})
        elif message == FILE_ID:
            row |= {n: v[k] for n, k in FILE_FIELDS.items() if k in v} | ({"created_t": float(v[4] + EPOCH)} if 4 in v else {})
        elif message == SPORT and 0 in v:
            row["sport"] = v[0]
        elif message == RECORD and clock is not None:
            times.append((float(clock + EPOCH), v[5] / 100 if 5 in v else None))
    times.sort(key=lambda x: x[0])
    row["point_count"] = len(times)
    if times:
        row.setdefault("start_t", times[0][0])
        far = times[-1][1]
        row |= {"end_t": times[-1][0], "duration_s": row.get("total_timer") or max(0.0, times[-1][0] - times[0][0])}
        row.setdefault("total_distance", far or 0.0)
    return row


def decode_metadata(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row of METADATA for each file that is an activity."""
    names = [c.split()[0] for c in METADATA.split(", ")]
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, types[c.split()[1]]) for n, c in zip(names, METADATA.split(", "), strict=True)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found.append(metadata(p, body or b""))
                except ValueError:
                    continue
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in found], schema)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(rows, METADATA)


def encode_all(parts: list[tuple[int, list[tuple[int, int, int]], list[dict[str, int]]]]) -> bytes:
    """A file of several messages: (message, fields, rows), with fields as for ``encode``."""
    body = b""
    for local, (message, fields, rows) in enumerate(parts):
        body += bytes([0x40 | local, 0, 0]) + struct.pack("<H", message) + bytes([len(fields)]) + b"".join(bytes(f) for f in fields)
        body += b"".join(bytes([local]) + b"".join(struct.pack("<" + TYPES[base][0], row.get(n, TYPES[base][1])) for n, _, base in fields) for row in rows)
    head = struct.pack("<BBHI4s", 14, 0x10, 2132, len(body), b".FIT")
    head += struct.pack("<H", crc(head, 0xA001, True))
    return head + body + struct.pack("<H", crc(head + body, 0xA001, True))


def encode(rows: list[dict[str, int]], fields: list[tuple[int, int, int]], message: int = RECORD) -> bytes:
    """A file of one message type: fields are (number, size, base type), rows map field numbers to values (absent: invalid)."""
    return encode_all([(message, fields, rows)])


SUMMARY_FIELDS = [(2, 4, 0x86), (5, 1, 0x02), (7, 4, 0x86), (8, 4, 0x86), (9, 4, 0x86), (16, 1, 0x02), (17, 1, 0x02)]
ALTITUDE_FIELDS = [(TIMESTAMP, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84), (3, 1, 0x02), (5, 4, 0x86), (6, 2, 0x84), (78, 4, 0x86)]


def moving_ms(line: list[dict]) -> float:
    """Milliseconds between samples that move at 0.3 m/s or more."""
    return sum(b["t"] - a["t"] for a, b in zip(line, line[1:], strict=False) if (b["speed"] or 0) >= 0.3) * 1000


def encoded(points: DataFrame, key: str = "ride_id", summary: bool = False, fields: list[tuple[int, int, int]] = ALTITUDE_FIELDS) -> DataFrame:
    """One activity file (key, content binary) for each ride of points(key, t, lat, lon, elev, hr, dist, speed): the inverse of ``decode``.
    summary: with a session message; fields: what a record holds."""
    line = F.array_sort(F.collect_list(F.struct("t", "lat", "lon", "elev", "hr", "dist", "speed")))
    rides = points.groupBy(key).agg(line.alias("p"))

    @F.arrow_udf("binary")
    def write(lines: pa.Array) -> pa.Array:
        out = []
        for line in lines.to_pylist():
            rows = []
            for p in line or []:
                code = None if p["elev"] is None else round((p["elev"] + 500) * 5)
                row = {TIMESTAMP: round(p["t"]), 0: p["lat"] and round(p["lat"] * 2**31 / 180), 1: p["lon"] and round(p["lon"] * 2**31 / 180), 2: code, 3: p["hr"] and round(p["hr"]), 5: p["dist"] and round(p["dist"] * 100), 6: p["speed"] and round(p["speed"] * 1000), 78: code}
                rows.append({k: v for k, v in row.items() if v is not None})
            parts = [(RECORD, fields, rows)]
            if summary and line:
                beats = [p["hr"] for p in line if p["hr"] is not None]
                session = {2: round(line[0]["t"]), 5: 2, 7: round((line[-1]["t"] - line[0]["t"]) * 1000), 8: round(moving_ms(line)), 9: round((line[-1]["dist"] or 0) * 100)}
                session |= {16: round(sum(beats) / len(beats)), 17: round(max(beats))} if beats else {}
                parts.append((SESSION, SUMMARY_FIELDS, [session]))
            out.append(encode_all(parts))
        return pa.array(out, pa.binary())

    return rides.select(key, write("p").alias("content"))
