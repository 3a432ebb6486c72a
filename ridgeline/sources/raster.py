"""Elevation rasters as columns: sampling, and decoding of compressed strips."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bilinear(raster: Column, row: Column, col: Column) -> Column:
    """Value of an array<array<double>> (row 0 in the north) between its cells; null where a cell is missing or outside."""
    r0, c0 = F.floor(row).cast("int"), F.floor(col).cast("int")
    cell = lambda r, c: F.get(F.get(raster, r), c)
    rows, cols = F.size(raster), F.size(F.get(raster, F.lit(0)))
    r1, c1 = F.least(r0 + 1, rows - 1), F.least(c0 + 1, cols - 1)
    y, x = row - r0, col - c0
    inside = (row >= 0) & (col >= 0) & (row <= rows - 1) & (col <= cols - 1)
    top = cell(r0, c0) * (1 - x) + cell(r0, c1) * x
    low = cell(r1, c0) * (1 - x) + cell(r1, c1) * x
    return F.when(inside, top * (1 - y) + low * y)


def sample(points: DataFrame, tiles: DataFrame, lat: str, lon: str, to: str, cell: float = 0.01) -> DataFrame:
    """Attach the elevation of the tile(south, west, north, east, raster) that holds each point; tiles are dealt to the grid cells they
    touch, so points and tiles meet by equality."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    dealt = tiles.withColumn("_y", F.explode(span("south", "north"))).withColumn("_x", F.explode(span("west", "east")))
    at = points.withColumn("_y", F.floor(F.col(lat) / cell)).withColumn("_x", F.floor(F.col(lon) / cell))
    rows, cols = F.size("raster"), F.size(F.get("raster", F.lit(0)))
    value = bilinear(F.col("raster"), (F.col("north") - F.col(lat)) / (F.col("north") - F.col("south")) * (rows - 1), (F.col(lon) - F.col("west")) / (F.col("east") - F.col("west")) * (cols - 1))
    inside = F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(F.col("west"), F.col("east"))
    hit = at.join(dealt, ["_y", "_x"], "left").withColumn("_v", F.when(inside, value))
    return hit.groupBy(*points.columns).agg(F.first("_v", True).alias(to))


def cascade(df: DataFrame, key: str, preferred: str, others: list[str], to: str, share: float = 0.5) -> DataFrame:
    """The preferred source where it fills at least a share of the key's rows, holes from the others in turn; else the others alone."""
    filled = df.groupBy(key).agg(F.avg(F.col(preferred).isNotNull().cast("double")).alias("_share"))
    joined = df.join(filled, key)
    return joined.withColumn(to, F.when(F.col("_share") >= share, F.coalesce(preferred, *others)).otherwise(F.coalesce(*others))).drop("_share")


def unpack_lzw(data: bytes) -> bytes:
    """Raster LZW: codes of 9 to 12 bits, most significant bit first; 256 clears, 257 ends, widths grow one code early."""
    out, table, width, at, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, None
    bits = int.from_bytes(data, "big")
    total = 8 * len(data)
    while at + width <= total:
        code = bits >> (total - at - width) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def read_raster(data: bytes) -> np.ndarray:
    """A single-band raster of strips or tiles, plain, deflated or LZW, 8 to 64 bits: float64, invalid cells (-1000 or less, or 0) NaN."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        code = {1: "B", 2: "B", 3: "H", 4: "I", 12: "d", 11: "f"}.get(kind)
        if code:
            size = struct.calcsize(code) * n
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, place)
    width, height, bits, packing, kind = tags[256][0], tags[257][0], tags[258][0], tags.get(259, (1,))[0], tags.get(339, (1,))[0]
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
    tiled = 324 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, (height,))[0])
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across = -(-width // tw)
    out = np.full((height, width), np.nan)
    for k, (p, s) in enumerate(zip(places, sizes, strict=True)):
        raw = data[p : p + s]
        raw = {1: lambda b: b, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress}[packing](raw)
        y, x = k // across * th, k % across * tw
        block = np.frombuffer(raw, dtype)
        block = block[: len(block) // tw * tw].reshape(-1, tw)[: height - y, : width - x]
        out[y : y + block.shape[0], x : x + block.shape[1]] = block
    out[(out <= -1000) | (out == 0)] = np.nan
    return out
