"""Elevation from coloured map tiles: PNG files by (z, x, y) become rows of pixels, and points find theirs by joins.

A tile's row of pixels is one table row, so that a tile that very many points lie on is an ordinary skewed join, which Spark splits. Between pixels the elevation is
bilinear, also across the edges of tiles.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import slippy_tile, terrain_rgb

# Fixed values of the format: its first bytes, samples a pixel by colour type; a tile's side.
SIGNATURE, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIDE = 256


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise ValueError("a chunk is cut short")
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One row without its filter: none, left, above, mean of both, or the nearest of left, above and upper left to their plane."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind > 4:
        raise ValueError(f"no such filter: {kind}")
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        left, over = out[i - step], up[i]
        if kind == 3:
            out[i] = out[i] + (left + over >> 1) & 255
        else:
            corner = up[i - step]
            a, b, c = abs(over - corner), abs(left - corner), abs(left + over - 2 * corner)
            out[i] = out[i] + (left if a <= b and a <= c else over if b <= c else corner) & 255
    return np.array(out[step:], np.uint8)


def pixels(data: bytes) -> np.ndarray:
    """Rows x columns x (red, green, blue) of a PNG file with eight bits a sample, not interlaced. ValueError for anything else."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    head, body, palette = None, [], None
    for kind, part in _chunks(data):
        if kind == b"IHDR" and len(part) == 13:
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("not eight bits a sample, or interlaced")
    width, height, step = head[0], head[1], SAMPLES[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width * step + 1):
        raise ValueError("rows are missing")
    lines, above, out = raw.reshape(height, -1), np.zeros(width * step, np.uint8), []
    for line in lines:
        above = _unfiltered(int(line[0]), line[1:], above, step)
        out.append(above)
    image = np.array(out, np.uint8).reshape(height, width, step)
    if head[3] == 3:
        if palette is None or image.max(initial=0) >= len(palette):
            raise ValueError("a colour is not in the palette")
        return palette[image[:, :, 0]]
    return image[:, :, :3] if step >= 3 else np.repeat(image[:, :, :1], 3, axis=2)


def tile_rows(tiles: DataFrame) -> DataFrame:
    """z, x, y, row, red, green, blue (arrays of a row's pixels), error for tiles(z, x, y, content); a file that can't be read is one row with the reason."""
    schema = pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("row", pa.int32()), *[(c, pa.list_(pa.int16())) for c in ("red", "green", "blue")], ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, x, y, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    image = pixels(content or b"").astype(np.int16)
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"z": z, "x": x, "y": y, "error": str(e)}], schema)
                    continue
                found = [{"z": z, "x": x, "y": y, "row": k, "red": line[:, 0], "green": line[:, 1], "blue": line[:, 2]} for k, line in enumerate(image)]
                yield pa.RecordBatch.from_pylist(found, schema)

    kinds = tiles.select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "content")
    return kinds.mapInArrow(rows, "z int, x long, y long, row int, red array<short>, green array<short>, blue array<short>, error string")


def tile_elevation(points: DataFrame, tiles: DataFrame, ids: list[str], lat: str = "lat", lon: str = "lon", zoom: int = 14, smooth: bool = True) -> DataFrame:
    """ids, elev of points by the tiles: of the pixel that a point lies in, or bilinear between the four pixels around it (those whose tiles are there, weighted anew); null
    where there is no tile. ids name a point."""
    x, y = slippy_tile(lat, lon, zoom)
    # where a point lies, in pixels; their centres are at halves
    at = points.select(*ids, *[F.greatest(F.least(v * SIDE - (0.5 if smooth else 0.0), F.lit(float((SIDE << zoom) - 1))), F.lit(0.0)).alias(n) for v, n in ((x, "_u"), (y, "_v"))])
    low = lambda c: F.floor(c).cast("long")
    if smooth:
        part = lambda c: F.col(c) - F.floor(c)
        corners = [F.struct((low("_u") + i).alias("gx"), (low("_v") + j).alias("gy"), ((part("_u") if i else 1 - part("_u")) * (part("_v") if j else 1 - part("_v"))).alias("weight")) for i in (0, 1) for j in (0, 1)]
    else:
        corners = [F.struct(low("_u").alias("gx"), low("_v").alias("gy"), F.lit(1.0).alias("weight"))]
    near = at.select(*ids, F.explode(F.array(*corners)).alias("c")).where("c.weight > 0").select(
        *ids, F.floor(F.col("c.gx") / SIDE).alias("x"), F.floor(F.col("c.gy") / SIDE).alias("y"), (F.col("c.gy") % SIDE).cast("int").alias("row"), (F.col("c.gx") % SIDE + 1).cast("int").alias("_place"), F.col("c.weight").alias("weight")
    )
    rows = tile_rows(tiles.where(F.col("z") == zoom)).where("error IS NULL").select("x", "y", "row", "red", "green", "blue")
    pixel = [F.try_element_at(c, F.col("_place")) for c in ("red", "green", "blue")]
    met = near.join(rows, ["x", "y", "row"], "left").select(*ids, "weight", terrain_rgb(*pixel).alias("elev"))
    known = F.when(F.col("elev").isNotNull(), F.col("weight"))
    return met.groupBy(*ids).agg((F.sum(F.col("elev") * known) / F.sum(known)).alias("elev"))


def written_tile(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> bytes:
    """A PNG file of three samples a pixel; its rows go through the five filters in turn."""
    image = np.stack([red, green, blue], 2).astype(np.uint8)
    height, width, step = image.shape
    lines, above = [], np.zeros(width * step, np.int64)
    for k, row in enumerate(image.reshape(height, -1).astype(np.int64)):
        left, corner = (np.concatenate([np.zeros(step, np.int64), v[:-step]]) for v in (row, above))
        flat = left + above - corner
        a, b, c = abs(flat - left), abs(flat - above), abs(flat - corner)
        guess = (0, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner)))[k % 5]
        lines.append(bytes([k % 5]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
