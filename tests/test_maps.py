"""Coloured tiles and road networks against plain Python."""

import json
import random
import struct
import zlib

import numpy as np
import pytest

from ridgeline.sources import roads, tiles


def image(seed, side=256):
    return np.random.default_rng(seed).integers(0, 256, (side, side, 3))


def png(rows: bytes, width, height, colour=2, depth=8, palette=b"", interlaced=0):
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return tiles.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_all_filters_are_undone():
    for seed in range(3):
        a = image(seed, 23)
        assert (tiles.pixels(tiles.written_tile(a[:, :, 0], a[:, :, 1], a[:, :, 2])) == a).all()


def test_kinds_of_png():
    assert tiles.pixels(png(b"\0\x01\x02\0\x03\x04", 2, 2, colour=0)).tolist() == [[[1] * 3, [2] * 3], [[3] * 3, [4] * 3]]
    assert tiles.pixels(png(b"\0\x01\x02\x03\x09", 1, 1, colour=6)).tolist() == [[[1, 2, 3]]]
    assert tiles.pixels(png(b"\0\x01\x00", 2, 1, colour=3, palette=bytes([1, 2, 3, 4, 5, 6]))).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    good = png(b"\0\1\2\3", 1, 1)
    for bad in (b"", b"GIF89a", good[:40], png(b"\0\1\2\3", 1, 1, depth=16), png(b"\0\1\2\3", 1, 1, interlaced=1), png(b"\7\1\2\3", 1, 1), png(b"\0\1", 1, 1), png(b"\0\5", 1, 1, colour=3, palette=b"abc"), good.replace(b"IDAT", b"JDAT")):
        with pytest.raises(ValueError):
            tiles.pixels(bad)


def degrees(u, v, zoom):
    """Longitude and latitude of a place in pixels."""
    n = 256 << zoom
    return u / n * 360 - 180, float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * v / n)))))


def test_elevation_of_pixels_and_between(spark):
    zoom, x0, y0 = 6, 31, 20
    pictures = {(x0 + i, y0 + j): image(10 + i + 2 * j) for i in (0, 1) for j in (0, 1)}
    table = spark.createDataFrame([(zoom, x, y, tiles.written_tile(a[:, :, 0], a[:, :, 1], a[:, :, 2])) for (x, y), a in pictures.items()] + [(zoom, x0 + 2, y0, b"broken"), (zoom + 1, x0, y0, b"")], "z int, x int, y int, content binary")

    def elev(gx, gy):
        a = pictures.get((gx // 256, gy // 256))
        return None if a is None else float(a[gy % 256, gx % 256] @ [256, 1, 1 / 256]) - 32768

    rng, rows, want, flat = random.Random(1), [], {}, {}
    places = [(x0 * 256 + rng.uniform(1, 510), y0 * 256 + rng.uniform(1, 510)) for _ in range(200)]
    places += [(x0 * 256 + 256.0, y0 * 256 + 256.2), (x0 * 256 + 255.7, y0 * 256 + 100.5), (x0 * 256 + 511.9, y0 * 256 + 9.25), (x0 * 256 + 700.0, y0 * 256 + 9.0)]
    for k, (u, v) in enumerate(places):
        lon, lat = degrees(u, v, zoom)
        rows.append((k, lat, lon))
        gx, gy, fx, fy = int(u - 0.5), int(v - 0.5), (u - 0.5) % 1, (v - 0.5) % 1
        near = [((fx if i else 1 - fx) * (fy if j else 1 - fy), elev(gx + i, gy + j)) for i in (0, 1) for j in (0, 1)]
        near = [(w, e) for w, e in near if e is not None]
        want[k] = sum(w * e for w, e in near) / sum(w for w, _ in near) if near else None
        flat[k] = elev(int(u), int(v))
    points = spark.createDataFrame(rows, "k int, lat double, lon double")
    got = {r.k: r.elev for r in tiles.tile_elevation(points, table, ["k"], zoom=zoom).collect()}
    assert got.keys() == want.keys() and all(got[k] is None if w is None else got[k] == pytest.approx(w, abs=1e-3) for k, w in want.items())
    got = {r.k: r.elev for r in tiles.tile_elevation(points, table, ["k"], zoom=zoom, smooth=False).collect()}
    assert sum(got[k] is None if f is None else got[k] == pytest.approx(f) for k, f in flat.items()) >= len(flat) - 3  # three lie on an edge of pixels
    assert {(r.x, r.error) for r in tiles.tile_rows(table).where("error IS NOT NULL").collect()} == {(x0 + 2, "not a PNG file"), (x0, "not a PNG file")}


def test_road_network_of_answers(spark):
    node = lambda i: {"type": "node", "id": i, "lat": 50.0 + i, "lon": i / 10}
    a = {"version": 0.6, "elements": [{"type": "way", "id": 7, "nodes": [1, 2, 9, 3], "tags": {"highway": "primary", "name": "é"}}, {"type": "way", "id": 8, "nodes": [3, 1], "tags": {"highway": "footway"}}, node(1), node(2), node(3), node(3)]}
    b = {"elements": [{"type": "way", "id": 7, "nodes": [2, 1]}, node(1), node(2), {"type": "node", "id": 5}, {"type": "relation", "id": 1}]}
    answers = spark.createDataFrame([("a", json.dumps(a)), ("b", json.dumps(b)), ("broken", "{"), ("empty", '{"elements": []}'), ("none", None)], "box string, body string")
    got = {(r.box, r.way, r.k): (r.lat1, r.lat2) for r in roads.network(answers).collect()}
    assert got == {("a", 7, 0): (51.0, 52.0), ("a", 7, 1): (52.0, 53.0), ("a", 8, 0): (53.0, 51.0), ("b", 7, 0): (52.0, 51.0)}
    assert {(r.box, r.way) for r in roads.network(answers, ["primary"]).collect()} == {("a", 7)}
    assert {r.box for r in roads.failed(answers).collect()} == {"broken", "empty", "none"}
    boxes = spark.createDataFrame([("a",), ("broken",), ("new",), ("new",)], "box string")
    assert sorted(r.box for r in roads.to_fetch(boxes, answers).collect()) == ["broken", "new"]
    assert spark.range(1).select(roads.box_key(51.5, -0.123, 52, 1).alias("k")).first().k == "51.5000_-0.1230_52.0000_1.0000"
