"""Joins by nearness: in time, in intervals, in tolerance bands and in space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import metres_to_segments
from ..plans.storage import stored
from ..schemas import C
from .frames import ranged


def rounded_second(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tie: str = "last") -> DataFrame:
    """Attach a value by equal key and rounded second (half to even); of several in one second the first or last counts."""
    second = F.bround(F.col(time)).cast("long")
    pick = F.max_by if tie == "last" else F.min_by
    values = right.select(key, second.alias("_s"), time, value).groupBy(key, "_s").agg(pick(value, time).alias(value))
    return left.withColumn("_s", second).join(values, [key, "_s"], "left").drop("_s")


def nearest_in_time(probes: DataFrame, samples: DataFrame, key: str, time: str, value: str, tolerance: float, to: str) -> DataFrame:
    """Attach the sample nearest in time, under a tolerance; of two as near the later. One shuffle by key, no pairs."""
    both = probes.withColumn("_v", F.lit(None).cast("struct<t:double,v:double>")).withColumn("_probe", F.lit(True)).unionByName(
        samples.select(key, time, F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("_v"), F.lit(False).alias("_probe")), allowMissingColumns=True
    )
    both = both.withColumn("_a", ranged("last(_v, true)", key, time, None, 0)).withColumn("_b", ranged("first(_v, true)", key, time, 0, None)).where("_probe")
    before, after = F.col(time) - F.col("_a.t"), F.col("_b.t") - F.col(time)
    later = F.col("_b").isNotNull() & (F.col("_a").isNull() | (after <= before))
    gap = F.when(later, after).otherwise(before)
    return both.withColumn(to, F.when(gap < tolerance, F.when(later, F.col("_b.v")).otherwise(F.col("_a.v")))).drop("_v", "_probe", "_a", "_b")


def in_intervals(rows: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, label: str, order: str, to: str, width: float = 300.0) -> DataFrame:
    """Attach the label of the interval that holds a time; of several the last in order. Repeated rows stay. Intervals are dealt to the time slots
    of ``width`` that they touch and gathered there (what one ride's tags hold in a slot), so each row meets one array by equality."""
    slots = spans.select(F.col(key).alias("_k"), F.struct(F.col(order).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(label).alias("l")).alias("_span"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_slot"))
    slots = slots.groupBy("_k", "_slot").agg(F.collect_list("_span").alias("_spans"))
    hit = rows.join(slots, (F.col(key) == F.col("_k")) & (F.floor(F.col(time) / width) == F.col("_slot")), "left")
    inside = F.filter("_spans", lambda x: (F.col(time) >= x["s"]) & (F.col(time) <= x["e"]))
    return hit.withColumn(to, F.array_max(inside)["l"]).select(*rows.columns, to)


def in_band(left: DataFrame, right: DataFrame, key: str, columns: list[str], tolerance: float, value: str, order: str, to: str) -> DataFrame:
    """Attach the value of the first right row whose columns are all within a tolerance of the left row's. Repeated rows stay. Right rows are dealt by
    the first column's cell and gathered there."""
    first = columns[0]
    cell = lambda c: F.floor(F.col(c) / tolerance)
    other = F.struct(F.col(order).alias("_order"), F.col(value).alias("_value"), *[F.col(c).alias(c) for c in columns])
    r = right.select(F.col(key).alias("_k"), other.alias("_r"), F.explode(F.sequence(cell(first) - 1, cell(first) + 1)).alias("_cell"))
    r = r.groupBy("_k", "_cell").agg(F.collect_list("_r").alias("_rs"))

    def near(x):
        ok = F.lit(True)
        for c in columns:
            ok = ok & (F.abs(F.col(c) - x[c]) <= tolerance)
        return ok

    hit = left.join(r, (F.col(key) == F.col("_k")) & (cell(first) == F.col("_cell")), "left")
    return hit.withColumn(to, F.array_min(F.filter("_rs", near))["_value"]).select(*left.columns, to)


def merged_near(old: DataFrame, new: DataFrame, key: str, time: str, tolerance: float) -> DataFrame:
    """The new rows, and the old ones of which no new one of the key is within a tolerance in time; rows meet by cell."""
    cell = F.floor(F.col(time) / tolerance)
    near = new.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell"))
    met = (F.col(key) == F.col("_k")) & (cell == F.col("_cell")) & (F.abs(F.col(time) - F.col("_t")) <= tolerance)
    return old.join(near, met, "left_anti").unionByName(new)


#: Fixed value: pairs of a point and a segment that a task measures at once.
PAIRS = 1 << 18


def nearest_segment(points: DataFrame, segments: DataFrame, point_id: list[str], lat: str, lon: str, reach: float = C.snap_m) -> DataFrame:
    """The nearest segment(seg, lat1, lon1, lat2, lon2) within a reach of each point and its distance; ties: the lower seg.
    Segments are dealt to all grid cells that they can reach, points to their own cell. A cell's points and segments meet as arrays; a place that many
    points share is measured once, and of segments that are the same line the lowest seg stands for all."""
    size = max(reach, 100.0) / C.metres_per_degree
    pad = F.lit(reach / C.metres_per_degree)
    span = lambda a, b, p: F.sequence(F.floor((F.least(a, b) - p) / size), F.floor((F.greatest(a, b) + p) / size))
    wide = pad / F.cos(F.radians(F.greatest(F.abs("lat1"), F.abs("lat2"))))
    ends = ["lat1", "lon1", "lat2", "lon2"]
    lines = segments.groupBy(*ends).agg(F.min("seg").alias("seg"))
    cells = lines.withColumn("_y", F.explode(span(F.col("lat1"), F.col("lat2"), pad))).withColumn("_x", F.explode(span(F.col("lon1"), F.col("lon2"), wide)))
    places = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).distinct()
    places = places.withColumn("_y", F.floor(F.col("_lat") / size)).withColumn("_x", F.floor(F.col("_lon") / size))
    kind = segments.schema["seg"].dataType.simpleString()

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        at, (lat1, lon1, lat2, lon2) = (left["_lat"].to_numpy(), left["_lon"].to_numpy()), (right[c].to_numpy() for c in ends)
        order = np.argsort(right["seg"].to_numpy(), kind="stable")  # of equal distances argmin takes the first
        lat1, lon1, lat2, lon2 = (c[order] for c in (lat1, lon1, lat2, lon2))
        best, far = np.zeros(len(at[0]), np.int64), np.full(len(at[0]), np.inf)
        step = max(1, PAIRS // max(1, len(order)))
        for k in range(0, len(far) if len(order) else 0, step):
            d = metres_to_segments(at[0][k : k + step, None], at[1][k : k + step, None], lat1, lon1, lat2, lon2)
            best[k : k + step] = d.argmin(1)
            far[k : k + step] = np.take_along_axis(d, best[k : k + step, None], 1)[:, 0]
        hit = np.flatnonzero(far <= reach)
        return pa.table({"_lat": left["_lat"].take(pa.array(hit)), "_lon": left["_lon"].take(pa.array(hit)), "seg": right["seg"].take(pa.array(order[best[hit]] if len(hit) else hit)), "metres": far[hit]})

    by = ["_y", "_x"]
    best = places.groupBy(*by).cogroup(cells.select(*by, *ends, "seg").groupBy(*by)).applyInArrow(near, f"_lat double, _lon double, seg {kind}, metres double")
    return points.join(best, (F.col(lat).cast("double") == F.col("_lat")) & (F.col(lon).cast("double") == F.col("_lon")), "left").select(*points.columns, "seg", "metres")


def match_ratio(matched: DataFrame, key: str, metres: str) -> DataFrame:
    """The share of each key's points that a segment was found for, and their number: key, ratio, snapped."""
    return matched.groupBy(key).agg(F.avg(F.col(metres).isNotNull().cast("double")).alias("ratio"), F.count(metres).alias("snapped"))


def with_late(rows: DataFrame, old: DataFrame, new: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """Rows with reference data that may arrive after them: the later delivery's value where it has one, else the earlier one's; also late, whether it
    came with the later delivery, so that what rests on it is to be computed again."""
    first, later = (d.groupBy(key).agg(F.last(value, True).alias(n)) for d, n in ((old, "_old"), (new, "_new")))
    both = rows.join(first, key, "left").join(later, key, "left")
    return both.withColumn(to, F.coalesce("_new", "_old")).withColumn("late", F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))).drop("_old", "_new")


def segments_around(points: DataFrame, segments: DataFrame, lat: str, lon: str, south: float, west: float) -> DataFrame:
    """All pairs of a point and a segment(seg, lat1, lon1, lat2, lon2) whose start is under ``south`` and ``west`` degrees away from it.
    Segments are dealt to the grid cells (of that size) around their start, points to their own cell."""
    cells = segments
    for to, c, size in (("_y", "lat1", south), ("_x", "lon1", west)):
        cell = F.floor(F.col(c) / size)
        cells = cells.withColumn(to, F.explode(F.sequence(cell - 1, cell + 1)))
    at = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few points may have many pairs
    at = at.withColumn("_y", F.floor(F.col(lat) / south)).withColumn("_x", F.floor(F.col(lon) / west))
    near = (F.abs(F.col(lat) - F.col("lat1")) < south) & (F.abs(F.col(lon) - F.col("lon1")) < west)
    return at.join(cells, ["_y", "_x"]).where(near).drop("_y", "_x")


#: Fixed value: boxes of a block, of which pairs are compared at once.
BOXES = 2048


def overlapping_boxes(boxes: DataFrame, key: str, pad: float, cell: float = 0.05) -> DataFrame:
    """Pairs (a < b) of boxes(key, south, west, north, east) that overlap once padded; boxes meet in the grid cells they touch,
    and a pair is reported in the first cell that both have. A cell's boxes are dealt to some groups, and each pair of groups meets in a task as blocks, so a cell that many boxes
    touch is shared by many tasks, none of which holds more than two groups."""
    spark = boxes.sparkSession
    floor = lambda c, d: F.floor((F.col(c) + d) / cell)
    names = ["south", "west", "north", "east"]
    rows = boxes.select(F.col(key).alias("_k"), *[F.col(c).cast("double").alias(c) for c in names]).where(" AND ".join(f"{c} IS NOT NULL" for c in ["_k", *names]))
    rows = rows.select("*", floor("south", -pad).alias("_s"), floor("west", -pad).alias("_w"), floor("north", pad).alias("_n"), floor("east", pad).alias("_e"))
    dealt = stored(rows.withColumn("_y", F.explode(F.sequence("_s", "_n"))).withColumn("_x", F.explode(F.sequence("_w", "_e"))).drop("_n", "_e"), "boxes")
    groups = dealt.groupBy("_y", "_x").agg(F.ceil(F.count("*") / BOXES).cast("int").alias("_groups"))
    own = dealt.join(groups, ["_y", "_x"]).withColumn("_g", F.pmod(F.xxhash64("_k"), F.col("_groups").cast("long")).cast("int"))
    # group g meets h at (least, greatest) of both
    met = own.withColumn("_h", F.explode(F.expr("sequence(0, _groups - 1)"))).select("*", F.least("_g", "_h").alias("_p"), F.greatest("_g", "_h").alias("_q")).drop("_groups", "_h")
    kind = boxes.schema[key].dataType.simpleString()

    def pairs(cell_: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups)).sort_by("_k")
        y, x, p, q = (v.as_py() for v in cell_)
        g, k = t["_g"].to_numpy(), t["_k"].combine_chunks()
        code = k.dictionary_encode().indices.to_numpy()
        south, west, north, east, s, w = (t[c].to_numpy() for c in (*names, "_s", "_w"))
        low, high, left, right = south - pad, north + pad, west - pad, east + pad
        one, other = np.flatnonzero(g == p), np.flatnonzero(g == q)
        for at in range(0, len(one), 256):
            i = one[at : at + 256, None]
            both = (low[i] <= high[other]) & (low[other] <= high[i]) & (left[i] <= right[other]) & (left[other] <= right[i]) & (np.maximum(s[i], s[other]) == y) & (np.maximum(w[i], w[other]) == x)
            if p == q:
                both &= code[i] < code[other]
            a, b = np.nonzero(both)
            a, b = i[a, 0], other[b]
            low_, high_ = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([k.take(pa.array(low_)), k.take(pa.array(high_))], ["a", "b"])

    by = ["_y", "_x", "_p", "_q"]
    return met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).groupBy(*by).applyInArrow(pairs, f"a {kind}, b {kind}")


def way_segments(ways: DataFrame, nodes: DataFrame, way: str = "way", refs: str = "nodes") -> DataFrame:
    """Segments between consecutive known nodes of each way: way, k, lat1, lon1, lat2, lon2; unknown nodes are left out."""
    steps = ways.select(way, F.posexplode(refs).alias("_p", "node")).join(nodes.select("node", "lat", "lon"), "node")
    w = Window.partitionBy(way).orderBy("_p")
    found = steps.select(way, (F.row_number().over(w) - 1).alias("k"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    return found.where("lat2 IS NOT NULL")


def missing(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What the cache does not have."""
    return wanted.join(cached, keys, "left_anti")


def with_singleton(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the only row of a table (a profile) to every row."""
    return rows.crossJoin(F.broadcast(one.limit(1)))


#: Fixed value: vectors in a block.
BLOCK = 1024


def _blocks(vector: str, id: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs rows into blocks of vectors of one length: ids, width and the vectors' bytes. Vectors that are null or hold a null stay out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch[id].to_pylist() if id else [None] * batch.num_rows
            by_width: dict[int, list[tuple[int, list[float]]]] = {}
            for i, v in zip(ids, batch[vector].to_pylist(), strict=True):
                if v is not None and None not in v:
                    by_width.setdefault(len(v), []).append((i, v))
            for width, rows in by_width.items():
                for k in range(0, len(rows), BLOCK):
                    part = rows[k : k + BLOCK]
                    data = np.array([v for _, v in part], float).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([[i for i, _ in part]], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([data], pa.binary())], ["ids", "width", "data"])

    return pack


def nearest_example(rows: DataFrame, examples: DataFrame, vector: str, scales: list[float] | None, to: str) -> DataFrame:
    """Least scaled distance to any labelled example; null without one of the vector's length. Blocks of rows meet blocks of examples."""
    spark = rows.sparkSession
    schema = "ids array<bigint>, width int, data binary"
    at = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "nearest-rows")  # stored, so that numbers stay
    left = at.select("_row", F.col(vector).cast("array<double>").alias("_v")).mapInArrow(_blocks("_v", "_row"), schema)
    right = stored(examples.select(F.col(vector).cast("array<double>").alias("_v")).mapInArrow(_blocks("_v", None), schema), "nearest-examples")
    right = right.select(F.col("width").alias("width2"), F.col("data").alias("data2"))
    pairs = left.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).crossJoin(right)  # blocks, which aren't shuffled in pairs
    scale = np.array(scales, float) if scales else None

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, width = batch["ids"][r].values, batch["width"][r].as_py()
                if batch["width2"][r].as_py() != width or scale is not None and len(scale) != width:
                    continue
                a = np.frombuffer(batch["data"][r].as_py()).reshape(len(ids), width)
                count = len(batch["data2"][r].as_py()) // (8 * width) if width else 1
                best = np.full(len(ids), np.nan)
                for e in np.frombuffer(batch["data2"][r].as_py()).reshape(count, width):
                    d = a - e if scale is None else (a - e) / scale
                    best = np.fmin(best, np.einsum("ij,ij->i", d, d))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.sqrt(best), pa.float64())], ["_row", to])

    found = pairs.mapInArrow(least, f"_row bigint, `{to}` double").groupBy("_row").agg(F.min(to).alias(to))
    return at.join(found, "_row", "left").select(*rows.columns, to)
