"""Repeated routes: fingerprints, similarity and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import local_xy, metres_to_segments
from ..schemas import C
from ..plans.storage import stored
from .frames import cumulative_distance, resample
from .joins import overlapping_boxes


def fingerprints(points: DataFrame, key: str = "ride_id", order: str = "idx", lat: str = "lat", lon: str = "lon", n: int = C.route_points) -> DataFrame:
    """One row for each ride: pts (evenly spaced places), length_m and its box."""
    track = cumulative_distance(points, key, order, lat, lon, "_d")
    ends = track.groupBy(key).agg(F.max("_d").alias("length_m"), F.min(lat).alias("south"), F.min(lon).alias("west"), F.max(lat).alias("north"), F.max(lon).alias("east"))
    places = resample(track, key, "_d", [lat, lon], n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", F.col(lat).alias("lat"), F.col(lon).alias("lon")))).alias("pts"))
    return ends.join(places, key)


def similarities(prints: DataFrame, key: str = "ride_id") -> DataFrame:
    """Distances from each later ride (a) to the line of an earlier one (b) whose padded boxes overlap and whose lengths are alike:
    a, b, mean_m, p95_m, same_route. Distances to a line do not depend on its direction."""
    pad = C.route_pad_m / C.metres_per_degree
    boxes = prints.select(key, "south", "west", "north", "east")
    pairs = overlapping_boxes(boxes, key, pad).select(F.col("b").alias("later"), F.col("a").alias("earlier"))
    tracks = stored(prints.groupBy("pts").agg(F.min(key).alias("track")), "route-tracks")  # rides over the same places are measured once
    member = stored(prints.join(tracks, "pts").select(key, "track", "length_m"), "route-members")
    side = lambda n, c: member.select(F.col(key).alias(n), F.col("track").alias(c), F.col("length_m").alias(f"_{c}"))
    both = pairs.join(side("later", "p"), "later").join(side("earlier", "q"), "earlier").where(F.greatest("_p", "_q") <= C.route_length_ratio * F.least("_p", "_q"))
    both = stored(both.select("later", "earlier", "p", "q"), "route-pairs")
    places = lambda c: tracks.select(F.col("track").alias(c), F.col("pts.lat").alias(f"{c}_lat"), F.col("pts.lon").alias(f"{c}_lon"))
    lines = both.select("p", "q").distinct().join(places("p"), "p").join(places("q").where("size(q_lat) > 1"), "q").select("p", "q", "p_lat", "p_lon", "q_lat", "q_lon")
    kind = prints.schema[key].dataType.simpleString()
    lines = lines.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = lines.mapInArrow(_distances, f"p {kind}, q {kind}, mean_m double, p95_m double")
    sums = both.join(sums, ["p", "q"]).select("later", "earlier", "mean_m", "p95_m")
    return sums.withColumn("same_route", (F.col("mean_m") <= C.route_mean_m) & (F.col("p95_m") <= C.route_p95_m))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean and 95th percentile of the distances from the places of p to the line of q."""
    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            lat, lon, y, x = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(2, 6))
            d = metres_to_segments(lat[:, None], lon[:, None], y[:-1], x[:-1], y[1:], x[1:])
            d = np.fmin.reduce(d, axis=1)
            d = d[~np.isnan(d)]
            found.append((float(d.mean()), float(np.percentile(d, 95))) if len(d) else (None, None))
        mean, p95 = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mean, pa.float64()), pa.array(p95, pa.float64())], ["p", "q", "mean_m", "p95_m"])


def grouped(rides: DataFrame, edges: DataFrame, key: str = "ride_id", started: str = "started_at") -> DataFrame:
    """Each ride's route, named by its first ride: rides in the order of their start join the reference whose mean distance is least.

    A ride with a reference among its earlier look-alikes is none itself; one of which all earlier look-alikes are known to be none is one. Both
    are settled as soon as they are known, so a thousand equal rides take two rounds."""
    order = rides.select(key, started)
    links = edges.where("same_route").select(F.col("later").alias("a"), F.col("earlier").alias("b"), "mean_m")
    s = lambda n: order.select(F.col(key).alias(n), F.struct(started, key).alias(f"_{n}"))
    links = links.join(s("a"), "a").join(s("b"), "b")
    links = links.select(F.when(F.col("_b") < F.col("_a"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("_b") < F.col("_a"), F.col("b")).otherwise(F.col("a")).alias("b"), "mean_m")
    links = stored(links, "route-links")
    firsts = order.select(F.col(key).alias("node")).join(links.select(F.col("a").alias("node")), "node", "left_anti")
    settled = stored(firsts.select("node", F.lit(True).alias("reference")), "route-settled")
    while True:
        known = settled.select(F.col("node").alias("b"), "reference")
        open_ = links.join(settled.select(F.col("node").alias("a")), "a", "left_anti").join(known, "b", "left")
        state = open_.groupBy("a").agg(F.max(F.coalesce("reference", F.lit(False))).alias("joins"), F.count_if(F.col("reference").isNull()).alias("waiting"))
        new = stored(state.where("joins OR waiting = 0").select(F.col("a").alias("node"), (~F.col("joins")).alias("reference")), "route-settled")
        if new.isEmpty():
            break
        settled = stored(settled.unionByName(new), "route-settled")
    reference = settled.where("reference").select(F.col("node").alias("b"))
    nearest = links.join(settled.where("NOT reference").select(F.col("node").alias("a")), "a").join(reference, "b").groupBy("a").agg(F.min(F.struct("mean_m", "b")).alias("best"))
    return settled.join(nearest, settled["node"] == nearest["a"], "left").select(F.col("node").alias(key), F.coalesce("best.b", "node").alias("ref_ride_id"))


def local_track(points: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """Metres east and north of each ride's first place by order of appearance in the box's south-west corner."""
    corner = points.groupBy(key).agg(F.min(lat).alias("_lat0"), F.min(lon).alias("_lon0"))
    x, y = local_xy(lat, lon, "_lat0", "_lon0")
    return points.join(corner, key).withColumn("east_m", x).withColumn("north_m", y).drop("_lat0", "_lon0")
