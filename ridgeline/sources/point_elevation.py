"""Elevation of single points from a service that takes a list of places a call: in chunks, paced, each wholly or not at all, and remembered.

Places are micro-degrees (six places). What the cache lacks is dealt into lanes; a lane is one client of the service: it sends its places in order, in chunks of 90, and waits between calls. Lanes run
side by side in tasks and stream their rows, so memory holds a chunk. The service is a function, so any client fits; nothing is fetched by this module itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import tight_elevation
from ..plans.committed import rows_at
from ..plans.storage import stored

#: Places a call, seconds between calls, tries of a chunk.
CHUNK, INTERVAL_S, TRIES = 90, 1.05, 3
CACHE = "dataset string, lat_e6 long, lon_e6 long, elev double"
_ANSWER = "lat_e6 long, lon_e6 long, elev double, ok boolean"
#: Takes [(latitude, longitude), ...], gives as many elevations (None: not known there), or raises.
Fetch = Callable[[list[tuple[float, float]]], list[float | None]]


class TooMany(Exception):
    """Raise it in a fetcher when the service says that it is asked too often: the next try waits twice as long."""


def micro(c: str | Column) -> Column:
    """A coordinate in micro-degrees; null where it is null or no number."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), F.round(x * 1e6)).cast("long")


def whole_chunk(fetch: Fetch, places: list[tuple[float, float]], tries: int, wait: Callable[[float], None]) -> list[float | None] | None:
    """The elevations of a chunk, or None where all tries fail or give another number of values."""
    for attempt in range(1, tries + 1):
        pause = 1.0 * attempt
        try:
            values = list(fetch(places))
            if len(values) == len(places):
                return [None if v is None else float(v) for v in values]
        except TooMany:
            pause = 2.0 * attempt
        except Exception:  # noqa: BLE001  whatever a client raises, the chunk has failed
            pass
        if attempt < tries:
            wait(pause)
    return None


def _lane_calls(fetch: Fetch, size: int, tries: int, interval: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of rows that are sorted by lane; a chunk never spans two lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        lane, called = None, None

        def call() -> pa.RecordBatch:
            nonlocal called
            if called is not None:
                time.sleep(max(0.0, called + interval - time.monotonic()))
            values = whole_chunk(fetch, [(a / 1e6, b / 1e6) for a, b in held], tries, time.sleep)
            called = time.monotonic()
            lat, lon = [pa.array(list(x), pa.int64()) for x in zip(*held, strict=True)]
            out = pa.RecordBatch.from_arrays([lat, lon, pa.array(values or [None] * len(held), pa.float64()), pa.array([values is not None] * len(held))], ["lat_e6", "lon_e6", "elev", "ok"])
            held.clear()
            return out

        for batch in batches:
            for n, a, b in zip(*[batch[c].to_pylist() for c in ("lane", "lat_e6", "lon_e6")], strict=True):
                if held and (len(held) == size or n != lane):
                    yield call()
                lane = n
                held.append((a, b))
        if held:
            yield call()

    return run


def cached(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """lat_e6, lon_e6, elev: what is known of a data set."""
    return rows_at(spark, path, CACHE).where(F.col("dataset") == dataset).groupBy("lat_e6", "lon_e6").agg(F.max("elev").alias("elev"))


def ask(wanted: DataFrame, fetch: Fetch, lanes: int = 1, lane: Column | None = None, size: int = CHUNK, tries: int = TRIES, interval: float = INTERVAL_S) -> DataFrame:
    """lat_e6, lon_e6, elev, ok of distinct wanted places (lat_e6, lon_e6), written once, so that no later action asks again.

    lanes: clients side by side, that each wait ``interval`` seconds between calls; a public service usually allows one. lane: the expression that deals the places (default: a hash of squares of 0.01
    degrees, so that neighbours share chunks). An executor that is lost makes its lanes' calls again."""
    square = F.xxhash64(F.floor(F.col("lat_e6") / 10000), F.floor(F.col("lon_e6") / 10000))
    dealt = wanted.select((F.pmod(square if lane is None else lane, F.lit(lanes))).cast("int").alias("lane"), "lat_e6", "lon_e6")
    rows = dealt.repartition(lanes, "lane").sortWithinPartitions("lane", "lat_e6", "lon_e6")
    return stored(rows.mapInArrow(_lane_calls(fetch, size, tries, interval), _ANSWER), "elevations")


def sampled(points: DataFrame, path: str, dataset: str, fetch: Fetch, lat: str = "lat", lon: str = "lon", ask_unknown_again: bool = False, **how) -> DataFrame:
    """The points with elev_point (null: not known, not plausible, or its chunk failed) and elev_state: cached, fetched, failed, or none without a place.

    The cache is a table at ``path``, in a folder that driver and executors share; it gets the places of whole chunks alone, those without an elevation too (``ask_unknown_again``: these are asked
    for again). Rows are added by one Spark write after all calls, so a run that fails adds none. how: ``ask``'s lanes, lane, size, tries, interval."""
    spark = points.sparkSession
    keyed = points.withColumns({"lat_e6": F.when(micro(lon).isNotNull(), micro(lat)), "lon_e6": F.when(micro(lat).isNotNull(), micro(lon))})
    known = cached(spark, path, dataset)
    if ask_unknown_again:
        known = known.where("elev IS NOT NULL")
    known = stored(known, "known-elevations")  # the cache is added to below
    wanted = keyed.where("lat_e6 IS NOT NULL").select("lat_e6", "lon_e6").distinct().join(known, ["lat_e6", "lon_e6"], "left_anti")
    answers = ask(wanted, fetch, **how)
    answers.where("ok").select(F.lit(dataset).alias("dataset"), "lat_e6", "lon_e6", "elev").write.mode("append").parquet(path)
    state = known.select("lat_e6", "lon_e6", F.col("elev").alias("_z"), F.lit("cached").alias("_s")).unionByName(answers.select("lat_e6", "lon_e6", F.col("elev").alias("_z"), F.when(F.col("ok"), "fetched").otherwise("failed").alias("_s")))
    found = keyed.join(state, ["lat_e6", "lon_e6"], "left")
    fine = tight_elevation(F.col("_z"), F.col("lat_e6") / 1e6, F.col("lon_e6") / 1e6)
    return found.select(*[F.col(f"`{c}`") for c in points.columns], fine.alias("elev_point"), F.coalesce("_s", F.lit("none")).alias("elev_state"))
