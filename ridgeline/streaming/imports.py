"""Incremental import: files and events arrive as streams; results are the batch operators' own."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import C
from ..sources import activity


def arriving_files(spark: SparkSession, folder: str, files_a_batch: int = 200) -> DataFrame:
    """New files of a drop folder with the hash of their content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.fit").load(folder)
    return files.withColumn("file_hash", F.sha2("content", 256))


def without_repeats(stream: DataFrame, time: str = "modificationTime", key: str = "file_hash", delay: str = "7 days") -> DataFrame:
    """Each content once, as long as its repeat comes within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def few_enough(rides: DataFrame, most: int = 50) -> bool:
    """May a heavy fit over all rides follow by itself: only in a library of up to so many rides, of which no more are looked at."""
    return rides.limit(most + 1).count() <= most


def import_batches(files: DataFrame, table: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, quiet: str | None = None):
    """Start the import (of what there is; with ``quiet``, such as "1500 milliseconds", again and again, what arrives within it as one batch): decode each batch's files that the table does not have yet, append their records, then do what follows
    (one batch at a time, so heavy fits never overlap). A batch that is retried writes the same partition again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = activity.decode(batch.where(F.length("content") <= 64 << 20)).join(batch.select("path", "file_hash"), "path")
        sized = rows.groupBy("file_hash").agg(F.count("*").alias("n")).where("n BETWEEN 20 AND 200000")
        rows = rows.join(sized.select("file_hash"), "file_hash", "left_semi")
        try:
            rows = rows.join(spark.read.parquet(table).where(F.col("batch") != number).select("file_hash").distinct(), "file_hash", "left_anti")
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if then:
            then(rows, number)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": quiet} if quiet else {"availableNow": True})).start()


def sessions(events: DataFrame, key: str, time: str, value: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions that end at a gap: works on streams and on tables."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def windows(events: DataFrame, key: str, time: str, value: str, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Tumbling or sliding totals."""
    return events.withWatermark(time, delay).groupBy(F.window(time, length, slide).alias("window"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def training_load(events: DataFrame, key: str = "rider", day: str = "day", load: str = "trimp") -> DataFrame:
    """Long and short load after every event of a stream, carried from batch to batch; events older than the last one seen are counted as late and dropped."""
    slow, fast = C.ctl_days, C.atl_days

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ctl, atl, late = state.get if state.exists else (None, 0.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(day, kind="stable")
        out = []
        for d, x in zip(rows[day], rows[load].fillna(0.0), strict=True):
            if last is not None and d < last:
                late += 1
                continue
            gap = 0.0 if last is None else d - last
            ctl = ctl * math.exp(-gap / slow) + x * (1 - math.exp(-1 / slow))
            atl = atl * math.exp(-gap / fast) + x * (1 - math.exp(-1 / fast))
            last = d
            out.append((k[0], d, ctl, atl, late))
        state.update((last, ctl, atl, late))
        yield pd.DataFrame(out, columns=[key, day, "ctl", "atl", "late"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} bigint, {day} double, ctl double, atl double, late bigint", "last double, ctl double, atl double, late bigint", "append", GroupStateTimeout.NoTimeout)
