"""Import jobs: every file that arrives is a job with a state, and a bad file ends its own job only.

A job is queued when its file arrives, running once the file is parsed, then done, duplicate or error; a final state stays. Events are a log: those of the
start are written as a batch begins; the final ones are committed with the rides' own tables, in one step (plans.committed), so a job is done if and only if its
ride can be read. A batch that is tried again writes the same files again, or, once committed, nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import committed, ride_pipeline
from ..plans.storage import stored
from ..sources import activity

# Limits of a file, and the states in the order of a job's life.
MAX_BYTES, LEAST_RECORDS, MOST_RECORDS = 64 << 20, 20, 200_000
STATES = ("queued", "running", "done", "duplicate", "error")
FINAL = STATES[2:]
EVENT = "job_id string, path string, file_hash string, status string, progress int, message string"


def job_of(path: Column, hashed: Column) -> Column:
    """A job's id: a file with new content is another job, a file that is read again is not."""
    return F.substring(F.sha2(F.concat_ws("\0", path, hashed), 256), 1, 16)


def ride_of(hashed: Column) -> Column:
    """A ride's id by its content."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def batch_key(query: str, number: int) -> int:
    """A batch's number that no other stream has: a stream keeps its id over restarts, as its checkpoint does."""
    return zlib.crc32(query.encode()) << 31 | number


def _event(status: Column | str, progress: int, message: Column) -> list[Column]:
    return ["job_id", "path", "file_hash", (F.lit(status) if isinstance(status, str) else status).alias("status"), F.lit(progress).alias("progress"), message.alias("message")]


def judged(files: DataFrame, known: DataFrame, max_bytes: int = MAX_BYTES, least: int = LEAST_RECORDS, most: int = MOST_RECORDS) -> tuple[DataFrame, DataFrame]:
    """The final event of each of a batch's jobs, and the records of those that are done. files: job_id, path, file_hash, content; known: file_hash of rides that are there.

    Too large a file is not parsed. Of equal files of a batch the first by path is imported; a repeat of a bad file is bad as well."""
    size = F.coalesce(F.length("content"), F.lit(0))
    order = Window.partitionBy("file_hash").orderBy("path", "job_id")
    jobs = stored(files.select("job_id", "path", "file_hash", size.alias("size"), (F.row_number().over(order) > 1).alias("again")), "import-jobs")
    first = files.where(size <= max_bytes).join(jobs.where("NOT again").select("job_id"), "job_id", "left_semi")
    parsed = stored(activity.outcomes(first.select("file_hash", "content"), "file_hash"), "import-records").withColumnRenamed("path", "file_hash")
    counts = parsed.groupBy("file_hash").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n"), F.max("error").alias("error"))
    there = known.select("file_hash").distinct().withColumn("there", F.lit(True))
    told = jobs.join(counts, "file_hash", "left").join(there, "file_hash", "left")
    n, repeat = F.coalesce("n", F.lit(0)), F.col("again") | F.coalesce("there", F.lit(False))
    why = (
        F.when(F.col("size") > max_bytes, F.concat(F.lit("File too large: "), F.col("size"), F.lit(" bytes")))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(n < least, F.concat(F.lit("Too few records: "), n)).when(n > most, F.concat(F.lit("Too many records: "), n))
    )
    status = F.when(why.isNotNull(), "error").when(repeat, "duplicate").otherwise("done")
    final = stored(told.select(*_event(status, 100, F.coalesce(why, F.when(repeat, "Already imported").otherwise("Imported")))), "import-final")
    return final, parsed.where("error IS NULL").join(final.where("status = 'done'").select("file_hash"), "file_hash", "left_semi")


def samples_of(records: DataFrame) -> DataFrame:
    """Processed samples of new rides, for ``committed.ride_tables``: records (file_hash, idx, t, ...) with elevation and power."""
    p = records.select(ride_of(F.col("file_hash")).alias("ride_id"), "file_hash", F.col("idx").cast("long").alias("idx"), "t", "lat", "lon", F.col("alt_raw").alias("elev"), F.coalesce("speed", F.lit(0.0)).alias("speed"), F.coalesce("dist", F.lit(0.0)).alias("dist"), F.col("hr").cast("double").alias("hr"))
    return ride_pipeline.with_power(ride_pipeline.with_elevation(p))


def import_files(files: DataFrame, root: str, checkpoint: str, weather: Callable[[DataFrame], DataFrame] | None = None, then: Callable[[int], None] | None = None, quiet: str | None = None, max_bytes: int = MAX_BYTES):
    """Start importing a stream of files(path, file_hash, content) into the tables under ``root``; returns the streaming query.

    weather: from the new rides (ride_id, t, lat, lon of their samples) to their weather rows; then: what follows a committed batch, one batch at a time;
    quiet: keep waiting and take what arrives within it as one batch, else import what there is."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        number = batch_key(spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "", number)
        if committed.is_committed(spark, root, number):
            return
        here = batch.select(job_of(F.col("path"), F.col("file_hash")).alias("job_id"), "path", "file_hash", "content").dropDuplicates(["job_id"])
        begun = stored(here.select("job_id", "path", "file_hash"), "import-begun")
        start = f"{root}/job_start/batch={number}"
        begun.select(*_event("queued", 0, F.lit("Queued"))).write.mode("overwrite").parquet(f"{start}/stage=0")
        known = committed.read(spark, root, "ride").select("file_hash")
        final, records = judged(here, known, max_bytes)
        begun.select(*_event("running", 50, F.lit("Parsed"))).write.mode("overwrite").parquet(f"{start}/stage=1")
        samples = stored(samples_of(records), "import-samples")
        tables = committed.ride_tables(samples, weather(samples) if weather else None)
        committed.insert(spark, root, number, {"job_event": final, **tables})
        if then:
            then(number)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": quiet} if quiet else {"availableNow": True})).start()


def events(spark: SparkSession, root: str) -> DataFrame:
    """All events of all jobs, with their batch: starts as they were written, ends as they were committed."""
    begun = committed.rows_at(spark, f"{root}/job_start", EVENT + ", batch long, stage int").drop("stage")
    names = begun.columns
    return begun.unionByName(committed.read(spark, root, "job_event", EVENT).select(*names))


def _rank() -> Column:
    """How far a state is in a job's life: final states are equal."""
    return F.when(F.col("status") == "queued", 0).when(F.col("status") == "running", 1).otherwise(2)


def states(log: DataFrame) -> DataFrame:
    """Each job's present state: the furthest one, of final ones that of its first batch, of one batch's the first in STATES' order. One aggregate, combined before it is shuffled."""
    later = F.struct(_rank().alias("r"), (-F.col("batch")).alias("b"), (-F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))).alias("s"))
    best = log.groupBy("job_id").agg(F.max_by(F.struct("path", "file_hash", "status", "progress", "message", "batch"), later).alias("e"))
    return best.select("job_id", "e.*")


def followed(log: DataFrame, time: str | None = None) -> DataFrame:
    """The same as a stream: a row for each change of a job's state (job_id, status, progress, message, changes), by a keyed state machine that never leaves a final state
    and never goes back."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, changes = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(frames))
        rows["_r"] = [min(STATES.index(s), 2) for s in rows["status"]]
        rows["_s"] = [STATES.index(s) for s in rows["status"]]
        for r in rows.sort_values(["_r", "batch", "_s"], kind="stable").itertuples():
            if status is None or (status not in FINAL and STATES.index(r.status) > STATES.index(status)):
                status, changes = r.status, changes + 1
                out.append((key[0], r.status, r.progress, r.message, changes))
        state.update((status, changes))
        yield pd.DataFrame(out, columns=["job_id", "status", "progress", "message", "changes"])

    return log.groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, progress int, message string, changes int", "status string, changes int", "append", GroupStateTimeout.NoTimeout)
