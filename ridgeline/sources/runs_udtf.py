"""A table function: runs of samples of one ride after another, as SQL asks for them.

    SELECT * FROM runs(3, TABLE(samples) PARTITION BY ride_id ORDER BY idx)

The samples have the columns ride_id, t and is_on. A run goes out when it ends, so a ride of any length needs no more memory than its last run's bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

SCHEMA = "ride_id long, island long, n_points long, t_start double, t_end double"


class Runs:
    """Uninterrupted stretches where is_on holds, numbered from 1 within a ride; those of fewer rows than ``least`` are numbered and left out."""

    def __init__(self):
        self.least, self.island, self.open = 1, 0, None

    def _ended(self) -> Iterator[tuple]:
        if self.open and self.open[1] >= self.least:
            ride, n, start, end = self.open
            yield ride, self.island, n, start, end
        self.open = None

    def eval(self, least: int, row: Row) -> Iterator[tuple]:
        self.least = least
        if not row["is_on"]:
            yield from self._ended()
            return
        t = row["t"]
        if self.open is None:
            self.island, self.open = self.island + 1, (row["ride_id"], 1, t, t)
        else:  # null times count as rows; least and greatest skip them
            ride, n, start, end = self.open
            known = [x for x in (start, end, t) if x is not None]
            self.open = ride, n + 1, min(known, default=None), max(known, default=None)

    def terminate(self) -> Iterator[tuple]:
        yield from self._ended()


def register(spark: SparkSession, name: str = "runs") -> None:
    """Make the function known to SQL."""
    spark.udtf.register(name, udtf(Runs, returnType=SCHEMA))
