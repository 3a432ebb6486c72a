"""Rides as the driver's tables hold them: ``events`` become the samples of rides, ``orders`` the list of rides.

Each table has the same definition in Spark SQL and in DuckDB SQL, so that every operator can be compared on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POINTS = """
SELECT *, CASE WHEN grade < -0.01E0 THEN 'coast' WHEN speed < 0.3E0 THEN 'static' ELSE 'pedal' END AS mode FROM (
SELECT *, CASE (idx {div} 12) % 3 WHEN 0 THEN 0.05E0 WHEN 1 THEN -0.04E0 ELSE 0.0E0 END AS grade,
       6.0E0 + 3.0E0 * sin(idx / 5.0E0) AS speed, t * 7.0E0 AS dist, 100.0E0 + 20.0E0 * sin(t / 60.0E0) AS elev,
       52.0E0 + 1.0E-4 * idx + 1.0E-2 * (ride_id % 7) AS lat, -1.5E0 + 1.0E-4 * (idx % 37) AS lon
FROM (SELECT user_id AS ride_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
             ({micros} - 1704067200000000) / 3.6E9 AS t, value AS watts,
             CASE WHEN event_id % 10 = 0 THEN NULL ELSE 95.0E0 + (event_id * 7) % 85 END AS hr FROM events))
"""
_RIDES = """
SELECT o_orderkey AS ride_id, o_custkey AS route_id, {micros} / 8.64E10 AS day, o_totalprice / 1000.0E0 AS trimp,
       o_totalprice AS distance_m, o_orderstatus <> 'F' AS has_hr, o_orderpriority AS filename FROM orders
"""
#: The same samples 20 s apart: long efforts with stops, heart rates that rise, tags of descents.
_EFFORTS = """
SELECT ride_id, idx, idx * 20.0E0 AS t, CASE WHEN stop THEN 0.0E0 ELSE 7.0E0 + 0.5E0 * sin(idx / 7.0E0) END AS speed, CASE WHEN stop THEN 0.0E0 ELSE 180.0E0 + 12.0E0 * sin(idx / 3.0E0) + idx % 5 END AS watts,
       118.0E0 + idx * 0.12E0 * (1 + ride_id % 3) + (hr - 95.0E0) / 20.0E0 AS hr, CASE WHEN stop THEN 'static' ELSE 'pedal' END AS mode
FROM (SELECT *, idx % 40 BETWEEN 36 AND 38 OR (ride_id % 2 = 0 AND idx BETWEEN 48 AND 54) AS stop FROM ({points}))
"""
_TAGGED = """
SELECT *, CASE WHEN (idx {div} 36 + ride_id) % 4 = 1 THEN 'coast' WHEN (idx {div} 36 + ride_id) % 4 = 2 AND idx % 12 = 3 THEN 'pedal' END AS label FROM ({points})
"""
POINTS_SQL = _POINTS.format(div="//", micros="epoch_us(ts)")
RIDES_SQL = _RIDES.format(micros="epoch_us(o_orderdate)")
EFFORTS_SQL = _EFFORTS.format(points=POINTS_SQL)
TAGGED_SQL = _TAGGED.format(points=POINTS_SQL, div="//")


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {" + table + "}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ride_id, idx, t, watts, hr, grade, speed, dist, elev, lat, lon, mode."""
    return _view(spark, sf_dir, "events", _POINTS.format(div="div", micros="unix_micros(CAST(ts AS timestamp))"))


def efforts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ride_id, idx, t, speed, watts, hr, mode."""
    return spark.sql(_EFFORTS.format(points="SELECT * FROM {p}"), p=points(spark, sf_dir))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with a label column: coast, pedal or none."""
    return spark.sql(_TAGGED.format(points="SELECT * FROM {p}", div="div"), p=points(spark, sf_dir))


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ride_id, route_id, day, trimp, distance_m, has_hr, filename."""
    return _view(spark, sf_dir, "orders", _RIDES.format(micros="unix_micros(CAST(o_orderdate AS timestamp))"))
