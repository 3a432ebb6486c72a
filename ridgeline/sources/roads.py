"""Road networks as a map service answers for a box: one JSON array that mixes nodes and ways, split into segments by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins

RESPONSE = "elements array<struct<type: string, id: bigint, lat: double, lon: double, nodes: array<bigint>, tags: map<string, string>>>"


def box_key(south, west, north, east) -> Column:
    """The name under which a box's answer is kept: its sides to four places."""
    return F.format_string("%.4f_%.4f_%.4f_%.4f", *[F.col(c).cast("double") if isinstance(c, str) else F.lit(float(c)) for c in (south, west, north, east)])


def elements(answers: DataFrame) -> DataFrame:
    """box, type, id, lat, lon, nodes, tags of answers(box, body); a body that is no such JSON gives no rows (``failed`` has it)."""
    parsed = answers.select("box", F.from_json("body", RESPONSE).alias("r"))
    return parsed.select("box", F.explode("r.elements").alias("e")).select("box", "e.*")


def failed(answers: DataFrame) -> DataFrame:
    """Boxes whose answer can't be read or is empty: they are asked for again."""
    parsed = answers.select("box", F.from_json("body", RESPONSE).alias("r"))
    return parsed.where(F.coalesce(F.size("r.elements"), F.lit(0)) <= 0).select("box")


def to_fetch(boxes: DataFrame, answers: DataFrame) -> DataFrame:
    """Boxes without an answer that can be read."""
    good = answers.join(failed(answers), "box", "left_anti")
    return joins.missing(boxes.select("box").distinct(), good.select("box"), ["box"])


def network(answers: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """box, way, k, lat1, lon1, lat2, lon2: segments between consecutive known nodes of each way. kinds: only ways whose ``highway`` tag is one of these. A node is
    known within its box's answer; ways and nodes meet by (box, id), so neither is gathered."""
    e = elements(answers)
    ways = e.where("type = 'way' AND id IS NOT NULL")
    if kinds is not None:
        ways = ways.where(F.col("tags")["highway"].isin(*kinds))
    named = ways.select(F.struct("box", "id").alias("way"), F.transform("nodes", lambda n: F.struct(F.col("box").alias("box"), n.alias("id"))).alias("nodes"))
    nodes = e.where("type = 'node' AND lat IS NOT NULL AND lon IS NOT NULL").select(F.struct("box", "id").alias("node"), "lat", "lon").dropDuplicates(["node"])
    return joins.way_segments(named, nodes).select(F.col("way.box").alias("box"), F.col("way.id").alias("way"), "k", "lat1", "lon1", "lat2", "lon2")
