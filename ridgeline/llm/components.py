"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that is reachable) for every node of links(a, b).

    Each round takes the least label among a node's neighbours and then that label's own label, so chains shrink by
    more than half; aggregates combine before they shuffle, so a node with very many links does no harm.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # a label is a node too; its label as of the last round is at most itself
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = stored(least.join(up, "component", "left").select("node", "old", F.least("component", "above").alias("component")), "labels")
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
