"""Connected components of a link table by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b), rows (id, component) of all ends; component is the smallest id that can be reached.

    Labels are pointers to smaller ids. Each round every node takes the least label's label among its neighbours and its
    own label's label, and hands what it found to the node its label points to: whole trees are hooked at their roots
    (FastSV), so rounds grow with the logarithm of a chain. It goes on until a round changes nothing. A hub's links are
    only ever joined and partially aggregated, never gathered.
    """
    links = links.where("a <> b").select("a", "b")
    edges = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        grand = stored(labels.join(up, "component").select("id", "component", "up"))
        near = edges.join(grand.select(F.col("id").alias("b"), "up"), "b").groupBy(F.col("a").alias("id")).agg(F.min("up").alias("near"))
        found = grand.join(near, "id")
        own = found.select("id", F.col("component").alias("old"), F.least("up", "near").alias("new"))
        roots = found.groupBy(F.col("component").alias("id")).agg(F.min("near").alias("new"))
        new = own.unionByName(roots, allowMissingColumns=True).groupBy("id").agg(F.max("old").alias("old"), F.min("new").alias("component"))
        new = stored(new)
        labels = new.select("id", "component")
        if not new.where("old <> component").take(1):
            return labels
