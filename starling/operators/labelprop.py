"""Location inference by spatial label propagation over mutual mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .spatial import medoids


def mutual(mentions: DataFrame, least: int) -> DataFrame:
    """(src, dst, cnt_out, cnt_in) of pairs that mention each other at least ``least`` times, in both directions."""
    own = mentions.where(F.col("cnt") >= least)
    back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cnt").alias("cnt_in"))
    return own.withColumnRenamed("cnt", "cnt_out").join(back, ["src", "dst"])


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, each once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def network(edges: DataFrame, key: int, depth: int) -> DataFrame:
    """(user, depth) of all within ``depth`` steps of the key user, level by level, each at its first level."""
    both = symmetric(edges)
    seen = both.sparkSession.createDataFrame([(key, 0)], "user bigint, depth int")
    level = seen
    for d in range(1, depth + 1):
        level = level.join(both, F.col("user") == F.col("src")).select(F.col("dst").alias("user"), F.lit(d).alias("depth")).distinct().join(seen, "user", "left_anti")
        seen = seen.unionByName(level)
    return seen


def seeds(geotags: DataFrame, least: int, hidden: int | None = None) -> DataFrame:
    """(user, lat, lon, km): medoids of users (user, lat, lon rows) with at least ``least`` geotags; a hidden user has none."""
    enough = geotags.groupBy("user").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = geotags.join(enough, "user", "left_semi")
    return medoids(rows.where(F.col("user") != hidden) if hidden is not None else rows, "user")


def step(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """New labels: users without one whose neighbours have some get the medoid of theirs. All read the old labels."""
    near = edges.join(labels.select(F.col("user").alias("dst"), "lat", "lon"), "dst").select(F.col("src").alias("user"), "lat", "lon")
    near = near.join(labels.select("user"), "user", "left_anti")
    return medoids(near, "user")


def infer(mentions: DataFrame, geotags: DataFrame, user: int, test: bool = False, least_mentions: int = 3, depth: int = 3, least_locations: int = 1, rounds: int = 4) -> DataFrame:
    """Where a user is, by the labels of the mention network around them: (user, lat, lon, km, iteration), or no row.

    mentions (src, dst, cnt), geotags (user, lat, lon). In a test the user's own geotags are hidden.
    """
    edges = mutual(mentions, least_mentions)
    near = stored(network(edges, user, depth).select("user"))
    inside = edges.join(near.select(F.col("user").alias("src")), "src", "left_semi").join(near.select(F.col("user").alias("dst")), "dst", "left_semi")
    found = propagate(inside, seeds(geotags.join(near, "user", "left_semi"), least_locations, user if test else None), rounds, user)
    return found.where(F.col("user") == user)


def propagate(edges: DataFrame, labels: DataFrame, rounds: int, key: int | None = None) -> DataFrame:
    """(user, lat, lon, km, iteration): seeds at 0, then at most ``rounds`` steps; it stops when the key user has a
    label or a step labels nobody. Every step is stored, so plans don't grow."""
    edges, labels = stored(symmetric(edges)), stored(labels)
    out = labels.withColumn("iteration", F.lit(0))
    for i in range(1, rounds + 1):
        if key is not None and out.where(F.col("user") == key).take(1):
            break
        new = stored(step(edges, out.drop("iteration")).withColumn("iteration", F.lit(i)))
        if not new.take(1):
            break
        out = out.unionByName(new)
    return out
