"""User profiles from a cache, and from timelines where the cache has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cached(requests: DataFrame, cache: DataFrame, timelines: DataFrame, denied: DataFrame) -> DataFrame:
    """Of users asked for (user), rows (user, mentions, locations, private, origin, fresh).

    A user in the cache (user, mentions, locations, private) is answered from there; a private marker answers with
    nothing. Others are built from timelines (user, mentions, locations) or, where access is denied (user), become a
    private marker. Users with neither have no row. ``fresh`` rows are those to add to the cache.
    """
    wanted = requests.select("user").where("user IS NOT NULL").distinct()
    known = cache.select("user", F.struct("mentions", "locations", F.coalesce("private", F.lit(False)).alias("private")).alias("c"))
    line = timelines.select("user", F.struct("mentions", "locations").alias("t"))
    rows = wanted.join(known, "user", "left").join(line, "user", "left").join(denied.select("user").distinct().withColumn("d", F.lit(True)), "user", "left")
    hit, no = F.col("c").isNotNull(), F.coalesce("d", F.lit(False))
    private = F.when(hit, F.col("c.private")).otherwise(no)
    of = lambda f: F.when(~private, F.when(hit, F.col(f"c.{f}")).otherwise(F.col(f"t.{f}")))
    rows = rows.where(hit | no | F.col("t").isNotNull())
    return rows.select("user", of("mentions").alias("mentions"), of("locations").alias("locations"), private.alias("private"), F.when(hit, "cache").when(no, "denied").otherwise("timeline").alias("origin"), (~hit).alias("fresh"))
