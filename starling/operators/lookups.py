"""Lookups of places by name, zone, offset and top-level domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_any_name(names: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """(name, area columns): areas one of whose five names equals the name, whatever the case; an area counts once."""
    own = F.array_distinct(F.transform(F.array("n1", "n2", "n3", "n4", "n5"), lambda x: F.lower(x)))
    long = areas.select("*", F.explode(own).alias("any")).where("any IS NOT NULL")
    return names.join(long, F.lower(key) == F.col("any")).drop("any")


def by_name(names: DataFrame, places: DataFrame, key: str, name: str = "name") -> DataFrame:
    return names.join(places, F.lower(F.trim(key)) == F.lower(F.trim(name)))


def by_part(names: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """Zones whose name holds the key, as LIKE '%key%' without case; keys are made distinct first, for no index helps."""
    own = names.select(key).where(F.col(key).isNotNull()).distinct()
    hits = own.join(zones, F.ilike("zone", F.concat(F.lit("%"), F.col(key), F.lit("%"))))
    return names.join(hits, key)


def by_offset(rows: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    return rows.join(zones, F.col(key).cast("string") == F.col("off"))


def american(rows: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """Zones of a standard-time code whose name holds America."""
    return rows.join(zones.where(F.col("zone").ilike("%America%")), F.col(key) == F.col("code"))
