"""Readers of reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import rings


def top_level_domains(spark: SparkSession, path: str) -> DataFrame:
    """(code, country) of a headerless CSV quoted by |; countries lose the blanks around them."""
    rows = spark.read.schema("code string, country string, more string").option("quote", "|").csv(path)
    return rows.select("code", F.trim("country").alias("country"))


def listed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The first column of a CSV quoted by |, as a list to join on."""
    return spark.read.option("quote", "|").csv(path).select(F.col("_c0").alias(key)).where("_c0 IS NOT NULL").distinct()


def polygons(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Shapes as JSON lines with properties and a geometry written as nested tuples: names, and ``poly``, all rings."""
    schema = ", ".join(f"{n} string" for n in names) + ", poly string"
    return spark.read.schema(schema).json(path).withColumn("poly", rings(F.col("poly")))


def random_row(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row of all, the same for the same seed: that with the least hash of key and seed. A partial top-1, no sort."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), key).limit(1)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """Clusters as sinks.clusters has written them."""
    return spark.read.parquet(path)


def user_profiles(messages: DataFrame) -> DataFrame:
    """(user, mentions map, locations) of messages (id, user, mentioned ids, lat, lon), each message counted once."""
    messages = messages.dropDuplicates(["id"])
    counts = messages.select("user", F.explode("mentioned").alias("m")).groupBy("user", "m").agg(F.count("*").cast("int").alias("n"))
    maps = counts.groupBy("user").agg(F.map_from_entries(F.collect_list(F.struct(F.col("m").cast("string"), "n"))).alias("mentions"))
    places = messages.where("lat IS NOT NULL").groupBy("user").agg(F.collect_list(F.struct("lat", "lon")).alias("locations"))
    return messages.select("user").distinct().join(maps, "user", "left").join(places, "user", "left")
