"""Writers: counts, JSON lines, clusters, and updates of a table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_csv(rows: DataFrame, path: str) -> None:
    """A CSV quoted by |, only where need be."""
    rows.write.option("quote", "|").csv(path)


def json_lines(rows: DataFrame, path: str, most: int = 1_000_000) -> None:
    """JSON lines, at most ``most`` to a file."""
    rows.write.option("maxRecordsPerFile", most).json(path)


def clusters(rows: DataFrame, path: str) -> None:
    """Clusters with their nested messages and centres, to read back with spark.read.parquet."""
    rows.write.partitionBy("status").parquet(path)


def dimension(rows: DataFrame, path: str, key: str, files: int = 1) -> None:
    """A dimension table, dealt by key into so many files and sorted in each, so that footers prune a lookup by key."""
    rows.repartitionByRange(files, key).sortWithinPartitions(key).write.parquet(path)


def bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key: joins and lookups on it need no shuffle."""
    rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


def unique(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with one to each key, the first by order: what a unique index would have let in. Nulls are a key like others."""
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("__first")).select(key, "__first.*").select(*rows.columns)


def updated(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with the columns of new (but the key) where new has the key; other rows keep theirs, or null."""
    fields = [c for c in new.columns if c != key]
    given = new.select(key, F.struct(*fields).alias("__new"))
    out = rows.join(given, key, "left")
    for c in fields:
        mine = F.col(c) if c in rows.columns else F.lit(None)
        out = out.withColumn(c, F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(mine))
    return out.drop("__new")
