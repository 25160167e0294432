"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written inside the innermost scratch(), or None outside.
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset one of our own.

    A machine-local folder is only used on a local master, where driver and executors are one process.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.startswith("local["):
        own = "file://" + tempfile.mkdtemp(prefix="starling-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, kind: str = "starling") -> str:
    """A path in the shared folder that nobody has used."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if (own := _written.get()) is not None:
        own.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table by whatever file system its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside go at the end, but for those that the function it gives has stored.

    What leaves the block must rest on these alone.
    """
    outer, own = _written.get(), []

    def keep(df: DataFrame) -> DataFrame:
        inner = _written.set(outer)
        try:
            return stored(df)
        finally:
            _written.reset(inner)

    token = _written.set(own)
    try:
        yield keep
    finally:
        _written.reset(token)
        for path in own:
            delete(spark, path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give back their shuffle files as they end, not when the driver happens to collect garbage.

    Their results have to be at the driver or stored by then.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
