"""Collection of messages from a stream: keyword filter, enrichment, storage and callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tracks


def collected(rows: DataFrame, name: str, track: str) -> DataFrame:
    """Messages whose text matches track, with ``collection`` and ``timestamp_obj``; rows without text go. Batch or stream."""
    rows = rows.where(F.col("text").isNotNull() & tracks(F.col("text"), track))
    return rows.withColumns({"collection": F.lit(name), "timestamp_obj": F.timestamp_millis(F.col("timestamp_ms").cast("bigint"))})


def matched(rows: DataFrame, searches: dict[str, str]) -> DataFrame:
    """collected() for several searches (name to track) in one pass: a message has a row for each that it matches."""
    hits = F.filter(F.array(*[F.when(tracks(F.col("text"), track), F.lit(name)) for name, track in sorted(searches.items())]), lambda x: x.isNotNull())
    rows = rows.where("text IS NOT NULL").withColumn("collection", F.explode(hits))
    return rows.withColumn("timestamp_obj", F.timestamp_millis(F.col("timestamp_ms").cast("bigint")))


def start_all(stream: DataFrame, searches: dict[str, str], path: str, checkpoint: str, callbacks: list[Callable[[str, DataFrame, int], None] | None] | None = None) -> dict[str, StreamingQuery]:
    """One query for each search (name to track), each with its own table, checkpoint and thread."""
    return {name: start(stream, name, track, f"{path}/{name}", f"{checkpoint}/{name}", callbacks) for name, track in searches.items()}


def start(stream: DataFrame, name: str, track: str, path: str, checkpoint: str, callbacks: list[Callable[[str, DataFrame, int], None] | None] | None = None) -> StreamingQuery:
    """Writes each batch to a table, partitioned by ``batch``, and hands it to every callback (name, batch, batch id).

    A batch that is run again replaces its own partition, so nothing is stored twice, and callbacks read what was stored.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        own = f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(own)
        batch = batch.sparkSession.read.schema(batch.schema).parquet(own)
        for f in callbacks or []:
            if f is not None:
                f(name, batch, batch_id)

    return collected(stream, name, track).writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep).start()
