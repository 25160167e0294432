"""Tumbling counters: the same expression on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(rows: DataFrame, ts: str, name: str, size: str) -> DataFrame:
    """(start, name, cnt): rows per name in windows of event time. On a stream, give rows a watermark first."""
    return rows.groupBy(F.window(ts, size).alias("w"), name).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), name, "cnt")


def report(stream: DataFrame, ts: str, name: str, size: str, late: str, checkpoint: str, callbacks: list[Callable[[DataFrame, int], None]]) -> StreamingQuery:
    """Counts a stream's windows and hands each batch of finished ones to every callback; None callbacks are skipped."""
    counts = tumbling(stream.withWatermark(ts, late), ts, name, size)

    def hand_on(batch: DataFrame, batch_id: int) -> None:
        for f in callbacks:
            if f is not None:
                f(batch, batch_id)

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(hand_on).start()
