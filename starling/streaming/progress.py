"""Progress reports: every so many rows, to a callback, from a stream's listener or along a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.analytics import allocated


class Progress(StreamingQueryListener):
    """Calls say(text) whenever a query has read another ``every`` rows; nothing is posted anywhere else."""

    def __init__(self, say: Callable[[str], None], every: int = 1000) -> None:
        self.say, self.every, self.rows = say, every, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        before = self.rows.get(str(p.id), 0)
        self.rows[str(p.id)] = now = before + p.numInputRows
        if now // self.every > before // self.every:
            self.say(f"{p.name or p.id}: {now} rows")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.rows.pop(str(event.id), None)


def watched(spark: SparkSession, say: Callable[[str], None], every: int = 1000) -> Progress:
    listener = Progress(say, every)
    spark.streams.addListener(listener)
    return listener


def milestones(rows: DataFrame, order: list[str], every: int, block: Column) -> DataFrame:
    """The rows at which another ``every`` are done, with ``done``. block: a coarse, monotone function of the order."""
    return allocated(rows, order, 1 << 31, block).withColumn("done", F.col("alloc") + 1).where(F.col("done") % every == 0).drop("alloc")
