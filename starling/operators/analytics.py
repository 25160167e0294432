"""Batch analytics over message streams: counts, hourly series, gaps, allocation, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_over(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """How often each key occurs, for those above limit: (key, cnt)."""
    return rows.groupBy(key).agg(F.count("*").alias("cnt")).where(F.col("cnt") > limit)


def count_histogram(rows: DataFrame, key: str) -> DataFrame:
    """How many keys occur how often: (posts, users)."""
    return rows.groupBy(key).agg(F.count("*").alias("posts")).groupBy("posts").agg(F.count("*").alias("users"))


def hourly(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """(hour, cnt): rows of each hour that has any."""
    return rows.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("cnt"))


def hour_means(series: DataFrame) -> DataFrame:
    """(hod, hour_mean): the mean count of each hour of day, over hours that exist."""
    return series.groupBy(F.hour("hour").alias("hod")).agg(F.avg("cnt").alias("hour_mean"))


def gap_filled(series: DataFrame) -> DataFrame:
    """(hour, cnt, hour_mean) for every hour from the first to before the last; missing hours count 0.

    hour_mean is the hour of day's mean; null where no such hour exists.
    """
    bounds = series.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).where("lo < hi")
    grid = bounds.select(F.explode(F.expr("sequence(lo, hi - interval 1 hour, interval 1 hour)")).alias("hour"))
    out = grid.join(series, "hour", "left").withColumn("hod", F.hour("hour")).join(F.broadcast(hour_means(series)), "hod", "left")  # 24 means
    return out.select("hour", F.coalesce("cnt", F.lit(0)).alias("cnt"), "hour_mean")


def gaps(rows: DataFrame, ts: str, seconds: int, block: str = "day") -> DataFrame:
    """(prev_ts, next_ts) where neighbours in time lie more than ``seconds`` apart.

    Neighbours inside a block of time come from a window on it; between blocks, from each block's ends. So no window
    holds more than a block, or one row per block.
    """
    rows = rows.select(F.col(ts).alias("t"), F.date_trunc(block, ts).alias("b")).where("t IS NOT NULL")
    inner = rows.withColumn("prev_ts", F.lag("t").over(Window.partitionBy("b").orderBy("t"))).select("prev_ts", F.col("t").alias("next_ts"))
    ends = rows.groupBy("b").agg(F.min("t").alias("next_ts"), F.max("t").alias("hi"))
    outer = ends.withColumn("prev_ts", F.lag("hi").over(Window.orderBy("b"))).select("prev_ts", "next_ts")
    return inner.unionByName(outer).where(F.unix_micros("next_ts") - F.unix_micros("prev_ts") > seconds * 1_000_000)


def allocated(rows: DataFrame, order: list[str], parts: int, block: Column) -> DataFrame:
    """rows with ``alloc``: their number in order modulo parts. block: a coarse, monotone function of the order.

    Ranks are counted inside blocks, and blocks' counts are summed, so that no task orders all rows.
    """
    rows = rows.withColumn("__b", block)
    before = rows.groupBy("__b").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__b")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return rows.join(before, "__b").withColumn("alloc", F.pmod(F.col("__before") + rank, F.lit(parts)).cast("int")).drop("__b", "__before")


def smoothed(series: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """(keys, order, value, ewma): x * alpha + last * (1 - alpha) along each key's order, from 0.

    In closed form: inside blocks of rows it is a running sum of x / (1 - alpha)**place, scaled back; blocks are short
    enough that the powers stay below 1e15. Only one row for each block is folded in order.
    """
    keep = 1 - alpha
    size = max(2, min(4096, int(-15 / math.log10(keep)))) if 0 < keep < 1 else 4096
    rows = series.select(*keys, order, value).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    rows = rows.withColumns({"__b": F.floor(F.col("__n") / size), "__p": F.pow(F.lit(float(keep)), (F.col("__n") % size).cast("double"))})
    inside = Window.partitionBy(*keys, "__b").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.sum(F.col(value) * alpha / F.col("__p")).over(inside) * F.col("__p"))
    ends = rows.groupBy(*keys, "__b").agg(F.max_by("__own", "__n").alias("own"), (F.max_by("__p", "__n") * keep).alias("keep"))
    lists = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__b", "own", "keep"))).alias("ends"))
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))
    before = F.aggregate("ends", start, lambda a, x: F.struct((x["own"] + a["last"] * x["keep"]).alias("last"), F.concat(a["out"], F.array(a["last"])).alias("out")))["out"]
    before = lists.select(*keys, F.posexplode(before).alias("__b", "__last"))
    rows = rows.join(before.withColumn("__b", F.col("__b").cast("bigint")), [*keys, "__b"])
    return rows.select(*keys, order, value, (F.col("__own") + F.col("__last") * F.col("__p") * keep).alias("ewma"))


def top_each(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in order, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
