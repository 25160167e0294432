"""Spectra of hourly series by the discrete Fourier transform."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(series: DataFrame, order: str, value: str) -> DataFrame:
    """(n, x, size): a series by position. It is an aggregate over hours, a few thousand rows a year."""
    rows = series.select(F.row_number().over(Window.orderBy(order)).alias("k"), F.col(value).cast("double").alias("x"))
    return rows.select((F.col("k") - 1).alias("n"), "x", F.count("*").over(Window.partitionBy()).alias("size"))


def spectrum(points: DataFrame) -> DataFrame:
    """(k, re, im, size): every bin of the transform, the mean taken off before. An empty series has none.

    An hourly series is an aggregate (a century has under a million hours), so one fast transform takes it whole.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("n")["x"].to_numpy()
        y = np.fft.fft(x - x.mean())
        return pd.DataFrame({"k": np.arange(len(x)), "re": y.real, "im": y.imag, "size": len(x)})

    return points.groupBy("size").applyInPandas(run, "k bigint, re double, im double, size bigint")


def magnitudes(bins: DataFrame) -> DataFrame:
    """(k, magnitude): 2 / N times the size of the first half's bins."""
    return bins.where(F.col("k") < F.floor(F.col("size") / 2)).select("k", (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) * 2 / F.col("size")).alias("magnitude"))


def band(points: DataFrame, bins: DataFrame, keep: list[int], last: bool = True) -> DataFrame:
    """(n, x): the real part of the inverse transform of the kept bins, and of the last one if asked."""
    own = bins.where(F.col("k").isin(keep) | (F.lit(last) & (F.col("k") == F.col("size") - 1))).select("k", "re", "im")
    turn = 2 * math.pi * F.pmod(F.col("k") * F.col("n"), F.col("size")) / F.col("size")
    pairs = points.select("n", "size").join(F.broadcast(own), F.lit(True))  # len(keep) + 1 rows
    return pairs.groupBy("n").agg((F.sum(F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn)) / F.max("size")).alias("x"))
