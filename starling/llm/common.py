"""Helpers shared by the training-data operators: reading, shared storage, words and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import new_path, scratch, stored  # noqa: F401

#: White space that separates words, as a regular-expression class body.
WHITE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data, by whatever path Spark's readers understand."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, each: int = 64 << 20) -> int:
    """Partitions so that each holds about so many bytes of df by Spark's own estimate, and at least the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(size // each, 200_000))


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), "")


# --- numpy side ------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """64-bit hashes of words (bytes), remembered up to a bound so that a frequent word is hashed once."""

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, split: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, split), np.uint64, len(split))


def shingles(ids: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive word ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    last = len(ids) - n + 1
    h = np.full(last, 0x9E3779B97F4A7C15 + seed, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + last])
    return h


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Arrow batches small enough that this many very long texts fit a Python worker, some times over.

    The setting is the session's and is read when a result runs, so it only ever goes down: what an operator asked for
    holds whatever is called before its result runs.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def bit_table(keys: DataFrame, key: str, bits: int, slice_bits: int = 8) -> np.ndarray:
    """2**bits bits with those of the keys set: 2**bits / 8 bytes at the driver, whatever the input.

    A key (bigint) has the bit of its low bits, which should be uniform. Read with has_bit().
    """
    low = (1 << slice_bits) - 1

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for f in frames:
            at = f[key].to_numpy() & ((1 << bits) - 1)
            for s in np.unique(at & low).tolist():
                own.setdefault(s, np.zeros(1 << (bits - slice_bits), bool))[at[at & low == s] >> slice_bits] = True
        for s, x in own.items():
            yield pd.DataFrame({"slice": [s], "image": [np.packbits(x).tobytes()]})

    # every slice is made by one task, so that each reaches the driver once
    spread = keys.select(key).repartition(F.col(key).bitwiseAND(low))
    table = np.zeros((1 << slice_bits, 1 << (bits - slice_bits - 3)), np.uint8)
    for r in spread.mapInPandas(build, "slice int, image binary").collect():  # 2**slice_bits rows, of fixed size together
        table[r["slice"]] = np.frombuffer(r["image"], np.uint8)
    return table


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (int64) may be in the table; never misses one that is."""
    slice_bits, bits = len(table).bit_length() - 1, (table.size * 8).bit_length() - 1
    at = keys & ((1 << bits) - 1)
    inner = at >> slice_bits
    return (table[at & (len(table) - 1), inner >> 3] >> (7 - (inner & 7)).astype(np.uint8) & 1).astype(bool)


def summed_counts(rows: DataFrame, size: int, add: Callable[[np.ndarray], Callable[[pd.DataFrame], None]], slices: int = 256) -> np.ndarray:
    """The sum over all tasks of ``size`` counters. add(counters) gives what counts a frame; the result is bounded by size.

    Each task sends its counters once, cut into slices (those of zeros not), and every slice is summed by one task.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        take = add(total)
        for f in frames:
            take(f)
        kind = np.uint32 if total.max(initial=0) < 2**32 else np.int64
        parts = [(s, x.astype(kind).tobytes()) for s, x in enumerate(np.split(total, slices)) if x.any()]
        yield pd.DataFrame(parts, columns=["slice", "counts"])

    width = size // slices

    def counters(x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.uint32 if len(x) == 4 * width else np.int64).astype(np.int64)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for f in frames:
            for s, x in zip(f["slice"], f["counts"], strict=True):
                own[s] = own.get(s, 0) + counters(x)
        for s, x in own.items():
            yield pd.DataFrame({"slice": [s], "counts": [x.tobytes()]})

    schema, total = "slice int, counts binary", np.zeros(size, np.int64)
    for r in rows.mapInPandas(count, schema).repartition("slice").mapInPandas(merge, schema).collect():  # size counters together
        total[r["slice"] * width :][:width] += np.frombuffer(r["counts"], np.int64)
    return total
