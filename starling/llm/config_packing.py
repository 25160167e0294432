"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Only the histogram (at most ``capacity`` numbers) comes to the driver. Pieces longer than ``small`` are grouped into
size classes; a configuration says how many pieces of each class share a sequence. The linear program (fewest
sequences that cover every class) is solved by multiplicative weights: a class weighs less the more of it is covered,
each round a knapsack dynamic program prices the best configuration under these weights, and it is taken until some
class has gained ``step`` of its count. Counts are rounded down to whole sequences; what is left over, and all small
pieces, go best-fit into the free space. The result is a list of groups of equal sequences. Ranks of pieces of each
length, numbered in Spark, say which sequence and place is whose.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .tokens import Encoder


def classes(counts: np.ndarray, small: int, most: int) -> list[tuple[int, int]]:
    """Ranges (low, high] of lengths, together all over small, of about equal numbers of pieces."""
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > small]
    if not len(lengths):
        return []
    share = np.cumsum(counts[lengths]) / counts[lengths].sum()
    tops = sorted({int(lengths[np.searchsorted(share, (k + 1) / most - 1e-12)]) for k in range(most)})
    return list(zip([small, *tops[:-1]], tops, strict=True))


def best_configuration(sizes: np.ndarray, values: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes of the highest value that fits (bounded knapsack; copies in powers of two)."""
    best, taken = np.zeros(capacity + 1), []
    for c in np.flatnonzero(values > 0):
        left, k = int(min(counts[c], capacity // sizes[c])), 1
        while left > 0:
            n = min(k, left)
            w = n * int(sizes[c])
            with_it = best[: capacity + 1 - w] + n * values[c]
            better = with_it > best[w:] + 1e-15
            best[w:][better] = with_it[better]
            taken.append((c, n, w, better))
            left, k = left - n, 2 * k
    out, at = np.zeros(len(sizes), np.int64), capacity
    for c, n, w, better in reversed(taken):
        if at >= w and better[at - w]:
            out[c] += n
            at -= w
    return out


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, step: float = 0.05, eta: float = 20.0) -> dict[tuple[int, ...], float]:
    """Configurations and how often each is used so that every class is covered, nearly as few as can be."""
    covered, used = np.zeros(len(sizes)), {}
    while (covered < 1).any():
        weights = np.where(covered < 1, np.exp(-eta * covered), 0) / counts
        config = best_configuration(sizes, weights / weights.max(), counts, capacity)
        gain = config / counts
        times = min(step, float((1 - covered)[config > 0].max())) / gain.max()
        covered += times * gain
        covered[covered > 1 - 1e-9] = 1
        key = tuple(config.tolist())
        used[key] = used.get(key, 0.0) + times
    return used


class Plan:
    """Groups of equal sequences, packed best-fit from a histogram of lengths."""

    def __init__(self, counts: np.ndarray, capacity: int, small: int, most_classes: int) -> None:
        self.capacity = capacity
        self.left = counts.astype(np.int64).copy()
        self.groups: list[list] = []  # [lengths in a sequence, number of such sequences]
        ranges = classes(counts, small, most_classes)
        if ranges:
            sizes = np.array([hi for _, hi in ranges])
            n = np.array([counts[lo + 1 : hi + 1].sum() for lo, hi in ranges])
            for config, times in sorted(solve(sizes, n, capacity).items(), key=lambda x: (-x[1], x[0])):
                self._take(config, int(times + 1e-9), ranges)
        self._fill()

    def _take(self, config: tuple[int, ...], times: int, ranges: list[tuple[int, int]]) -> None:
        """times sequences of a configuration, as long as every class has pieces; the longest of a class first.

        The last slot, and what room is left after it, go to the longest pieces that fit, of whatever class.
        """
        slots = [ranges[c] for c in reversed(range(len(config))) for _ in range(config[c])]
        while times > 0:
            need = np.zeros(self.capacity + 1, np.int64)
            lengths, room = [], self.capacity
            for k, (lo, hi) in enumerate(slots):
                hi = room if k == len(slots) - 1 else min(hi, room)
                there = np.flatnonzero(self.left[lo + 1 : hi + 1] > need[lo + 1 : hi + 1])
                if not len(there):
                    return
                lengths.append(lo + 1 + int(there[-1]))
                need[lengths[-1]] += 1
                room -= lengths[-1]
            while len(there := np.flatnonzero(self.left[: room + 1] > need[: room + 1])):
                lengths.append(int(there[-1]))
                need[lengths[-1]] += 1
                room -= lengths[-1]
            used = np.flatnonzero(need)
            run = min(times, int((self.left[used] // need[used]).min()))
            self.left[used] -= need[used] * run
            self.groups.append([lengths, run])
            times -= run

    def _fill(self) -> None:
        free: dict[int, list[int]] = {}
        for g, (lengths, _) in enumerate(self.groups):
            free.setdefault(self.capacity - sum(lengths), []).append(g)
        for x in map(int, np.flatnonzero(self.left)[::-1]):
            room = x
            while self.left[x]:
                while room <= self.capacity and not free.get(room):
                    room += 1
                fit = min(room, self.capacity) // x
                if room > self.capacity:
                    full, rest = divmod(int(self.left[x]), fit)
                    for k, n in ((fit, full), (rest, 1)):
                        if k and n:
                            free.setdefault(self.capacity - k * x, []).append(len(self.groups))
                            self.groups.append([[x] * k, n])
                    self.left[x] = 0
                    break
                g = free[room].pop()
                lengths, n = self.groups[g]
                full, rest = divmod(int(self.left[x]), fit)
                whole = min(n, full)
                parts = [(fit, whole), (rest, int(whole < n and rest > 0))]
                parts.append((0, n - sum(m for _, m in parts)))
                self.left[x] -= sum(k * m for k, m in parts)
                where = g
                for k, m in parts:
                    if m:
                        if where == len(self.groups):
                            self.groups.append(None)
                        self.groups[where] = [lengths + [x] * k, m]
                        free.setdefault(room - k * x, []).append(where)
                        where = len(self.groups)
                room = x

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.groups)

    def layout(self) -> dict[str, np.ndarray]:
        """For each length, which ranks go to which group: length, first rank, copies in a sequence, its first sequence, offset."""
        next_rank, rows, sequence = np.zeros(self.capacity + 1, np.int64), [], 0
        for lengths, n in self.groups:
            offset = 0
            for x in sorted(set(lengths), reverse=True):
                k = lengths.count(x)
                rows.append((x, next_rank[x], k, sequence, offset))
                next_rank[x] += k * n
                offset += k * x
            sequence += n
        rows.sort()
        return dict(zip(("length", "rank", "copies", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32, and the ids if asked for.

    Only longer documents are cut; their first piece is the shorter one. Null text is empty: the end id alone.
    """
    small_batches(docs.sparkSession, 600)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for f in frames:
            rows = []
            for d, z, ids in zip(f["doc_id"], f["none"], encoder.documents(f["text"]), strict=True):
                starts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    part = np.ascontiguousarray(ids[a:b], "<u4")
                    rows.append((None if z else d, k, a, b - a, zlib.crc32(part), *([part.tobytes()] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint").alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    return rows.mapInPandas(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def ranked(rows: DataFrame, counts: np.ndarray, most: int = 64 << 20) -> DataFrame:
    """rows with ``rank``: gapless from 0 among pieces of one length. counts: how many there are of each length.

    A length may hold most rows, so it is cut into salts of about ``most`` bytes, whose counts give first ranks: a row of
    a few bytes for each length and each ``most`` bytes of pieces is broadcast.
    """
    each = 64 + 4 * np.arange(len(counts)) * ("ids" in rows.columns)
    few = np.minimum(16, 1 + counts // 256)  # a length that many pieces share never waits for one task
    salts = F.lit(np.maximum(few, 1 + counts * each // most).tolist())
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), salts[F.col("length").cast("int")]))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("length", "__salt").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    return rows.join(F.broadcast(first), ["length", "__salt"]).withColumn("rank", F.col("__first") + F.row_number().over(inside) - 1).drop("__salt", "__first")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, with_ids: bool = False, small: int = 512, most_classes: int = 48) -> DataFrame:
    """One row per piece: pieces() with sequence_id and offset; the places in a sequence are gapless.

    Repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, capacity, tokenizer, with_ids))
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # capacity rows at most
        counts[r["length"]] = r["count"]
    layout = spark.sparkContext.broadcast(Plan(counts, capacity, small, most_classes).layout())

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = layout.value
        key = (t["length"] << 48) + t["rank"]  # in ascending order
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            nth, copy = np.divmod(rank - t["rank"][at], t["copies"][at])
            yield f.assign(sequence_id=t["sequence"][at] + nth, offset=t["offset"][at] + copy * length).drop(columns="rank")

    ranks = ranked(rows, counts)
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return ranks.select(*rows.columns, "rank").mapInPandas(place, f"{schema}, sequence_id bigint, offset bigint")
