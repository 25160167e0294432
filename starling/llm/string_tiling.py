"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and lose punctuation at their ends. Every run of ``seed`` words of a document is looked up among
those of the benchmark; the union of an item's seeds in a document bounds its tiling from above and spares most pairs.
In the others the longest match of unmarked words is marked (of equals the first in the item, then in the document),
and so on down to the seed length, so a word is covered once and passages count wherever and in whatever order they
stand. The longest length is found by bisection over Karp-Rabin hashes of all unmarked windows of both sides; windows
with equal hashes are compared word by word before they are marked. A pair is reported if the marked words are at
least ``threshold`` of the item's.

Memory is that of the two texts: equal places are never listed as pairs, however repetitive they are. The benchmark is
read in blocks of at most about ``block_words`` words. One block at a time is collected, broadcast, meets all documents,
and is destroyed when its rows are stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, scratch, small_batches, stored, words

#: Punctuation at a word's ends that doesn't count (fixed value).
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BASE = np.uint64(0xD6E8FEB86659FD93)


def plain(word: bytes) -> bytes:
    """A word lower-cased (A-Z) and without punctuation at its ends; a word of nothing else stands as it is."""
    return word.lower().strip(EDGES) or word


class Numbers(dict):
    """The number of a word in the block's vocabulary, or -1. Spellings are remembered up to a bound."""

    def __init__(self, vocabulary: dict[bytes, int], most: int = 500_000) -> None:
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = self.vocabulary.get(plain(word), -1)
        return n

    def of(self, text: bytes) -> np.ndarray:
        split = text.split()
        return np.fromiter(map(self.__getitem__, split), np.int64, len(split))


def prefixes(ids: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all beginnings of ids."""
    out = np.zeros(len(ids) + 1, np.uint64)
    with np.errstate(over="ignore"):
        # sum of ids[k] * BASE**-k would need inverses: powers ascend instead, and windows are brought to one power
        out[1:] = np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers(len(ids)))
    return out


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 … BASE**(n - 1) modulo 2**64, kept between calls."""
    global _powers
    while len(_powers) < n:
        top = np.uint64(pow(int(BASE), len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * top])
    return _powers[:n]


def windows(hashes: np.ndarray, n: int, total: int) -> np.ndarray:
    """Hashes of all windows of n ids of which prefixes() are known, brought to the power of total."""
    last = len(hashes) - n
    if last < 1:
        return np.empty(0, np.uint64)
    return mix((hashes[n:] - hashes[:last]) * powers(total + 1)[total - np.arange(last)])


class Pair:
    """An item and a document, as word numbers, while tiles are marked."""

    def __init__(self, item: np.ndarray, doc: np.ndarray) -> None:
        self.item, self.doc, self.total = item, doc, max(len(item), len(doc))
        self.free_item, self.free_doc = np.ones(len(item), bool), doc >= 0
        self.hashes = prefixes(item), prefixes(doc)

    @staticmethod
    def open(free: np.ndarray, n: int) -> np.ndarray:
        """Where windows of n free words begin."""
        busy = np.r_[0, np.cumsum(~free)]
        return np.flatnonzero(busy[n:] == busy[:-n]) if len(free) >= n else np.empty(0, np.int64)

    def common(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of free windows of n words that the other side may have too, and their hashes: of item and document."""
        i, j = self.open(self.free_item, n), self.open(self.free_doc, n)
        hi, hj = windows(self.hashes[0], n, self.total)[i], windows(self.hashes[1], n, self.total)[j]
        known = np.unique(hi)
        at = np.minimum(np.searchsorted(known, hj), max(len(known) - 1, 0))
        in_item = known[at] == hj if len(known) else np.zeros(len(hj), bool)
        j, hj = j[in_item], hj[in_item]
        both = np.isin(hi, hj)
        return i[both], hi[both], j, hj

    def longest(self, low: int, high: int) -> int:
        """The greatest length from low to high at which a window is common; low - 1 where there is none."""
        low, high = low - 1, min(high, len(self.item), len(self.doc))
        while low < high:
            n = (low + high + 1) // 2
            if len(self.common(n)[0]):
                low = n
            else:
                high = n - 1
        return low

    def mark(self, n: int) -> int:
        """Marks the common windows of n words, first in the item and then in the document first; how many."""
        i, hi, j, hj = self.common(n)
        order = np.argsort(hj, kind="stable")
        j, hj = j[order], hj[order]
        begin, end = np.searchsorted(hj, hi), np.searchsorted(hj, hi, "right")
        seen: dict[int, int] = {}
        tiles = 0
        for a, x, to in zip(i.tolist(), begin.tolist(), end.tolist(), strict=True):
            if not self.free_item[a : a + n].all():
                continue
            at = seen.get(x, x)
            while at < to:
                b = int(j[at])
                if self.free_doc[b : b + n].all() and np.array_equal(self.item[a : a + n], self.doc[b : b + n]):
                    self.free_item[a : a + n] = self.free_doc[b : b + n] = False
                    tiles += 1
                    break
                at += 1
            seen[x] = at
        return tiles


def tile(item: np.ndarray, doc: np.ndarray, seed: int) -> tuple[int, int]:
    """Words of item marked by greedy string tiling, and the number of tiles. Words are numbers; doc has -1 for others."""
    pair, n, tiles = Pair(item, doc), len(item), 0
    while (n := pair.longest(seed, n)) >= seed:
        tiles += pair.mark(n)
        n -= 1
    return int((~pair.free_item).sum()), tiles


class Block:
    """Items of the benchmark, ready to meet documents: words as numbers, and for each seed the items and places that have it."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int, threshold: float) -> None:
        self.seed, self.threshold, self.vocabulary = seed, threshold, {}
        self.keys, self.items, found = [], [], {}
        for key, text in items:
            w = np.array([self.vocabulary.setdefault(plain(x), len(self.vocabulary)) for x in text.split()], np.int64)
            if len(w):
                n = min(seed, len(w))  # a shorter item is one seed
                found.setdefault(n, []).append(len(self.items))
                self.keys.append(key)
                self.items.append(w)
        self.seeds = {}
        for n, parts in found.items():
            h = np.concatenate([self.seeds_of(self.items[x], n) for x in parts])
            sizes = [len(self.items[x]) - n + 1 for x in parts]
            item = np.repeat(parts, sizes)
            place = np.concatenate([np.arange(s) for s in sizes])
            order = np.argsort(h, kind="stable")
            self.seeds[n] = h[order], item[order], place[order]

    @staticmethod
    def seeds_of(w: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n numbers, whatever stands around them."""
        last = len(w) - n + 1
        if last < 1:
            return np.empty(0, np.uint64)
        h = np.zeros(last, np.uint64)
        for k in range(n):
            h = h * BASE + w[k : k + last].astype(np.uint64) + np.uint64(1)
        return mix(h)

    def matches(self, text: bytes, numbers: Numbers, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, words of it, words covered, tiles) of the items that a text covers to the threshold; only one if first."""
        doc, out = numbers.of(text), []
        for n, (seeds, item, place) in self.seeds.items():
            h = self.seeds_of(doc, n)
            if not len(h):
                continue
            known = np.cumsum(np.r_[0, doc < 0])
            h = np.unique(h[known[n:] == known[:-n]])
            lo, hi = np.searchsorted(seeds, h), np.searchsorted(seeds, h, "right")
            lo, hi = lo[hi > lo], hi[hi > lo]
            if not len(lo):
                continue
            count = hi - lo
            at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            order = np.lexsort((place[at], item[at]))
            x, p = item[at][order], place[at][order]
            # words of an item that its seeds cover: each adds n, or less where the next one begins sooner
            step = np.minimum(np.r_[np.diff(p), n], n)
            last = np.r_[x[1:] != x[:-1], True]
            step[last] = n
            starts = np.r_[0, np.flatnonzero(last)[:-1] + 1]
            for k, cover in zip(x[starts].tolist(), np.add.reduceat(step, starts).tolist(), strict=True):
                own = self.items[k]
                need = self.threshold * len(own) - 1e-9
                if cover >= need:
                    covered, tiles = tile(own, doc, n)
                    if covered >= need and covered:
                        out.append((self.keys[k], len(own), covered, tiles))
                        if first:
                            return out
        return out


def blocks(benchmark: DataFrame, seed: int, threshold: float, block_words: int) -> Iterator[tuple[Block, bool]]:
    """The benchmark's blocks one after the other, and whether it is the last one. Rows without item_id or text are left out."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.size(words(F.col("text"))).cast("bigint"))).first()[0] or 0
    n = 1 + size // block_words
    for b in range(n):
        # about block_words words
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield Block([(r[0], r[1].encode()) for r in own], seed, threshold), b == n - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, item_id, item_words, covered_words, n_tiles), one per document row and item that it covers.

    Null or empty texts match nothing, and neither do items without words; rows with a null item_id are ignored.
    Repeated rows are reported each, repeated items (item_id and text) once. Documents are read once for each block of the benchmark.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text IS NOT NULL")
    schema, found = "doc_id string, item_id bigint, item_words int, covered_words int, n_tiles int", None
    for block, last in blocks(benchmark, seed, threshold, block_words):
        given = spark.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            numbers = Numbers(given.value.vocabulary)
            for f in frames:
                out = [(d, *m) for d, text in zip(f["doc_id"], f["text"], strict=True) for m in given.value.matches(text.encode(), numbers)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "item_words", "covered_words", "n_tiles"])

        part = rows.mapInPandas(run, schema)
        if not last:
            part = stored(part)
            given.destroy()
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "item_id", "item_words", "covered_words", "n_tiles")


def covering(given: Broadcast) -> Callable[[str], Column]:
    """Whether a text covers an item of the block."""

    @F.pandas_udf("boolean")
    def covers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers = Numbers(given.value.vocabulary)
        for texts in batches:
            yield pd.Series([bool(t) and bool(given.value.matches(t.encode(), numbers, first=True)) for t in texts], dtype=bool)

    return covers


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """docs without those that cover an item; all columns stay. A row's own text decides, so null and repeated ids don't matter.

    Only texts go to Python and nothing is shuffled; between blocks of the benchmark the rows left are stored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark) as keep:
        for block, last in blocks(benchmark, seed, threshold, block_words):
            given = spark.sparkContext.broadcast(block)
            docs = docs.where(~covering(given)("text"))
            if not last:
                docs = keep(docs)
                given.destroy()
    return docs
