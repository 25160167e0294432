"""Substring dedup on a compacted de Bruijn graph of token k-mers.

The graph's edges are the windows of ``window`` words, its nodes the runs of ``window - 1`` words at their ends. An edge
is a pair of 64-bit node hashes, so edges are told apart by 128 bits; words themselves are not compared.

1. A window's minimizer is the least hashed run of k words in it; equal windows have equal minimizers wherever they
   stand. Minimizers that no second document has are in no repeated edge and drop out (first scan: one row per document
   and minimizer; a bit table of the repeated ones, of fixed size, goes to the second scan. Its false hits cost time
   and change nothing).
2. A maximal run of windows with one minimizer is a path inside a text. Equal paths (minimizer and a hash of the nodes,
   128 bits together) are one row, with the first document that has it; all later occurrences are repeats as a whole.
3. The different paths are taken apart into edges, each with the least document and place it starts at. Those of two
   documents or more are the graph.
4. A node with one edge in and one out, which follow each other in one source text, joins them. Edges so joined are one
   unitig: blocks of ``BLOCK`` places of a source are compacted by a running maximum, and blocks that go on from the
   block before by pointer-doubling joins, so that neither a long unitig nor a long text is ever gathered.
5. A path's own edges find their unitig by a join. What stays in step with a unitig's places in the source, without a
   gap, is a repeated span; its coordinates (row, first word, last word) go back to the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import released, scratch
from .common import WordIds, bit_table, has_bit, mix, small_batches, stored

_B = 0x9E3779B97F4A7C15


def runs(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes (modulo 2**64) of all runs of n ids, by doubling."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out, length, power, size = None, 0, ids, 1
    while n:
        if n & 1:
            last = len(ids) - (length + size) + 1
            out = power[:last] if out is None else out[:last] * np.uint64(pow(_B, size, 1 << 64)) + power[length : length + last]
            length += size
        n >>= 1
        if n:
            last = len(power) - size
            power = power[:last] * np.uint64(pow(_B, size, 1 << 64)) + power[size : size + last]
            size *= 2
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of all runs of n values, by doubling."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def minimizers(w: np.ndarray, window: int, k: int) -> np.ndarray:
    """The least hash of k words in each window."""
    return sliding_min(runs(w, k), window - k + 1) if len(w) >= window else np.empty(0, np.uint64)


def paths(w: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's runs of windows with one minimizer: minimizer, content hash, first window, windows; and the text's nodes."""
    least = minimizers(w, window, k)
    if not len(least):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    nodes = runs(w, window - 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[first, len(least)])
    place = (np.arange(len(least)) - np.repeat(first, count)).astype(np.uint64)
    edges = mix(nodes[:-1] * np.uint64(_B) + nodes[1:])
    content = np.add.reduceat(mix(edges + place * np.uint64(_B)), first) + count.astype(np.uint64)
    return least[first].view(np.int64), mix(content).view(np.int64), first, count, nodes.view(np.int64)


#: Places of a source that are compacted together.
BLOCK = 4096


def place(key: str | Column, at: str | Column) -> Column:
    """A place of a row: the word, and above it 31 bits of the row's key, as a doc_id may have several rows."""
    key, at = (F.col(x) if isinstance(x, str) else x for x in (key, at))
    return F.shiftleft(key.bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(at.cast("bigint"))


def unitigs(edges: DataFrame) -> DataFrame:
    """edges (left, right, source, place) with ``unitig``, the place where the unitig of each starts in its source."""
    with scratch(edges.sparkSession) as keep:
        edges = stored(edges)
        end = lambda node, into: edges.select(
            F.col(node).alias("node"), F.lit(into).alias("into"), F.lit(1 - into).alias("out"),
            *[F.when(F.lit(bool(x)), F.col(c)).alias(n) for x, n, c in ((into, "s1", "source"), (into, "p1", "place"), (1 - into, "s2", "source"), (1 - into, "p2", "place"))],
        )
        degrees = end("right", 1).unionByName(end("left", 0)).groupBy("node")
        degrees = degrees.agg(F.sum("into").alias("into"), F.sum("out").alias("out"), *[F.max(c).alias(c) for c in ("s1", "p1", "s2", "p2")])
        joined = degrees.where("into = 1 AND out = 1 AND s1 = s2 AND p2 = p1 + 1").select(F.col("s2").alias("source"), F.col("p2").alias("place"), F.lit(1).alias("joined"))

        rows = edges.withColumn("joined", F.lit(0)).unionByName(joined, allowMissingColumns=True).withColumn("block", F.expr(f"place div {BLOCK}"))
        order = Window.partitionBy("source", "block").orderBy("place", F.desc("joined"))
        goes_on = (F.lag("joined").over(order) == 1) & (F.lag("place").over(order) == F.col("place"))
        rows = rows.withColumn("start", F.when((F.col("joined") == 0) & ~F.coalesce(goes_on, F.lit(False)), F.col("place")))
        rows = keep(rows.withColumn("unitig", F.max("start").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("joined = 0").drop("start", "joined"))

    # what the last edge of each block belongs to: a unitig that starts in it, or whatever the block ``up`` ends in
    heads = stored(rows.groupBy("source", "block").agg(F.max("unitig").alias("unitig")).withColumn("up", F.col("block") - 1))
    while heads.where("unitig IS NULL").take(1):
        above = heads.select("source", F.col("block").alias("up"), F.col("unitig").alias("found"), F.col("up").alias("next"))
        more = heads.where("unitig IS NULL").join(above, ["source", "up"]).select("source", "block", F.col("found").alias("unitig"), F.col("next").alias("up"))
        heads = stored(heads.where("unitig IS NOT NULL").unionByName(more))
    before = heads.select("source", (F.col("block") + 1).alias("block"), F.col("unitig").alias("found"))
    late = rows.where("unitig IS NULL").drop("unitig").join(before, ["source", "block"]).withColumnRenamed("found", "unitig")
    return rows.where("unitig IS NOT NULL").unionByName(late).drop("block")


def repeats(docs: DataFrame, window: int = 50, k: int = 16, bits: int = 26) -> DataFrame:
    """Rows (doc_id, key, first, last, source, source_place): windows first … last of a row start in document source too,
    from source_place on, and source is the least document that has them.

    key is the hash of the row's text, as a doc_id may have rows of different texts. Null doc_ids have no repeats.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "text")

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for f in frames:
            found = [np.unique(minimizers(ids.of(t.encode().split()), window, k)).view(np.int64) for t in f["text"]]
            yield pd.DataFrame({"minimizer": np.concatenate(found), "doc_id": np.repeat(f["doc_id"].to_numpy(), [len(x) for x in found])})

    seen = rows.select("doc_id", "text").mapInPandas(least, "minimizer bigint, doc_id bigint")
    seen = seen.groupBy("minimizer").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minimizer")
    with released(spark):
        table = spark.sparkContext.broadcast(bit_table(seen, "minimizer", bits))

    def occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, bit = WordIds(), table.value
        for f in frames:
            out: list[tuple] = []
            for d, key, t in zip(f["doc_id"], f["key"], f["text"], strict=True):
                minimizer, content, first, count, nodes = paths(ids.of(t.encode().split()), window, k)
                for x in np.flatnonzero(has_bit(bit, minimizer)).tolist():
                    a, n = int(first[x]), int(count[x])
                    out.append((int(minimizer[x]), int(content[x]), d, key, a, n, nodes[a : a + n + 1].tobytes()))
            yield pd.DataFrame(out, columns=["minimizer", "content", "doc_id", "key", "first", "n", "nodes"])

    def edges_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            nodes, n = [np.frombuffer(x, np.int64) for x in f["nodes"]], f["n"].to_numpy()
            if len(n):
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(f["first"].to_numpy(), n)
                ends = {"left": np.concatenate([x[:-1] for x in nodes]), "right": np.concatenate([x[1:] for x in nodes])}
                yield pd.DataFrame({**ends, **{c: np.repeat(f[c].to_numpy(), n) for c in ("doc_id", "key", "last_doc")}, "at": at})

    with released(spark), scratch(spark) as keep:
        with scratch(spark) as keep_edges:
            paths_ = stored(rows.mapInPandas(occurrences, "minimizer bigint, content bigint, doc_id bigint, key bigint, first int, n int, nodes binary"))
            table.destroy()
            same = paths_.groupBy("minimizer", "content")
            by_content = stored(same.agg(F.min("doc_id").alias("source"), F.min_by(place("key", "first"), "doc_id").alias("source_place"), F.max("doc_id").alias("last_doc")))
            bare = paths_.select("minimizer", "content", "doc_id", "key", "first", "n").join(by_content, ["minimizer", "content"])
            whole = keep(bare.where("source < doc_id").select("doc_id", "key", "first", (F.col("first") + F.col("n") - 1).alias("last"), "source", "source_place"))
            firsts = paths_.join(by_content, ["minimizer", "content"]).where("source = doc_id").select("doc_id", "key", "last_doc", "first", "n", "nodes")
            single = keep_edges(firsts.mapInPandas(edges_of, "left bigint, right bigint, doc_id bigint, key bigint, last_doc bigint, at int"))
        edges = single.groupBy("left", "right").agg(F.min("doc_id").alias("source"), F.min_by(place("key", "at"), "doc_id").alias("place"), F.max("last_doc").alias("last_doc"))
        found = unitigs(edges.where("source < last_doc").drop("last_doc"))
        step = single.join(found, ["left", "right"]).where("source < doc_id").withColumn("apart", F.col("place") - F.col("at"))
        line = ["doc_id", "key", "source", "unitig", "apart"]
        step = step.withColumn("island", F.col("at") - F.dense_rank().over(Window.partitionBy(*line).orderBy("at")))
        spans = step.groupBy(*line, "island").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("place").alias("source_place"))
        spans = keep(spans.select("doc_id", "key", "first", "last", "source", "source_place"))
    return whole.unionByName(spans)


def strip_repeats(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and spans, the word ranges [start, end) taken out.

    Words covered by a window that a document with a smaller doc_id has too are removed; windows are judged on the
    input. Equal doc_ids are no sources for each other; null texts have no words; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    found = repeats(docs, window, k).groupBy("doc_id", "key").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("key")).join(found, ["doc_id", "key"], "left")

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, first, last in zip(f["text"], f["first"], f["last"], strict=True):
                w = text.encode().split() if text else []
                spans = []
                kept = w
                if first is not None:
                    depth = np.zeros(len(w) + 1, np.int64)
                    np.add.at(depth, np.asarray(first), 1)
                    np.add.at(depth, np.asarray(last) + window, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                    spans = [{"start": int(a), "end": int(b)} for a, b in edges]
                    kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
            result = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "spans"])
            result.insert(0, "doc_id", f["doc_id"].array)
            yield result

    done = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "first", "last").mapInPandas(keep, "doc_id string, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:int,end:int>>")
    return done.withColumn("doc_id", F.col("doc_id").cast("bigint"))
