"""Sharding by a hierarchical weighted hash tree: descend region, rack and shard levels by weighted draws.

Each child of a node draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name, and the
smallest draw wins, so a child gets rows in proportion to its weight. Weights of inner nodes are the sums of their
shards. Changing a weight changes one draw on each level of one root-to-leaf path only: rows move into or out of
that path's subtrees and nowhere else. ``Tree.of(n)`` hangs every shard above ``base`` into a region of its own, so
that growth by one shard takes rows only into the new one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """weights[region][rack][shard] = weight over 0; names are integers, shards are numbered globally."""

    weights: dict[int, dict[int, dict[int, float]]]

    @staticmethod
    def of(shards: int, base: int = 16, racks: int = 4, per_rack: int = 4, regions: int = 2) -> Tree:
        """Shards below base fill regions and racks in turn; each further one is a region of its own."""
        weights: dict[int, dict[int, dict[int, float]]] = {}
        per_region = racks // regions * per_rack
        for s in range(shards):
            region = s // per_region if s < base else base // per_region + s - base
            rack = s // per_rack if s < base else base // per_rack + s - base
            weights.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
        return Tree(weights)


def draw(key: Column, level: str, child: int, weight: float) -> Column:
    """A child's weighted draw for a key: exponential with the weight as rate. 52 bits of md5, so SQL can say the same."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{level}/{child}"))), 1, 13), 16, 10).cast("bigint")
    return -F.log((h.cast("double") + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def lowest(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the smallest draw; equal draws go to the lower number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*[F.struct(draw(key, level, c, w).alias("d"), F.lit(c).alias("c")) for c, w in sorted(weights.items())]))["c"]


def chain(on: Column, cases: dict[int, Column]) -> Column:
    out = None
    for value, then in sorted(cases.items()):
        out = F.when(on == value, then) if out is None else out.when(on == value, then)
    return out


def descend(df: DataFrame, key: Column, tree: Tree, out: str = "shard") -> DataFrame:
    """df with the shard that each row's key falls to. A null key is hashed as an empty string."""
    k = F.coalesce(key.cast("string"), F.lit(""))
    total = lambda racks: sum(sum(s.values()) for s in racks.values())
    region, rack = f"__{out}_region", f"__{out}_rack"
    df = df.withColumn(region, lowest(k, "region", {r: total(racks) for r, racks in tree.weights.items()}))
    df = df.withColumn(rack, chain(F.col(region), {r: lowest(k, "rack", {x: sum(s.values()) for x, s in racks.items()}) for r, racks in tree.weights.items()}))
    df = df.withColumn(out, chain(F.col(rack), {x: lowest(k, "shard", s) for racks in tree.weights.values() for x, s in racks.items()}))
    return df.drop(region, rack)


def slots(df: DataFrame, shard: str, order: str, ties: tuple[str, ...], pieces: int = 1024, least: int = 200_000) -> DataFrame:
    """df with ``slot``: gapless from 0 in each shard, by the numeric order column (nulls first), then the ties.

    The first tie is a 32-bit number. Rows equal in all of them are interchangeable, so a task run again numbers alike.
    Shards are few and may be huge, so each is cut at quantiles of the order column into pieces (as many as leave each
    ``least`` rows, ``pieces`` at most). A value that holds a piece or more of its own, like null, is cut by its first
    tie. Counts of (shard, piece) give each piece its first slot and rows are numbered inside a piece only. Where
    exactly the cuts lie changes nothing.
    """
    grid = [k / pieces for k in range(1, pieces)]
    cuts, n = df.agg(F.percentile_approx(order, grid, 10_000), F.count("*")).first()
    wide = max(1, pieces * least // max(n, 1))  # every so many quantiles is a cut
    cuts = (cuts or [])[wide - 1 :: wide]
    hot = sorted(x for x, k in Counter(cuts).items() if k > 1)
    part = F.shiftright(F.col(ties[0]), 26).cast("bigint")  # 64 of them
    above = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col(order))).cast("bigint") if cuts else F.lit(0).cast("bigint")
    piece = (above + 1) * 128
    if hot:
        piece = piece + F.when(F.col(order).isin(hot), 64 + part).otherwise(0)
    df = df.withColumn("__piece", F.when(F.col(order).isNull(), part).otherwise(piece))
    before = Window.partitionBy(shard).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy(shard, "__piece").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(shard, "__piece").orderBy(F.col(order).asc_nulls_first(), *ties)
    # shards * pieces rows, 65 for a hot value: bounded by parameters, whatever the input
    return df.join(F.broadcast(first), [shard, "__piece"]).withColumn("slot", F.col("__first") + F.row_number().over(inside) - 1).drop("__piece", "__first")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1 (null text: 1, crc32 of nothing). Repeated doc_ids fall to the same shard
    and get slots of their own; an empty table gives no rows; other columns are ignored.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    rows = descend(rows, F.col("doc_id"), Tree.of(shards, base=shards), "shard")
    rows = descend(rows, F.col("doc_id"), Tree.of(shards + 1, base=shards), "grown_shard")
    return slots(rows, "shard", "doc_id", ("text_crc32", "size")).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")
