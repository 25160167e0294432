"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of hashes of its word n-grams. All sets follow one order, rare n-grams first, by a count sketch
over the whole corpus (2**20 counters, whatever the input; the order decides cost, never the result). If two sets
are as similar as asked, their prefixes of n - ceil(t n) + l members share at least l of them. Every document picks
its own l: a longer prefix costs more postings, but each partner must share more of it before it is verified. The
estimate weighs both with the sketch. A pair must share the lesser l of the two, and as many more as the overlap
needs when all the rest behind the shorter prefix is taken as common.

Groups of near copies would make all pairs among them. So each n-gram first links its members to one leader, the
member with the fewest n-grams of its own; what that connects is one component, and then only members of different
components are paired, with the largest component of an n-gram on one side. Components are the same as with all pairs,
as a pair inside one component adds nothing to it. Exact copies of a set are one document throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordIds, bit_table, has_bit, mix, scratch, shingles, small_batches, stored, summed_counts
from ..operators.graph import components

SKETCH_BITS = 20
#: Bits of a token's hash that the bit table leaves out: the sketch looks at them.
SHIFT = 24


class Sets:
    """Shingle sets of texts, as sorted unique hashes."""

    def __init__(self, words: int) -> None:
        self.words, self.ids = words, WordIds()

    def of(self, text: str) -> np.ndarray:
        w = self.ids.of(text.encode().lower().split())
        if not len(w):
            return w
        return np.unique(shingles(w, min(self.words, len(w)), seed=min(self.words, len(w))))


def sketch(rows: DataFrame, words: int) -> np.ndarray:
    """How many documents have an n-gram, by the low bits of its hash: 4 MB, whatever the input."""
    size = 1 << SKETCH_BITS

    def add(total: np.ndarray) -> Callable[[pd.DataFrame], None]:
        sets = Sets(words)

        def take(f: pd.DataFrame) -> None:
            for text in f["text"]:
                total[(sets.of(text) & np.uint64(size - 1)).astype(np.int64)] += 1

        return take

    return np.minimum(summed_counts(rows.select("text"), size, add), 2**31 - 1).astype(np.int32)


def prefix(found: np.ndarray, counts: np.ndarray, load: float, num: int, den: int, most: int) -> tuple[int, np.ndarray]:
    """A set's l and its prefix for it, rare n-grams first."""
    n = len(found)
    base = n + (-num * n // den) + 1  # n - ceil(t n) + 1
    own = counts[(found & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.lexsort((found, own))[: base + most - 1]
    postings = np.cumsum(np.maximum(1.0, own[order] - load))
    l = np.arange(1, most + 1)  # noqa: E741
    scan = postings[np.minimum(base + l - 1, len(order)) - 1]
    cost = scan + scan / l * (1 + n / 64)  # candidates share l postings each; a check reads both sets
    cost[base + l - 1 > n] = np.inf
    best = int(np.argmin(cost)) if np.isfinite(cost).any() else 0
    return best + 1, found[order[: base + best]]


def needed(a: str, b: str, num: int, den: int) -> Column:
    """The least overlap of sizes a and b: ceil(t (a + b) / (1 + t))."""
    return F.expr(f"ceil({num} * ({a} + {b}) / {num + den}D)")


def verified(pairs: DataFrame, rows: DataFrame, words: int, num: int, den: int, bits: int = 26) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose whole sets are similar enough; the sets are made anew from the texts."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = stored(ids)
    table = rows.sparkSession.sparkContext.broadcast(bit_table(ids.select(F.xxhash64("doc_id").alias("h")), "h", bits))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(words)
        for f in frames:
            f = f[has_bit(table.value, f["h"].to_numpy())]
            yield pd.DataFrame({"doc_id": f["doc_id"], "members": [sets.of(t).tobytes() for t in f["text"]]})

    members = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInPandas(build, "doc_id bigint, members binary")
    members = stored(members.join(ids, "doc_id", "left_semi"))
    table.destroy()
    one, two = members.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), members.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for x, y in zip(f["x"], f["y"], strict=True):
                n = (len(x) + len(y)) // 8
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (n - common))
            yield f.loc[keep, ["a", "b"]]

    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInPandas(check, "a bigint, b bigint")


def similar_links(rows: DataFrame, words: int, num: int, den: int, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text): one row per row (doc_id, n_shingles, rep), and links (a, b) between reps.

    rep is the smallest doc_id with the same set. The links connect what all links would connect.
    """
    counts = sketch(rows, words)
    given = rows.sparkSession.sparkContext.broadcast((counts, float(counts.mean())))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(words)
        for f in frames:
            out = []
            for text in f["text"]:
                found = sets.of(text)
                if not len(found):
                    out.append((0, 0, 0, 0, None))
                    continue
                l, first = prefix(found, *given.value, num, den, most)  # noqa: E741
                key = np.array([mix(found).sum(), mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).view(np.int64)
                out.append((len(found), int(key[0]), int(key[1]), l, first.view(np.int64)))
            result = pd.DataFrame(out, columns=["n", "k1", "k2", "l", "prefix"])
            result.insert(0, "doc_id", f["doc_id"].array)
            yield result

    all_ = stored(rows.select("doc_id", "text").mapInPandas(features, "doc_id bigint, n bigint, k1 bigint, k2 bigint, l int, prefix array<bigint>"))
    given.destroy()
    # stored, like other aggregates that are joined back: a join of two plain shuffles can be split where one key is hot
    reps = stored(all_.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")))
    docs = all_.select("doc_id", "n", "k1", "k2").join(reps, ["n", "k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "rep")

    # most tokens are some document's own; a bit table of the others keeps them out of all that follows
    seen = all_.select(F.explode("prefix").alias("token")).groupBy("token").count().where("count > 1").select(F.shiftrightunsigned("token", SHIFT).alias("token"))
    table = rows.sparkSession.sparkContext.broadcast(bit_table(seen, "token", 26))

    def common(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = np.array([len(x) for x in f["prefix"]], np.int64)
            tokens = np.concatenate([np.empty(0, np.int64), *f["prefix"]]).astype(np.int64)
            own = has_bit(table.value, (tokens.view(np.uint64) >> np.uint64(SHIFT)).view(np.int64))
            at = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            row = np.repeat(np.arange(len(f)), size)[own]
            yield f.drop(columns="prefix").iloc[row].assign(p=size[row].astype(np.int32), at=at[own].astype(np.int32), token=tokens[own])

    found = all_.where("n > 0").mapInPandas(common, "doc_id bigint, n bigint, k1 bigint, k2 bigint, l int, p int, at int, token bigint")
    postings = stored(found.join(reps, ["n", "k1", "k2"]).where("doc_id = rep").select("rep", "n", "l", "p", "at", "token").dropDuplicates(["rep", "token"]))
    table.destroy()
    shared = stored(postings.groupBy("token").count().where("count > 1").select("token"))
    # tokens of a rep that others have too, in order; at most a prefix each. "at" counts in the prefix, "nth" among these
    own = postings.join(shared, "token").groupBy("rep", "n", "l", "p").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("tokens"))
    own = stored(own.withColumn("s", F.size("tokens")))
    postings = stored(own.select("rep", "n", "l", "p", "s", F.posexplode("tokens").alias("nth", "t")).select("rep", "n", "l", "p", "s", "nth", "t.at", "t.token"))

    need = needed("a.n", "b.n", num, den)
    least = F.greatest(F.least("a.l", "b.l").cast("double"), need - F.greatest(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")))
    sizes = (F.col("a.rep") != F.col("b.rep")) & (den * F.col("a.n") >= num * F.col("b.n")) & (den * F.col("b.n") >= num * F.col("a.n"))
    may = sizes & (F.least("a.s", "b.s") >= least)
    leader = postings.groupBy("token").agg(F.min(F.struct((F.col("p") - F.col("s")).alias("lone"), "rep", "n", "l", "p", "s")).alias("b")).select("token", "b.*")
    star = postings.alias("a").join(stored(leader).alias("b"), (F.col("a.token") == F.col("b.token")) & may)
    star = stored(star.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct())
    near = stored(verified(star, rows, words, num, den))

    part = components(near)
    postings = postings.join(part.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    postings = stored(postings)
    per = postings.groupBy("token", "component").agg(F.count("*").alias("m"))
    top = per.groupBy("token").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("top.component").alias("top"))
    split = stored(postings.join(stored(top), "token"))
    small = split.where("component <> top")
    apart = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.top")) | (F.col("a.rep") < F.col("b.rep")))
    # the first token that a pair shares leaves room for all that it needs, in the prefixes and in the sets
    room = (F.least(F.col("a.s") - F.col("a.nth"), F.col("b.s") - F.col("b.nth")) >= least) & (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= need)
    met = small.alias("a").join(split.alias("b"), (F.col("a.token") == F.col("b.token")) & apart & sizes & room)
    met = met.select(F.least("a.rep", "b.rep").alias("x"), F.greatest("a.rep", "b.rep").alias("y")).distinct()
    one, two = own.alias("a"), own.alias("b")
    met = met.join(one, F.col("x") == F.col("a.rep")).join(two, F.col("y") == F.col("b.rep"))
    met = met.where(F.size(F.array_intersect("a.tokens.token", "b.tokens.token")) >= least).select(F.col("x").alias("a"), F.col("y").alias("b"))
    rest = stored(met.join(star, ["a", "b"], "left_anti"))
    return docs, near.unionByName(verified(rest, rows, words, num, den))


def classes(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of rows (doc_id, text) without nulls: doc_id, n_shingles, component_id. Intermediate tables are deleted."""
    small_batches(rows.sparkSession)
    with scratch(rows.sparkSession) as keep:
        each, links = similar_links(rows, words, num, den)
        part = components(links).select(F.col("id").alias("rep"), "component")
        out = each.join(part, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        return keep(out)


def similar_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Two documents link when den * intersection >= num * union of their sets of n-grams of ``words`` words (the whole
    sequence where there are fewer). A-Z are lower-cased. Documents without words link with nothing. Rows that share a
    doc_id count as one document; null doc_ids link with nothing and have a null component; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).alias("text")
    out = classes(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text), words, num, den)

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(words)
        for f in frames:
            yield pd.DataFrame({"n_shingles": [len(sets.of(t)) for t in f["text"]]})

    unknown = F.lit(None).cast("bigint")
    none = docs.where("doc_id IS NULL").select(text).mapInPandas(sizes, "n_shingles bigint")
    return out.unionByName(none.select(unknown.alias("doc_id"), "n_shingles", unknown.alias("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each class of similar texts, that with the smallest doc_id; all columns stay.

    A row whose doc_id is null goes by a number made of its text, over all doc_ids' (so it stays only where no row with
    a doc_id is like it). Of rows with one doc_id and one text one stays; rows with one doc_id and different texts are
    one document and stay or go together. Texts without words are like nothing and stay, but for such exact repeats.
    """
    spark = docs.sparkSession
    key, text = F.coalesce(F.col("doc_id").cast("bigint"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)), F.xxhash64("text")
    keyed = docs.withColumns({"__key": key, "__text": text})
    with scratch(spark) as keep:
        part = classes(keyed.select(F.col("__key").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), words, num, den)
        gone = keep(part.where("doc_id <> component_id").select(F.col("doc_id").alias("__key")).distinct())
        again = keep(keyed.groupBy("__key", "__text").count().where("count > 1").select("__key", "__text"))
    left = keyed.join(gone, "__key", "left_anti")
    first = left.join(again, ["__key", "__text"], "left_semi").dropDuplicates(["__key", "__text"])
    return left.join(again, ["__key", "__text"], "left_anti").unionByName(first).select(*docs.columns)
