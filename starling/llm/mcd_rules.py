"""Quality rules: text statistics, and robust multivariate outliers among them.

Each language and source (or, where one has few rows, all of its language, or the whole table) has a
minimum-covariance-determinant estimate of the transformed statistic vector: from two
deterministic starts (mean and covariance; medians and interquartile ranges), concentration steps alternate between
Mahalanobis distances and the mean and covariance of the ``share`` nearest rows until no determinant shrinks, and the
start whose covariance ends with the smaller determinant stands. A document is rejected beyond a chi-squared cut of its
squared distance.

Everything is DataFrame expressions. Statistics are fixed-point integers, so sums don't depend on the order of rows.
A step is one aggregate: counts and moments by bin of the distance (32 bins to a factor of two). The nearest share of a
group's rows is that of its nearest bins, the last one whole, so no group is ever gathered or sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, scratch, stored, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Transformed statistics, and how far apart their values must be to mean anything (a floor of the standard deviation).
STATISTICS = ("x0", "x1", "x2", "x3", "x4")
FLOORS = (0.15, 0.5, 0.1, 0.1, 0.35)
ONE = 1024  # fixed-point unit
#: Statistics are held to this many units, so that sums of products of 2**34 rows fit 64 bits.
LIMIT = 16 * ONE - 1
#: Quantiles of the chi-squared distribution with five degrees of freedom at 0.75 and 0.9999 (fixed values).
CHI_75, CHI_9999 = 6.6257, 25.7448
_P = len(STATISTICS)


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows (with ``w``, an array of words) with n_repeat_words: words in windows of eight that a text has twice or more,
    the first included. Every word is hashed once; three doublings make the windows' hashes."""
    rows = rows.withColumn("__h", F.transform("w", lambda x: F.xxhash64(x)))
    for step in (1, 2, 4):
        rows = rows.withColumn("__h", F.zip_with("__h", F.slice("__h", step + 1, F.greatest(F.size("__h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("__h", F.slice("__h", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))))
    tail = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    rows = rows.withColumn("__h", F.when(some, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.filter(F.zip_with("__h", tail("__h"), lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["h"] == b["h"]).alias("same"))), lambda p: p["same"])
    rows = rows.withColumn("__h", pairs)
    rows = rows.withColumn("__h", F.sort_array(F.array_distinct(F.flatten(F.transform("__h", lambda p: F.array(p["i"], p["j"]))))))
    covered = F.zip_with("__h", tail("__h"), lambda a, b: F.coalesce(F.least(F.lit(WINDOW), b - a), F.lit(WINDOW)))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("bigint")).drop("__h")


def statistics(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, x0 … x4)."""
    text = F.coalesce("text", F.lit(""))
    less = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    rows = with_repeats(rows.select(
        "doc_id", "lang", "source", "w",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        less(F.col("text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        less(F.col("text"), r"\p{Lu}").cast("bigint").alias("n_upper"),
        lines.alias("lines"),
    )).drop("w")
    rows = rows.withColumn("n_lines", F.size("lines").cast("bigint")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")).drop("lines")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    part = lambda a, b, few: F.log1p(100 * F.col(a) / (F.col(b) + few))
    x = (
        F.log((F.col("word_chars") + 100) / (F.col("n_words") + 20)),
        part("n_symbols", "n_words", 20), F.col("n_dup_lines") / (F.col("n_lines") + 5), F.col("n_repeat_words") / (F.col("n_words") + 20), part("n_upper", "word_chars", 100),
    )
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *[F.greatest(F.least(F.round(e * ONE).cast("bigint"), F.lit(LIMIT)), F.lit(-LIMIT)).alias(n) for n, e in zip(STATISTICS, x, strict=True)])


def grouped(rows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """How many groups there may be, and rows with ``g``, whose estimate judges them: language and source, or all of the language where the source has fewer
    than least rows to learn from, or all rows where the language has fewer. ``into`` has the groups that learn from a row.
    Null languages and sources are values like others."""
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    rows = rows.withColumn("__own", name("lang", "source")).withColumn("__all", name("lang"))
    good = F.sum((~F.col("base_failed")).cast("bigint"))
    own = stored(rows.groupBy("__own", "__all").agg(good.alias("n")))
    n = 2 * own.count() + 1
    all_ = own.groupBy("__all").agg(F.sum("n").alias("m"))
    names = small(own.join(all_, "__all").select("__own", "__all", F.when(F.col("n") >= least, F.col("__own")).when(F.col("m") >= least, F.col("__all")).otherwise("{}").alias("g")), n)
    levels = names.select("__own", F.explode(F.array("__own", "__all", F.lit("{}"))).alias("g"))
    into = levels.join(names.select("g").distinct(), "g", "left_semi").groupBy("__own").agg(F.collect_list("g").alias("into"))
    return rows.join(small(names.join(into, "__own").select("__own", "g", "into"), n), "__own").drop("__own", "__all"), n


#: Where row i of a lower triangle begins.
_LOWER = [(i, j) for i in range(_P) for j in range(i + 1)]


def swept(sums: DataFrame, *others: str) -> DataFrame:
    """Of sums by group and start (n, s_i, s_ij in fixed point): ``mean``, ``inverse`` (lower triangle) and log_det of the
    covariance, whose variances are FLOORS squared at least. The sweep operator on each pivot in turn inverts it."""
    mean = F.array(*[F.col(f"s{i}") / F.col("n") / ONE for i in range(_P)])
    at = lambda i, j: F.col(f"s{max(i, j)}{min(i, j)}") / F.col("n") / ONE**2 - F.col("mean")[i] * F.col("mean")[j]
    cell = lambda i, j: F.greatest(at(i, i), F.lit(FLOORS[i] ** 2)) if i == j else at(i, j)
    rows = stored(sums).withColumn("mean", mean).withColumn("a", F.array(*[F.array(*[cell(i, j) for j in range(_P)]) for i in range(_P)])).withColumn("log_det", F.lit(0.0))
    sequence = F.sequence(F.lit(0), F.lit(_P - 1))
    for k in range(_P):
        pivot = F.greatest(F.col("a")[k][k], F.lit(FLOORS[k] ** 2 / 16))
        rows = rows.withColumn("pivot", pivot).withColumn("log_det", F.col("log_det") + F.log("pivot"))

        def cell_of(i: Column, j: Column, k: int = k) -> Column:
            a, p = F.col("a"), F.col("pivot")
            both = F.when((i == k) & (j == k), F.lit(-1.0) / p)
            return both.when((i == k) | (j == k), a[i][j] / p).otherwise(a[i][j] - a[i][k] * a[k][j] / p)

        rows = rows.withColumn("a", F.transform(sequence, lambda i: F.transform(sequence, lambda j: cell_of(i, j))))
    return rows.select("g", "start", *others, "mean", F.array(*[-F.col("a")[i][j] for i, j in _LOWER]).alias("inverse"), "log_det")


def squared_distance() -> Column:
    """Of statistics from ``mean`` under ``inverse``."""
    x = [F.col(s) / ONE - F.col("mean")[i] for i, s in enumerate(STATISTICS)]
    terms = [F.col("inverse")[k] * x[i] * x[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_LOWER)]
    return F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0))


#: A squared distance's bin: 32 to a factor of two.
_BIN = 32


def bin_of(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 2.0**-20) * _BIN).cast("int")


SUMS = ["n", *[f"s{i}" for i in range(_P)], *[f"s{i}{j}" for i, j in _LOWER]]


def moments() -> list[Column]:
    product = lambda i, j: F.col(STATISTICS[i]) * F.col(STATISTICS[j])
    return [F.count("*").alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)], *[F.sum(product(i, j)).alias(f"s{i}{j}") for i, j in _LOWER]]


def starts(learn: DataFrame) -> DataFrame:
    """Start 0: mean and covariance. Start 1: medians and interquartile ranges, from histograms of 1/64 units."""
    plain = swept(learn.withColumn("start", F.lit(0)).groupBy("g", "start").agg(*moments()))
    fine = ONE // 64
    long = learn.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(s) / fine).cast("bigint").alias("bin")) for i, s in enumerate(STATISTICS)])).alias("x")).groupBy("g", "x.i", "x.bin").agg(F.count("*").alias("n"))
    order, all_ = Window.partitionBy("g", "i").orderBy("bin"), Window.partitionBy("g", "i")
    long = long.withColumn("sum", F.sum("n").over(order)).withColumn("all", F.sum("n").over(all_))
    at = lambda q: F.min(F.when(F.col("sum") >= F.col("all") * q, F.col("bin"))) * fine / ONE
    quantiles = long.groupBy("g", "i").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    s = [F.greatest(pick("s", i), F.lit(FLOORS[i])) for i in range(_P)]
    robust = quantiles.groupBy("g").agg(
        F.lit(1).alias("start"), F.array(*[pick("m", i) for i in range(_P)]).alias("mean"),
        F.array(*[F.lit(1.0) / (s[i] * s[i]) if i == j else F.lit(0.0) for i, j in _LOWER]).alias("inverse"),
        F.lit(0.0).alias("log_det"),
    )
    return plain.unionByName(robust).withColumn("log_det", F.lit(float("inf")))  # of no subset yet


def small(groups: DataFrame, n: int) -> DataFrame:
    """A row or two for each of at most n groups, stored in files of 50,000: Spark sees the true size and broadcasts it
    below its own bound, so that no hot group of documents is shuffled to meet its single row."""
    return stored(groups.repartition(1 + n // 50_000))


def step(learn: DataFrame, state: DataFrame, share: float, n: int) -> DataFrame:
    """A concentration step: of each group and start, ``near``, the bin up to which the nearest share of its rows lie by
    state's distances, the state (``old``), and the estimate from the rows up to there."""
    bins = learn.join(state, "g").withColumn("bin", bin_of(squared_distance())).groupBy("g", "start", "bin").agg(*moments())
    so_far = Window.partitionBy("g", "start").orderBy("bin")
    all_ = Window.partitionBy("g", "start")
    bins = bins.withColumn("before", F.sum("n").over(so_far) - F.col("n")).withColumn("all", F.sum("n").over(all_))
    nearest = bins.where(F.col("before") < F.ceil(F.col("all") * share)).groupBy("g", "start").agg(F.max("bin").alias("near"), *[F.sum(c).alias(c) for c in SUMS])
    new = swept(nearest, "near")
    return small(new.join(state.select("g", "start", F.struct("mean", "inverse", "log_det").alias("old")), ["g", "start"]), n)


def estimates(learn: DataFrame, share: float, steps: int, n: int) -> DataFrame:
    """One row per group: its estimate and ``scale``, by which its squared distances are divided."""
    state = small(starts(learn), n)
    for _ in range(steps):
        new = step(learn, state, share, n)
        state = new.drop("near", "old")
        if not new.where("log_det < old.log_det - 1e-3").take(1):
            break
    best = Window.partitionBy("g").orderBy("old.log_det", "start")
    found = new.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    # the nearest rows alone look too much alike: bring their farthest to where a normal law has it
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("near") + 1) / _BIN) / CHI_75)
    return small(found.select("g", "old.mean", "old.inverse", scale.alias("scale")), n)


def judge(docs: DataFrame, share: float = 0.75, steps: int = 12, least: int = 100, cut: float = CHI_9999) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, kept, and distance (scaled squared Mahalanobis).

    Documents that fail the base rules are neither learnt from nor kept. Sources with fewer than ``least`` rows are judged
    by an estimate over all rows of their language, languages with fewer by one over all rows, however few: every
    document that passes the base rules has a distance. Null and empty texts have no words and fail.
    ``steps`` bounds the concentration steps, which end when no group's determinant shrinks any more.
    Repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        rows, n = grouped(stored(statistics(docs)), least)
        rows = keep(rows)
        learn = rows.where("NOT base_failed").select(F.explode("into").alias("g"), *STATISTICS)
        found = keep(estimates(learn, share, steps, n).repartition(1 + n // 50_000))
    rows = rows.join(found, "g", "left").withColumn("distance", squared_distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def keep_good(docs: DataFrame, **options: float) -> DataFrame:
    """docs without those that judge() rejects; all columns stay. Rows are told apart by doc_id and text."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text")).alias("doc_id"), "text", "lang", "source")
    bad = judge(keyed, **options).where("NOT kept").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.struct("doc_id", F.xxhash64("text")) == F.col("__bad"), "left_anti").select(*docs.columns)
