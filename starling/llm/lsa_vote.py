"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text is a bag of hashed terms: its words without edge punctuation, their shapes (case, digits, marks around them)
and how much of it repeats the word before. Terms weigh log(1 + count) times inverse document frequency, counted
over all documents. A truncated SVD of at most ``most`` labelled rows (a documented bound; the rows whose doc_id
hashes lowest) gives the latent space. Their vectors, a few MB, are broadcast; every document meets all of them in
blocked cosine products, and its ``neighbours`` nearest vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, summed_counts

#: Shares of words that repeat the word before; each that a text passes is a term with a count of its own.
REPEATS, REPEAT_COUNT = (0.08, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75), 100
#: Hashed terms: words below, shapes above, then the repeats.
WORDS, SHAPES = 1 << 16, 1016
TERMS = WORDS + SHAPES + len(REPEATS)
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def shape(word: bytes) -> bytes:
    """Case and kind of a word's core, and the marks before and after it (three at most)."""
    core = word.strip(EDGES)
    at = word.find(core) if core else len(word)
    if not core:
        kind = b"-"
    elif core.isupper() and len(core) > 1:
        kind = b"A"
    elif core.isdigit():
        kind = b"0"
    elif any(48 <= c <= 57 for c in core):
        kind = b"x0"
    elif core[:1].isupper():
        kind = b"Aa"
    else:
        kind = b"a"
    return word[:at][:3] + kind + word[at + len(core) :][:3]


class Terms(dict):
    """A word's term and its shape's, as one number: remembered up to a bound."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(EDGES).lower() or word
        code = zlib.crc32(plain) % WORDS * TERMS + WORDS + zlib.crc32(shape(word)) % SHAPES
        if len(self) < self.most:
            self[word] = code
        return code

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text, ascending, and their counts."""
        words = text.encode().split() if text else []
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        found, counts = np.unique(np.concatenate(np.divmod(codes, TERMS)), return_counts=True)
        again = (codes[1:] == codes[:-1]).sum() / (len(codes) + 10)  # a short text's single repeat means little
        passed = np.flatnonzero(again > np.array(REPEATS))
        return np.concatenate([found, WORDS + SHAPES + passed]), np.concatenate([counts, np.full(len(passed), REPEAT_COUNT)])


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""

    def add(total: np.ndarray) -> Callable[[pd.DataFrame], None]:
        terms = Terms()

        def take(f: pd.DataFrame) -> None:
            for text in f["text"]:
                total[terms.of(text)[0]] += 1
            total[-1] += len(f)

        return take

    total = summed_counts(docs.select("text"), 1 << (TERMS.bit_length()), add)
    return total[:TERMS], int(total[-1])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    n = np.sqrt((x * x).sum())
    return x / n if n > 0 else x


def latent(bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, size: int, rounds: int = 3) -> np.ndarray:
    """The first right singular vectors of the weighted term matrix, by subspace iteration from a fixed start.

    The matrix is sparse: its entries by row, and again by term.
    """
    n = np.array([len(t) for t, _ in bags])
    term = np.concatenate([t for t, _ in bags])
    value = np.concatenate([weigh(c, idf[t]) for t, c in bags]).astype(np.float32)
    row = np.repeat(np.arange(len(bags)), n)
    by_term = np.argsort(term, kind="stable")
    known, first = np.unique(term[by_term], return_index=True)
    row_first = np.cumsum(n) - n
    full = n > 0

    def times(basis: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bags), basis.shape[1]), np.float32)
        for c in range(0, basis.shape[1], 16):  # a few columns at a time bound the memory
            out[full, c : c + 16] = np.add.reduceat(value[:, None] * basis[term, c : c + 16], row_first[full])
        return out

    def back(y: np.ndarray) -> np.ndarray:
        out = np.zeros((TERMS, y.shape[1]), np.float32)
        for c in range(0, y.shape[1], 16):
            out[known, c : c + 16] = np.add.reduceat(value[by_term, None] * y[row[by_term], c : c + 16], first)
        return out

    basis = np.random.default_rng(0).standard_normal((TERMS, size + 16)).astype(np.float32)
    if not len(term):
        return np.zeros((TERMS, size), np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(back(times(basis)))[0].astype(np.float32)
    _, _, turn = np.linalg.svd(times(basis), full_matrices=False)
    out = np.zeros((TERMS, size), np.float32)
    found = (basis @ turn.T)[:, :size]
    out[:, : found.shape[1]] = found
    return out


class Voter:
    """Labelled vectors, ready to score texts."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int) -> None:
        self.idf, self.basis, self.vectors, self.labels, self.neighbours = idf, basis, vectors, labels, neighbours

    def embed(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(bags), self.basis.shape[1]), np.float32)
        for row, (t, c) in zip(out, bags, strict=True):
            row[:] = weigh(c, self.idf[t]) @ self.basis[t]
        return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)

    def score(self, bags: list[tuple[np.ndarray, np.ndarray]], block: int = 512) -> np.ndarray:
        """Weighted share of label 1 among the nearest; a text like none (or empty) gets the labels' mean."""
        mean, out = float(self.labels.mean()) if len(self.labels) else 0.5, []
        for a in range(0, len(bags), block):
            part = self.embed(bags[a : a + block])
            if not len(self.labels):
                out.append(np.full(len(part), mean))
                continue
            near = part @ self.vectors.T
            k = min(self.neighbours, near.shape[1])
            top = np.argpartition(near, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, top, 1).astype(np.float64), 0)
            out.append(((weight * self.labels[top]).sum(1) + 1e-6 * mean) / (weight.sum(1) + 1e-6))
        return np.clip(np.concatenate(out), 0, 1) if out else np.empty(0)


def held_out(doc_id: str) -> str:
    return f"pmod(crc32(cast(cast({doc_id} AS string) AS binary)), 3) = 1"


def fit(docs: DataFrame, labels: DataFrame, most: int = 4096, size: int = 64, neighbours: int = 25) -> Voter:
    """Learns from at most ``most`` labelled rows that aren't held out; several labels of a document count as their mean."""
    small_batches(docs.sparkSession)
    seen, n = document_counts(docs)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32)
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(f"NOT ({held_out('doc_id')})").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(rows), "doc_id")

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for f in frames:
            found = [terms.of(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "quality": f["quality"], "terms": [t.astype(np.int32).tobytes() for t, _ in found], "counts": [c.astype(np.int32).tobytes() for _, c in found]})

    learnt = sample.mapInPandas(bags, "doc_id bigint, quality double, terms binary, counts binary").orderBy("doc_id", "terms", "counts").limit(most).collect()  # most rows, a few kB each
    own = [(np.frombuffer(r["terms"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in learnt]
    y = np.array([r["quality"] for r in learnt])
    basis = latent(own, idf, size) if own else np.zeros((TERMS, size), np.float32)
    voter = Voter(idf, basis, np.empty((0, size), np.float32), y, neighbours)
    voter.vectors = voter.embed(own)
    return voter


def score(docs: DataFrame, voter: Voter) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Nothing but the text is scored.

    Null and empty texts get the mean label; repeated rows are scored each; a null doc_id isn't held out.
    """
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(voter)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": given.value.score([terms.of(t) for t in f["text"]])})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.expr(held_out("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
