"""Token-ID shards compressed by a Re-Pair grammar, with random access.

Documents are dealt into ranges of ascending doc_id; each task encodes its range and cuts it into shards of about
``shard_tokens`` tokens (a document is never split). In a shard, frequent pairs of neighbouring symbols are replaced
by nonterminals, round after round, until none occurs twice. A round takes many pairs at once, the most frequent first,
such that no symbol is the left part of one and the right part of another: then no two replaced pairs overlap, and the
round equals replacing them one by one. A run of one symbol is replaced two by two from its start. No pair crosses the
end of a document, so every document is a run of whole symbols.

A shard is one binary image (row of a Parquet table, so that Spark's committer makes the write atomic and a lost
executor's task is simply run again). Little-endian: ``RPG2``, crc32 of all that follows, then the count of tokens (u64)
and those of documents, rules and symbols, the first nonterminal, the bits of a symbol and the bytes of an expansion
length (u32 each); doc_ids (i64), null flags (u8), tokens and symbols of each document (u32); expansion lengths; then,
each packed in as many bits as a symbol needs, the rules' two sides and the symbols.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, spread
from .tokens import shared

_HEAD = struct.Struct("<QIIIIII")
_MAGIC = b"RPG2"
#: Symbols are moved together as long as a round replaces one of so many.
SHARE = 50


def _chosen(left: list[int], right: list[int], most: int) -> list[int]:
    """Which pairs, in the order given, can be replaced together."""
    sides = bytearray(max(max(left), max(right)) + 1)  # 1: on the left of one, 2: on the right, 3: both of a pair of equals
    out = []
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        x = sides[a]
        if a == b:
            if not x:
                sides[a] = 3
                out.append(k)
        elif x < 2 and not sides[b] & 1:
            sides[a], sides[b] = 1, 2
            out.append(k)
    return out[:most]


def _codes(a: np.ndarray, b: np.ndarray, out: np.ndarray, turn: int, exact: bool, bits: int = 18) -> tuple[np.ndarray, int]:
    """A code below n for each pair, and n; pairs marked in ``out`` have n. Unless exact, pairs may share a code, others in each turn."""
    if not exact:
        odd = np.uint32((0x9E3779B1 * (2 * turn + 1)) & 0xFFFFFFFF)
        h = ((a * odd) ^ (b * np.uint32(0x85EBCA77))) >> np.uint32(32 - bits)
        h = h.astype(np.int64)
        h[out] = 1 << bits
        return h, 1 << bits
    keys, of = np.unique(a[~out].astype(np.uint64) << np.uint64(32) | b[~out], return_inverse=True)
    h = np.full(len(a), len(keys), np.int64)
    h[~out] = of
    return h, len(keys)


def _later(twins: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of places whose pair has equal sides, every other one from its run's start; follows says which go on from the one before."""
    begins = np.flatnonzero(np.append(True, ~follows))
    return twins[(np.arange(len(twins)) - np.repeat(begins, np.diff(begins, append=len(twins)))) % 2 == 1]


def _picked(h: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, totals: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """A round's pairs (k, 2), the places they stand at, and which of the pairs stands there; None if no code has a pair twice."""
    bar = max(2, int(totals.max()) // 30)  # the most frequent first
    while True:
        some = np.flatnonzero((totals >= bar)[h])
        hs, pair = h[some], a[some].astype(np.uint64) << np.uint64(32) | b[some]
        sample = np.zeros(n + 1, np.uint64)
        sample[hs] = pair  # one pair stands for its code; others of that code wait for a later round
        same = pair == sample[hs]
        some, hs = some[same], hs[same]
        counts = np.bincount(hs, minlength=n + 1)
        order = np.flatnonzero(counts >= bar)
        if len(order) or bar == 2:
            break
        bar = max(2, bar // 2)
    if not len(order):
        return None
    order = order[np.argsort(-counts[order], kind="stable")]
    one, two = (sample[order] >> np.uint64(32)).astype(np.uint32), sample[order].astype(np.uint32)
    take = _chosen(one.tolist(), two.tolist(), most)
    which = np.full(n + 1, -1, np.int64)
    which[order[take]] = np.arange(len(take))
    which = which[hs]
    taken = which >= 0
    return np.stack([one[take], two[take]], 1), some[taken], which[taken]


def compress(ids: np.ndarray, ends: np.ndarray, first: int, most: int = 1 << 30, hashed: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n, 2) and end marks. ends marks the last id of each document; nonterminals count from first.

    Rounds follow each other until no pair occurs twice or there are ``most`` rules; a round's pairs are at least a
    thirtieth as frequent as its first. While there are more than ``hashed`` symbols and a round replaces a good share of
    them, symbols are moved together after it. Then they are linked, not moved: a pair that occurs once never occurs again,
    as new pairs hold new symbols only, so a round looks at places whose pair occurred twice in the last one or is new.
    More than ``hashed`` of them are counted by hash as long as that finds any to replace, else exactly.
    """
    s, ends, rules, n_rules, exact, turn = ids.astype(np.uint32), ends.copy(), [], 0, False, 0
    while n_rules < most and len(s) > hashed:
        a, b, out, turn = s[:-1], s[1:], ends[:-1].copy(), turn + 1
        twins = np.flatnonzero((a == b) & ~out)
        if len(twins):
            out[_later(twins, twins[1:] == twins[:-1] + 1)] = True
        h, n = _codes(a, b, out, turn, False)
        totals = np.bincount(h, minlength=n + 1)
        totals[n] = 0
        found = _picked(h, n, a, b, totals, most - n_rules)
        if found is None:
            break
        pairs, spot, which = found
        s[spot] = first + n_rules + which
        ends[spot] = ends[spot + 1]
        stays = np.ones(len(s), bool)
        stays[spot + 1] = False
        s, ends = s[stays], ends[stays]
        rules.append(pairs)
        n_rules += len(pairs)
        if len(spot) * SHARE < len(s):
            break

    size = len(s)
    s = np.append(s, np.uint32(0))
    right, left = np.arange(1, size + 2), np.arange(-1, size)
    right[:size][ends], left[:size][np.append(True, ends[:-1])[:size]] = size, size  # place size is nobody's
    active = np.append(right[:size] < size, False)
    while n_rules < most:
        at = np.flatnonzero(active)
        if not len(at):
            break
        a, b = s[at], s[right[at]]
        out = np.zeros(len(at), bool)
        twins = np.flatnonzero(a == b)  # runs: every other place from the run's start
        if len(twins):
            place = at[twins]
            out[_later(twins, right[place[:-1]] == place[1:])] = True
        exact, turn = exact or len(at) <= hashed, turn + 1
        h, n = _codes(a, b, out, turn, exact)
        totals = np.bincount(h, minlength=n + 1)
        totals[n] = 0
        found = _picked(h, n, a, b, totals, most - n_rules)
        if found is None:
            if exact:
                break
            exact = True
            continue
        pairs, replaced, which = found
        # places whose pair may occur twice stay; so does a run's other half
        mates = h.copy()
        if exact and len(twins):
            keys = s[at[twins]]
            known = {int(x): int(c) for x, c in zip(keys, h[twins], strict=True) if c < n}
            mates[twins] = [known[int(x)] for x in keys]
        elif len(twins):
            mates[twins] = _codes(a[twins], b[twins], np.zeros(len(twins), bool), turn, False)[0]
        active[at[totals[mates] < 2]] = False
        spot = at[replaced]
        s[spot] = first + n_rules + which
        rules.append(pairs)
        n_rules += len(pairs)
        eaten = right[spot]
        after = right[eaten]
        right[spot] = after
        left[after] = spot
        active[eaten] = False
        active[spot] = after < size
        active[left[spot]] = True
        active[size] = False
        s[eaten] = np.uint32(0xFFFFFFFF)
    there = np.flatnonzero(s[:size] != np.uint32(0xFFFFFFFF))
    return s[there], np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), right[there] == size


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """The expansion length of each symbol."""
    length, done = np.ones(first + len(rules), np.int64), 0
    latest = np.maximum.accumulate(rules.max(1)) if len(rules) else rules
    while done < len(rules):  # a block of rules that refer to earlier symbols only
        end = int(np.searchsorted(latest, first + done))
        length[first + done : first + end] = length[rules[done:end]].sum(1)
        done = end
    return length


class Grammar:
    """Expansions of all symbols of a shard, as one array with a start and a length for each symbol."""

    def __init__(self, rules: np.ndarray, first: int) -> None:
        n = len(rules)
        self.length = np.ones(first + n, np.int64)
        self.start = np.arange(first + n, dtype=np.int64)
        parts, size, done = [np.arange(first, dtype=np.uint32)], first, 0
        while done < n:  # a block of rules that refer to earlier symbols only
            bad = np.flatnonzero(rules[done:].max(1) >= first + done)
            end = done + (int(bad[0]) if len(bad) else n - done)
            self.text = np.concatenate(parts)
            block = rules[done:end]
            self.length[first + done : first + end] = each = self.length[block].sum(1)
            self.start[first + done : first + end] = size + np.cumsum(each) - each
            parts.append(self.expand(block.ravel()))
            size, done = size + len(parts[-1]), end
        self.text = np.concatenate(parts)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.text[np.repeat(self.start[symbols] - (ends - n), n) + np.arange(total)]


def squeeze(x: np.ndarray, bits: int) -> bytes:
    """Numbers in so many bits each, lowest first."""
    wide = np.unpackbits(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].ravel(), bitorder="little").tobytes()


def unsqueeze(packed: np.ndarray, bits: int, begin: int, end: int) -> np.ndarray:
    """Numbers begin … end - 1 of those in packed bytes; no others are looked at."""
    some = np.unpackbits(packed[begin * bits // 8 : (end * bits + 7) // 8], bitorder="little")
    some = some[begin * bits % 8 :][: (end - begin) * bits].reshape(-1, bits)
    wide = np.zeros((end - begin, 32), np.uint8)
    wide[:, :bits] = some
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def pack(doc_ids: list, docs: list[np.ndarray], vocabulary: int) -> bytes:
    """The image of a shard: docs are the ids of its documents, each with its end id."""
    ids = np.concatenate(docs).astype(np.uint32)
    tokens = np.array([len(x) for x in docs], np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(tokens, dtype=np.int64) - 1] = True
    symbols, rules, e = compress(ids, ends, vocabulary)
    length = lengths(rules, vocabulary)[vocabulary:]
    bits, wide = (vocabulary + len(rules)).bit_length(), 2 if length.max(initial=0) < 1 << 16 else 4
    per_doc = np.diff(np.flatnonzero(e), prepend=-1).astype(np.uint32)
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    body = _HEAD.pack(len(ids), len(docs), len(rules), len(symbols), vocabulary, bits, wide)
    body += np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + nulls.tobytes() + tokens.astype("<u4").tobytes() + per_doc.astype("<u4").tobytes()
    body += length.astype(f"<u{wide}").tobytes() + squeeze(rules.ravel(), bits) + squeeze(symbols, bits)
    return _MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Shard:
    """A shard's image opened for reading. The grammar is opened at once, symbols only where they are asked for."""

    def __init__(self, image: bytes) -> None:
        if image[:4] != _MAGIC or struct.unpack_from("<I", image, 4)[0] != zlib.crc32(memoryview(image)[8:]):
            raise ValueError("not a shard, or a damaged one")
        self.n_tokens, docs, rules, self.n_symbols, first, self.bits, wide = _HEAD.unpack_from(image, 8)
        at = 8 + _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(image, kind, n, at)
            at += x.nbytes
            return x

        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls, strict=True)]
        self.tokens, self.symbols_of = take("<u4", docs), take("<u4", docs)
        #: The index: where each document's tokens and symbols end.
        self.token_ends, self.symbol_ends = np.cumsum(self.tokens, dtype=np.int64), np.cumsum(self.symbols_of, dtype=np.int64)
        lengths = take(f"<u{wide}", rules)
        sides = unsqueeze(take("u1", (2 * rules * self.bits + 7) // 8), self.bits, 0, 2 * rules)
        self.grammar = Grammar(sides.reshape(-1, 2), first)
        if not np.array_equal(lengths, self.grammar.length[first:]):
            raise ValueError("expansion lengths don't fit the rules")
        self.packed = take("u1", (self.n_symbols * self.bits + 7) // 8)

    def symbols(self, begin: int, end: int) -> np.ndarray:
        return unsqueeze(self.packed, self.bits, begin, end)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids = self.grammar.expand(self.symbols(0, self.n_symbols))
        for d, n, end in zip(self.doc_ids, self.tokens, self.token_ends, strict=True):
            yield d, ids[end - n : end]

    def read(self, start: int, length: int) -> np.ndarray:
        """Tokens start … start + length - 1 of the shard. The index names the documents that hold them; only their
        symbols are unpacked and measured, and only those that hold the tokens are expanded."""
        stop = min(start + length, self.n_tokens)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.token_ends, start, "right"), np.searchsorted(self.token_ends, stop, "left")
        symbols = self.symbols(int(self.symbol_ends[a] - self.symbols_of[a]), int(self.symbol_ends[b]))
        base = int(self.token_ends[a]) - int(self.tokens[a])
        ends = base + np.cumsum(self.grammar.length[symbols])
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[lo - 1]) if lo else base
        return self.grammar.expand(symbols[lo:hi])[start - before : stop - before]


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = 1 << 20, vocabulary: int = 50_257) -> None:
    """Writes docs (doc_id, text) in ascending doc_id order as a table of shards (part, before, n_docs, n_tokens, image).

    before counts the part's tokens ahead of the shard, so that a reader needs the parts' sums only.

    Null doc_ids come first, equal ones by text; null text is empty; an empty table writes an empty one.
    """
    small_batches(docs.sparkSession, 600)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, before, ids, held, size = shared(tokenizer), TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "before": [before], "n_docs": [len(ids)], "n_tokens": [size], "image": [pack(ids, held, vocabulary)]})

        for f in frames:
            for d, z, found in zip(f["doc_id"], f["none"], encoder.documents(f["text"]), strict=True):
                ids.append(None if z else d)
                held.append(found)
                size += len(held[-1])
                if size >= shard_tokens:
                    yield out()
                    before, ids, held, size = before + size, [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint").alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    rows = rows.repartitionByRange(spread(docs), F.desc("none"), "doc_id").sortWithinPartitions(F.desc("none"), "doc_id", "text")
    rows.mapInPandas(encode, "part int, before bigint, n_docs bigint, n_tokens bigint, image binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Of a table of shards, one row per document: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    # one row for each task of the write: its number is a setting, not the data's
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    rows = shards.join(F.broadcast(parts), "part").select((F.col("part_start") + F.col("before")).alias("start"), "image")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start, image in zip(f["start"], f["image"], strict=True):
                shard = Shard(image)
                n = shard.tokens.astype(np.int64)
                crc = [zlib.crc32(np.ascontiguousarray(x, "<u4")) for _, x in shard.documents()]
                yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids, "Int64"), "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})

    return rows.mapInPandas(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
