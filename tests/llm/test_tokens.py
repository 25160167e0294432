"""Tokens, the grammar's files, and packing."""

import os
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starling.llm import token_grammar
from starling.llm.config_packing import Plan, best_configuration, pack_documents
from starling.llm.token_grammar import Grammar, Shard, compress, pack, read_shards, write_shards
from starling.llm.tokens import Encoder, public, shared


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public())


@pytest.fixture(scope="module")
def encoder():
    return Encoder(most=200)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


CASES = ["", " ", "\n", " a", "a ", "a  b", "a\n\nb", "a \n b", "it's we'll don't 'tis a' s b's's", "x\ny z", "12.5% (x) word, word. “q”", "é y ü ß", "\x1ca b\x1c c", "日本 語 a", "a b c d", "<|endoftext|> z", "a <|endoftext|> b", " <|endoftext|><|endoftext|>\nx", "<|endoftext", "|endoftext|>", "a\tb\r\nc", "😀 😀😀", "½ ² ª x", "ſ K"]


def test_cached_pieces_are_exact(tokenizer, encoder):
    for text, got in zip(CASES, encoder.documents(CASES), strict=True):
        assert got.tolist() == ids_of(tokenizer, text).tolist(), repr(text)
    assert [x.tolist() for x in encoder.documents([None, ""])] == [[0], [0]]
    assert encoder.documents([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t'.,!sabtdrevlmé12ü日 　#", max_size=40), max_size=4))
def test_any_text_is_exact(tokenizer, encoder, texts):
    assert [x.tolist() for x in encoder.documents(texts)] == [ids_of(tokenizer, t).tolist() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=0, max_size=60), min_size=1, max_size=6))
def test_grammar_round_trip(docs):
    docs = [np.array([*d, 0], np.uint32) for d in docs]
    ids, ends = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, rules, marks = compress(ids, ends, 100, 50)
    assert Grammar(rules, 100).expand(symbols).tolist() == ids.tolist()
    assert marks.sum() == len(docs) and len(symbols) == len(marks) <= len(ids)


def test_grammar_goes_on_until_no_pair_is_left():
    docs = [np.array([*range(1, 51)] * 64 + [0], np.uint32), np.random.default_rng(0).integers(1, 60, 3000).astype(np.uint32)]
    ids, ends = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, rules, marks = compress(ids, ends, 100, 10_000)
    grammar = Grammar(rules, 100)
    assert grammar.expand(symbols).tolist() == ids.tolist() and grammar.length.max() >= 50 * 16
    seen, last = {}, {}
    for k in np.flatnonzero(~marks[:-1]).tolist():
        pair = int(symbols[k]), int(symbols[k + 1])
        if last.get(pair, -2) < k - 1:  # not the overlapping second pair of a run
            seen[pair], last[pair] = seen.get(pair, 0) + 1, k
    assert max(seen.values()) == 1
    assert len(compress(ids, ends, 100, 40)[1]) == 40


@pytest.mark.parametrize("share", [2, 50, 10**9])
def test_moved_and_linked_rounds_go_on_until_no_pair_is_left(monkeypatch, share):
    monkeypatch.setattr(token_grammar, "SHARE", share)
    r = np.random.default_rng(1)
    docs = [np.append(x, 0).astype(np.uint32) for x in (r.integers(1, 9, 5000), np.full(777, 5), np.tile([3, 3, 3, 4], 300), [], [7], r.integers(1, 3000, 4000))]
    ids, ends = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, rules, marks = compress(ids, ends, 3000, hashed=100)
    assert Grammar(rules, 3000).expand(symbols).tolist() == ids.tolist() and marks.sum() == len(docs)
    assert len(np.unique(rules, axis=0)) == len(rules)
    seen, last = {}, {}
    for k in np.flatnonzero(~marks[:-1]).tolist():
        pair = int(symbols[k]), int(symbols[k + 1])
        if last.get(pair, -2) < k - 1:
            seen[pair], last[pair] = seen.get(pair, 0) + 1, k
    assert max(seen.values()) == 1
    assert len(compress(ids, ends, 3000, 33, hashed=100)[1]) == 33


def test_a_worker_keeps_its_encoder(spark):
    def known(frames):
        for f in frames:
            encoder = shared()
            before = len(encoder.rest)
            encoder.documents([f"a wordof{x} b" for x in f["id"]])
            yield pd.DataFrame({"pid": [os.getpid()], "encoder": [id(encoder)], "before": [before]})

    got = spark.range(0, 64, 1, 16).mapInPandas(known, "pid long, encoder long, before long").collect()
    assert len({(r.pid, r.encoder) for r in got}) == len({r.pid for r in got}) < len(got)
    assert sum(r.before > 0 for r in got) >= len(got) - len({r.pid for r in got})


def test_shard_reads_anywhere():
    r = np.random.default_rng(0)
    docs = [np.append(r.integers(0, 50, n), 0).astype(np.uint32) for n in (0, 3, 4000, 1, 9000)] + [np.array([7, 8] * 500 + [0], np.uint32), np.array([5] * 999 + [0], np.uint32)]
    image = pack([None, 4, 5, 6, 7, 8, 9], docs, 50_257)
    shard = Shard(image)
    assert [d for d, _ in shard.documents()] == [None, 4, 5, 6, 7, 8, 9]
    assert all(np.array_equal(a, b) for a, (_, b) in zip(docs, shard.documents(), strict=True))
    flat = np.concatenate(docs)
    for start, n in ((0, 1), (3, 700), (len(flat) - 5, 5), (12000, 2500)):
        assert shard.read(start, n).tolist() == flat[start : start + n].tolist()
    assert len(shard.grammar.length) > 50_257
    with pytest.raises(ValueError):
        Shard(image[:-1] + b"\0\1")


def test_files_hold_all_documents(spark, odd, none, tokenizer, tmp_path):
    write_shards(odd, str(tmp_path / "a"), shard_tokens=2000)
    got = sorted(read_shards(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at = 0
    for g, r in zip(got, rows, strict=True):
        ids = ids_of(tokenizer, r.text)
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, at, len(ids))
        assert g.ids_crc32 == zlib.crc32(ids)
        at += len(ids)
    write_shards(none, str(tmp_path / "b"))
    assert read_shards(spark, str(tmp_path / "b")).count() == 0


def test_packing_is_whole(odd, none, tokenizer):
    got = pack_documents(odd, capacity=256, with_ids=True).collect()
    pieces = {}
    for r in got:
        assert np.frombuffer(r.ids, "<u4").size == r.length <= 256 and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in pieces.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    want = sorted(ids_of(tokenizer, r.text).tolist() for r in odd.collect())
    docs = {}
    for r in got:
        if r.doc_id not in (19, None):
            docs.setdefault(r.doc_id, []).append((r.piece, r.ids))
    joined = [np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist() for p in docs.values()]
    assert all(x in want for x in joined) and sum(r.length for r in got) == sum(map(len, want))
    assert all(r.length == 256 for r in got if r.piece > 0)
    assert pack_documents(none).count() == 0


def test_knapsack_is_exact():
    sizes, values, counts = np.array([3, 5, 7]), np.array([3.0, 5.5, 7.1]), np.array([9, 1, 2])
    best = max(((a, b, c) for a in range(7) for b in range(2) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20), key=lambda x: np.dot(x, values))
    assert np.dot(best_configuration(sizes, values, counts, 20), values) == pytest.approx(np.dot(best, values))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_packs_each_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=65)
    plan = Plan(counts, 64, 8, 12)
    used = np.zeros(65, int)
    for own, n in plan.groups:
        assert sum(own) <= 64
        for x in own:
            used[x] += n
    assert used.tolist() == counts.tolist()
    assert plan.sequences <= 1.3 * sum(lengths) / 64 + sum(x > 32 for x in lengths) + 1


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(1)
    lengths = np.minimum(2048, np.maximum(1, np.exp(r.normal(6, 1.2, 50_000)).astype(int)))
    assert Plan(np.bincount(lengths, minlength=2049), 2048, 512, 48).sequences <= 1.002 * lengths.sum() / 2048 + 2
