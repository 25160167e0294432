"""Reply trees, sharding, the pipeline and the registered queries."""

import hashlib
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starling.llm import queries
from starling.llm.mcd_rules import judge
from starling.llm.reply_trees import conversation_nodes, digest, escape, format_trees, read_back, unescape
from starling.llm.secret_links import base_spans
from starling.llm.shard_tree import Tree, descend, shard_documents
from starling.llm.string_tiling import EDGES
from tests.llm.test_text_operators import classes
from tests.twins import check, connection

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, name):
    check(spark, connection(SF), name, queries.QUERIES[name], queries.SQL[name], SF)


NODES = "id string, parent string, role string, text string, score double, rank int, root string"


def test_branches_rank_by_score(spark):
    rows = [("a", None, "user", "q", 1.0), ("b", "a", "assistant", "good", 5.0), ("c", "a", "assistant", "bad", 0.0), ("d", "b", "user", "more", 1.0), ("e", "d", "assistant", "end", 3.0), ("f", "b", "user", "less", 0.0)]
    rows += [("lone", None, None, None, None), ("orphan", "gone", "user", "x", 1.0), ("x", "y", "user", "cycle", 1.0), ("y", "x", "user", "cycle", 1.0), ("a", None, "user", "q", 1.0)]
    nodes = spark.createDataFrame([(*r, 0, "z") for r in rows], NODES)
    got = {(r.root, r["rank"]): [(t.role, t.text) for t in r.parsed] for r in read_back(format_trees(nodes, 2)).collect()}
    assert got == {
        ("a", 1): [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")],
        ("a", 2): [("user", "q"), ("assistant", "good"), ("user", "less")],
        ("lone", 1): [("", "")],
        ("orphan", 1): [("user", "x")],
    }
    assert format_trees(nodes.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "\\", "\\\\<|im_end|>\n", "<<SYS>>", "<<s>", "a<|im_start|>user", "<|endoftext|>", "", "[\\INST]", "<s"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"))


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi\n<|im_end|>"), (1, 1, "assistant", "yo"), (1, 1, "assistant", None), (1, None, "sys\ntem%0A<", "s"), (2, 0, None, None), (None, 0, "user", "x")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(70)]
    got = {r.conv_id: r for r in digest(format_trees(conversation_nodes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said, learnt = "".join(f"{r}\n{t}\n" for *_, r, t in own), "".join(t for *_, r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_sharding_law(spark, odd, none):
    got = shard_documents(odd).collect()
    assert len(got) == odd.count()
    slots = Counter()
    for r in got:
        slots[r.shard] += 1
        assert r.grown_shard in (r.shard, 16)
    for s, n in slots.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    sizes = {(r.doc_id, (r.text or "")): (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect()}
    assert sorted((r.size, r.text_crc32) for r in got if r.doc_id not in (None, 19)) == sorted(v for (d, _), v in sizes.items() if d not in (None, 19))
    assert shard_documents(none).count() == 0


def test_tree_weights_and_movement(spark):
    rows = spark.range(20_000).withColumn("shard", F.lit(-1))
    old, new = Tree({0: {0: {0: 1.0, 1: 3.0}, 1: {2: 2.0}}, 1: {2: {3: 2.0}}}), Tree({0: {0: {0: 1.0, 1: 3.0}, 1: {2: 6.0}}, 1: {2: {3: 2.0}}})
    put = lambda t: {r.id: r.s for r in descend(rows, F.col("id"), t, "s").collect()}
    a, b = put(old), put(new)
    shares = Counter(a.values())
    assert [shares[k] / 20_000 for k in range(4)] == pytest.approx([0.125, 0.375, 0.25, 0.25], abs=0.02)
    moved = Counter((a[k], b[k]) for k in a if a[k] != b[k])
    # region 0 and its rack 1 grew: rows enter region 0 or leave rack 0 for rack 1; nothing goes to region 1
    assert all(y != 3 for _, y in moved) and not {(0, 1), (1, 0), (2, 0), (2, 1)} & set(moved)


def normal(text):
    return [w.lower().strip("".join(map(chr, EDGES))) or w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def grams(words, n=5):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@tables
def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline
    from starling.llm.common import read, stored

    docs, items = read(spark, SF, "documents"), [normal(r.text) for r in read(spark, SF, "benchmark").collect()]
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert 0 < len(kept[name]) == docs.count()
    good, unique, clean, masked = (kept[n] for n, _ in corpus_pipeline.STAGES[:-1])

    judged = {r.doc_id: r.kept for r in judge(read(spark, SF, "documents")).collect()}
    assert good == {d: t for d, t in rows.items() if judged[d]}
    part = classes(list(good.items()), 5, 80)
    assert set(unique) == {d for d in good if part[d][1] == d}

    seeds = [grams(w) for w in items]
    for d, t in unique.items():
        words = normal(t)
        own = grams(words)
        shares = [len(own & s) / len(s) if s else 0 for s in seeds]
        if max(shares) == 1:
            assert d not in clean
        if max(shares) == 0:
            assert d in clean
    assert set(masked) == set(clean)
    for d, t in masked.items():
        assert not base_spans(t)
        assert t == clean[d] if not base_spans(clean[d]) else "<" in t

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(masked)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"pipeline"}))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
