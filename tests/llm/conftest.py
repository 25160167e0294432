import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, count bigint, token string, component string"


@pytest.fixture
def odd(spark):
    """Documents with every awkward case, and columns whose names clash with the operators' own."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéü") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, long = text(120), text(6000)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \n\t ", "word", "two words", base, base, base.upper(), " ".join(near), base + " " + text(60), text(60) + "\n" + base,
        long, long + " tail", "x " * 300, "\n".join([text(9)] * 4), text(200), text(30) + " AKIA" + "A1" * 8 + " " + text(10),
        "a" * 5000, "日本語 テキスト 😀 " * 30, text(80), text(49), text(50), text(51), "#$% <s> [INST] \\ </s> " + text(20),
    ]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, len(t) if t else 0, k, "t", None) for k, t in enumerate(texts)]
    rows += [(19, texts[19], "en", "s1", 1, 0, "t", "c"), (None, base, "en", "s0", 1, 0, "t", "c"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def plain(odd):
    """The same with unique, known doc_ids."""
    return odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
