import random

import pytest

from quotemill.llm import decontaminate
from quotemill.llm.queries import QUERIES

from . import brute


def plain(df):
    return {tuple(r) for r in df.select("doc_id", "item_id", "n_shared", "n_shingles").collect()}


def test_whole_query_equals_brute_force(spark, small, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = plain(QUERIES["op9_decontamination"](spark, small))
    assert got and got == brute.contained([(r.doc_id, r.text) for r in documents.collect()], items)


def test_short_items_in_long_documents(make):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 6, 8, 15, 40])))) for i in range(40)]
    docs = []
    for i in range(40):
        text = rng.choices(words, k=rng.choice([30, 3000, 20000]))
        for item in rng.sample(items, 2):
            part = item[1].split(" ")
            if rng.random() < 0.5 and len(part) >= 40:
                part[-3] = "changed"  # three shingles of 36 differ
            at = rng.randrange(len(text))
            text[at:at] = part
        docs.append((i, " ".join(text)))
    got = plain(decontaminate.contained_items(make(docs, "doc_id long, text string"), make(items, "item_id long, text string")))
    assert got == brute.contained(docs, items)


def test_odd_texts(make, spark):
    items = [(1, "Alpha beta, gamma delta epsilon!"), (2, "two words"), (3, None), (4, ""), (5, "..."), (None, "a b c d e"), (1, "Alpha beta, gamma delta epsilon!")]
    docs = [
        (1, "x ALPHA beta gamma\ndelta-epsilon y"), (2, "two words"), (3, "here are two words too"), (4, None), (5, ""), (6, "!!"),
        (None, "alpha beta gamma delta epsilon"), (7, "alpha beta gamma delta epsilon"), (7, "alpha beta gamma delta epsilon"), (8, "a b c d e"),
    ]
    schema = "doc_id long, text string, item_id string, n_shared string"
    bench = make([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.contained_items(make([(*d, "x", "y") for d in docs], schema), bench)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == [(1, 1, 1, 1), (2, 2, 1, 1), (7, 1, 1, 1)]
    kept = decontaminate.clean(make([(*d, "x", "y") for d in docs], schema), bench)
    assert kept.columns == ["doc_id", "text", "item_id", "n_shared"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 8]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.contained_items(none, bench).collect() == []
    assert decontaminate.contained_items(make([d for d in docs], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("shortest", [1, 2, 5, 11, 30, 200])
def test_bins_are_fine_enough(shortest):
    from math import ceil, exp

    steps = decontaminate.finer_steps(shortest, 0.8)
    if steps < decontaminate.ALL_BITS:
        load = 0.5**steps
        assert (1 - (1 - exp(-load)) / load) ** ceil(0.8 * shortest) <= decontaminate.MISS


def test_main_path_is_native(spark, small):
    plan = QUERIES["op9_decontamination"](spark, small)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
