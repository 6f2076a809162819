import itertools
import random

import pytest

from quotemill.llm import simhash
from quotemill.llm.queries import QUERIES

from . import brute


def test_whole_query_equals_brute_force(spark, small, documents):
    rows = documents.select("doc_id", "text").collect()
    prints = [brute.fingerprint(r.text) for r in rows]
    owners = brute.components(prints, [r.doc_id for r in rows])
    expected = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, owners)}
    got = QUERIES["op4_simhash"](spark, small).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == expected


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for i in range(64):
        for j in range(64):
            flips = {0: 0, 1: 1 << i, 2: 1 << i | 1 << j}[radius]
            assert any(not m & flips for m in masks)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_large_buckets_lose_no_link(spark, radius):
    """Hundreds of fingerprints that differ in a few bits fill buckets beyond SMALL_BUCKET."""
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(400):
        start = rng.choice(sorted(prints))
        prints.add(start ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) * (1 << rng.randrange(64)))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    from quotemill.llm.common import components

    found = {r.node: r.root for r in components(simhash.links(df, radius)).collect()}
    signed = [simhash.signed(p) for p in prints]
    expected = brute.components(prints, signed, radius)
    assert [found.get(s, s) for s in signed] == expected


def test_odd_texts(make):
    rows = [
        (5, None, "a"), (3, "", "b"), (9, " \n\t", "c"), (1, "One", "d"), (2, "oNE", "e"), (7, "one two", "f"),
        (None, "one", "g"), (8, "x " * 50_000, "h"), (6, "x " * 40_000, "i"), (4, "École école", "j"), (4, "other words", "k"),
    ]
    got = simhash.near_duplicates(make(rows, "doc_id long, text string, fp string"))
    found = {(r.doc_id, r.fp): r.component_id for r in got.collect()}
    prints = [brute.fingerprint(t) for _, t, _ in rows]
    owners = brute.components(prints, [r[0] for r in rows])
    assert found == {(r[0], simhash.signed(p)): c for r, p, c in zip(rows, prints, owners)}
    assert found[5, 0] == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_first(empty).collect() == []


def test_keep_first_keeps_columns_and_null_ids(make):
    rows = [(2, "a b c d", "x"), (1, "A b c d", "y"), (None, "a b c d", "z"), (3, "quite another text", "w")]
    got = simhash.keep_first(make(rows, "doc_id long, text string, component_id string"))
    assert got.columns == ["doc_id", "text", "component_id"]
    assert {r.component_id for r in got.collect()} == {"y", "z", "w"}


def test_hot_keys_meet_stored_aggregates(spark):
    """No aggregation lies between a join and its shuffle, which would keep a hot key whole."""
    from quotemill.llm import common

    edges = spark.createDataFrame([(i + 1, 0) for i in range(200)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        common._checkpoint_folder(edges)
        stars = [common._large_star(edges.checkpoint()), common._small_star(edges.checkpoint())]
        held = simhash.links(spark.createDataFrame([(i,) for i in range(300)], "fp long"), 2)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*stars, held)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in plans:
        lines = plan.split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        joins = [i for i, line in enumerate(lines) if "SortMergeJoin" in line]
        assert joins
        for i in joins:
            shuffled = None  # what lies below a shuffle does not matter
            for line in itertools.takewhile(lambda line: depth(line) > depth(lines[i]), lines[i + 1 :]):
                if shuffled is None or depth(line) <= shuffled:
                    assert "Aggregate" not in line
                    shuffled = depth(line) if "Exchange" in line else None
