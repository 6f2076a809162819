import numpy as np

from quotemill.llm import topk
from quotemill.llm.queries import QUERIES

from . import brute

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def run(df, **kw):
    vectors = df.where(topk.usable("embedding")).select("vec_id", topk.quantised("embedding").alias("vector"))
    return [tuple(r) for r in topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10, **kw).collect()]


def test_whole_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = [tuple(r) for r in QUERIES["op1_topk_search"](spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.top_k([tuple(r) for r in rows])


def test_tiles_and_tree_do_not_change_the_result(make):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], "x", "y") for i in range(400)]
    df = make(rows, SCHEMA)
    expected = brute.top_k([r[:2] for r in rows])
    for shard_rows, block_rows in ((4096, 512), (5, 2)):
        assert set(run(df, shard_rows=shard_rows, block_rows=block_rows)) == expected


def test_odd_vectors(make):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
        (5, [None, 1.0]), (None, [1.0, 1.0]), (100, [3.0]), (7, [2.0]), (200, []), (8, []), (300, None),
        (9, [1e30, -1e30]),
    ]
    got = set(run(make([(*r, "x", "y") for r in rows], SCHEMA)))
    # Components beyond 2**62 are held there; products beyond 64 bits are held at their ends.
    assert (0, 1, 1, 5 * 1024 * 1024) in got
    assert {g for g in got if g[0] == 100} == {(100, 1, 7, 6 * 1024 * 1024)}
    assert {g for g in got if g[0] == 200} == {(200, 1, 8, 0)}
    assert {g[2] for g in got if g[0] == 0} == {1, 9}
    assert not {g for g in got if g[0] == 300}


def test_repeated_rows_and_empty_table(make, spark):
    rows = [(0, [1.0], "x", "y")] * 2 + [(1, [1.0], "x", "y")] * 2
    assert sorted(run(make(rows, SCHEMA))) == [(0, 1, 1, 1024 * 1024), (0, 2, 1, 1024 * 1024)]
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_large_products_are_exact():
    a = np.array([[2**31 + 1, 3]], np.int64)
    assert topk.scores(a, a).tolist() == [[(2**31 + 1) ** 2 + 9]]
