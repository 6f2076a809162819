"""Keyword and vector search against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.functions import texts
from quotemill.operators import embed, keyword, vectors

DOCS = [
    (1, "Bitcoin rises", "Inflation fears ease as bitcoin rises again", "2024-01-01 00:00:00"),
    (2, "Markets", "The bitcoin market and inflation. " + "filler " * 120 + "bitcoin", "2024-01-02 00:00:00"),
    (3, "Bitcoins inflated", None, "2024-01-03 00:00:00"),
    (4, "Inflation only", "prices are rising", None),
    (5, "Bitcoin", "bitcoin " * 300, "2024-01-01 00:00:00"),
    (6, "Nothing", "of the and", "2024-01-01 00:00:00"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "id bigint, title string, description string, p string")
    return df.withColumn("published_at", F.col("p").cast("timestamp_ntz")).drop("p")


def content(text):
    """The stems of a text without stop words."""
    return [texts.stem_word(t) for t in re.findall(r"[^\W_]+", text.lower()) if t not in texts.STOP_WORDS]


def brute_ranks(query):
    """BM25 of the documents that hold every term of the query."""
    held = {number: content(f"{title} {text or ''}") for number, title, text, _ in DOCS}
    mean = sum(map(len, held.values())) / len(held)
    wanted = set(content(query))
    out = {}
    for number, terms in held.items():
        if wanted and wanted <= set(terms):
            out[number] = 0.0
            for term in wanted:
                n, tf = sum(term in other for other in held.values()), terms.count(term)
                weight = math.log(1 + (len(held) - n + 0.5) / (n + 0.5))
                out[number] += weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / mean))
    return out


QUERIES = ["bitcoin inflation", "bitcoin", "the rising", "of the", "Bitcoins, markets!", "absent bitcoin"]


def asked(spark, queries):
    return spark.createDataFrame([(q,) for q in queries], "query string")


def test_search_matches_brute_force(spark, docs):
    got = {(r["query"], r["id"]): r["relevance"] for r in keyword.search(docs, asked(spark, QUERIES), limit=10).collect()}
    want = {(query, number): rank for query in QUERIES for number, rank in brute_ranks(query).items()}
    assert set(got) == set(want) and len(want) >= 8
    for key, rank in want.items():
        assert got[key] == pytest.approx(rank, abs=1e-8)


def test_stored_index_gives_the_same(spark, docs, tmp_path):
    keyword.write_postings(keyword.postings(docs, keyword.search_text()), f"{tmp_path}/index", buckets=8)
    index = keyword.read_postings(spark, f"{tmp_path}/index", keyword.query_terms(asked(spark, QUERIES)), buckets=8)
    stored = keyword.search(docs, asked(spark, QUERIES), index=index).select("query", "place", "id").collect()
    direct = keyword.search(docs, asked(spark, QUERIES)).select("query", "place", "id").collect()
    assert sorted(map(tuple, stored)) == sorted(map(tuple, direct))
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_unusual_queries(spark, docs):
    assert keyword.search(docs, asked(spark, ["of the"])).count() == 0
    assert keyword.search(docs, asked(spark, ["", "??", None])).count() == 0
    assert keyword.search(docs.filter("false"), asked(spark, QUERIES)).count() == 0


def test_no_text_is_shuffled(spark, docs):
    plan = keyword.postings(docs, keyword.search_text(), keyword.query_terms(asked(spark, QUERIES)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in "".join(line for line in text.splitlines() if "Exchange" in line)


def test_context_lines(docs):
    found = keyword.search(docs, asked(docs.sparkSession, ["bitcoin inflation"]), limit=2)
    text = keyword.news_context(found).first()["context"].split("\n")
    assert text[0] == "- [2024-01-01] Bitcoin rises: Inflation fears ease as bitcoin rises again"
    assert len(text) == 2


# --- vectors -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def space(spark):
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in random.normal(size=16)]) for i in range(400)] + [(400, None), (401, [0.0] * 16)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5), rows[:400]


def brute_topk(rows, question, k):
    q = np.array(question)
    score = [(round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 6), i) for i, v in ((i, np.float32(v).astype(float)) for i, v in rows)]
    return [i for s, i in sorted(score, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.fixture(scope="module")
def questions(spark, space):
    random = np.random.default_rng(6)
    asked = {f"q{i}": [float(x) for x in random.normal(size=16)] for i in range(12)}
    return spark.createDataFrame(list(asked.items()), "question string, embedding array<float>"), asked


@pytest.mark.parametrize("budget, scores", [(vectors.MAX_BROADCAST_BYTES, vectors.MAX_SCORES), (1000, 40)])
def test_topk_matches_brute_force_in_one_or_many_slices(space, questions, monkeypatch, budget, scores):
    monkeypatch.setattr(vectors, "MAX_BROADCAST_BYTES", budget)
    monkeypatch.setattr(vectors, "MAX_SCORES", scores)
    df, rows = space
    found = vectors.semantic_topk(df, questions[0], 4).collect()
    for name, question in questions[1].items():
        mine = [r["id"] for r in sorted((r for r in found if r["question"] == name), key=lambda r: r["place"])]
        assert mine == brute_topk(rows, np.float32(question).astype(float), 4)


def test_topk_honours_the_limit_and_no_questions_give_no_rows(space, questions):
    df, _ = space
    counts = vectors.semantic_topk(df, questions[0], 50).groupBy("question").count()
    assert {r["count"] for r in counts.collect()} == {50}
    assert vectors.semantic_topk(df, questions[0].filter("false"), 5).count() == 0


def test_a_vector_is_most_similar_to_itself(space):
    df, _ = space
    some = df.filter("id < 20").select(F.col("id").cast("string").alias("question"), "embedding")
    found = vectors.semantic_topk(df, some, 1).collect()
    assert all(r["question"] == str(r["id"]) and r["similarity"] == pytest.approx(1.0, abs=1e-9) for r in found)


def test_zero_vectors_come_last(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])], "id bigint, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "question string, embedding array<float>")
    rows = vectors.semantic_topk(df, asked, 3).orderBy("place").collect()
    assert [r["id"] for r in rows] == [3, 2, 1] and math.isnan(rows[2]["similarity"])


def test_index_recall(spark, space, questions, tmp_path):
    df, rows = space
    vectors.build_vector_index(df, f"{tmp_path}/cells", planes=3)
    stored = spark.read.parquet(f"{tmp_path}/cells")
    assert stored.count() == 401 and stored.select("cell").distinct().count() > 4

    def recall(reach):
        found = vectors.approximate_topk(spark, f"{tmp_path}/cells", questions[0], 5, planes=3, reach=reach).collect()
        hits = 0
        for name, question in questions[1].items():
            exact = set(brute_topk(rows, np.float32(question).astype(float), 5))
            hits += len(exact & {r["id"] for r in found if r["question"] == name})
        return hits / (5 * len(questions[1]))

    assert recall(3) == 1.0
    assert recall(1) >= 0.8


def test_encoder_gives_unit_vectors_and_finds_equal_texts(spark, docs):
    rows = docs.select("id", embed.embedding_text().alias("text"))
    encode = embed.fit_encoder(rows, dimensions=64)
    encoded = encode(rows)
    sizes = encoded.select(F.size("embedding"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).collect()
    assert all(s == 64 and n == pytest.approx(1.0, abs=1e-4) for s, n in sizes)
    asked = encode(rows.filter("id = 1")).select(F.lit("q").alias("question"), "embedding")
    assert vectors.semantic_topk(encoded, asked, 1).first()["id"] == 1


def test_backfill_fills_only_missing_rows_up_to_the_batch(spark, docs):
    news = docs.withColumn("embedding", F.when(F.col("id") == 1, F.array(F.lit(0.5).cast("float"))))
    encode = embed.model_encoder(lambda: lambda batch: [[float(len(t)), 1.0] for t in batch])
    filled = {r["id"]: r["embedding"] for r in embed.backfill(news, encode, limit=2).collect()}
    assert filled[1] == [0.5] and filled[2][1] == 1.0 and filled[3] == [float(len("Bitcoins inflated ")), 1.0] and filled[4] is None
    assert embed.coverage(embed.backfill(news, encode, limit=None)).first()["with_embedding"] == len(DOCS)


def test_embedding_text_is_whole_unless_a_limit_is_given(docs):
    row = docs.filter("id = 5").select(embed.embedding_text().alias("a"), embed.embedding_text(max_chars=1000).alias("b")).first()
    assert len(row["a"]) > 2000 and len(row["b"]) == 1000


def test_many_terms_are_joined_with_equal_results(spark, docs, monkeypatch):
    few = sorted(map(tuple, keyword.search(docs, asked(spark, QUERIES)).select("query", "id", "place", "relevance").collect()))
    monkeypatch.setattr(keyword, "SHIPPED_TERMS", 1)
    many = keyword.search(docs, asked(spark, QUERIES)).select("query", "id", "place", "relevance").collect()
    assert sorted(map(tuple, many)) == few and few


def test_stems_begin_like_their_words(tables):
    """What lets the search skip words before stemming them."""
    tokens = {t for r in tables.news.select("title", "description").collect() for t in texts.WORD.findall(f"{r[0]} {r[1]}".lower())}
    assert len(tokens) > 1000
    assert all(texts.stem_word(t)[:2] == t[:2] for t in tokens if t not in texts.IRREGULAR_STEMS)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_registered_near_query_recall(spark, folder):
    from registry import search
    from registry.tables import Tables

    t = Tables(spark, f"/root/testdata/{folder}")
    labels = search._label_questions(t)
    by_id = t.raw("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("question"), "embedding")
    pairs = lambda df: {(r["question"], r["id"]) for r in df.collect()}
    for name, questions in (("labels", labels), ("ids", by_id)):
        exact = pairs(vectors.semantic_topk(t.raw("embeddings"), questions, 5, "vec_id"))
        recall = len(exact & pairs(search._indexed(t, questions, **search.NEAR))) / len(exact)
        print("recall", folder, name, recall)
        assert recall >= 0.9
    assert pairs(search.semantic_topk_near(t)) == pairs(search._indexed(t, labels, **search.NEAR))
