import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import toxicity
from quotemill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_recall_and_precision(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = toxicity.categories_of(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    chain = toxicity.learn(docs, labels.where(~held), toxicity.CATEGORIES)
    rows = toxicity.predict(docs, chain).join(labels.where(held), "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.p_toxic >= 0.5 for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.p_toxic >= 0.5 for r in rows if not r.toxic) <= 0.02 * len(rows)


def test_whole_query(spark, small, documents):
    rows = QUERIES["op3_toxicity"](spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    assert all(0 <= p <= 1 for r in rows for p in (r.p_toxic, r.p_toxic_prose, r.p_toxic_junk))
    assert all(r.toxic == (r.p_toxic >= 0.5) for r in rows)


def test_later_models_use_out_of_fold_probabilities():
    """The second label repeats the first one; its word is noise, so the chain must carry it."""
    rng = np.random.default_rng(2)
    n = 300
    first = rng.integers(0, 2, n)
    column = np.where(first == 1, 0, 1)
    rows = toxicity.Rows(n, 2, np.arange(n), column, np.ones(n))
    models = toxicity.fit_chain(rows, np.column_stack([first, first]).astype(float), np.ones(n), np.arange(n) % toxicity.FOLDS)
    assert len(models) == 2 and len(models[0][1]) == 1 and len(models[1][1]) == 2
    assert models[1][1][0] > 0.5
    noise = toxicity.Rows(n, 2, np.arange(n), rng.integers(0, 2, n), np.ones(n))
    seen = {}
    original = toxicity.fit_linear

    def watched(rows, dense, y, weight):
        seen.setdefault(dense.shape[1], []).append(dense.copy())
        return original(rows, dense, y, weight)

    toxicity.fit_linear = watched
    try:
        toxicity.fit_chain(noise, np.column_stack([first, first]).astype(float), np.ones(n), np.arange(n) % toxicity.FOLDS)
    finally:
        toxicity.fit_linear = original
    # On pure noise out-of-fold probabilities know nothing of the label.
    assert abs(np.corrcoef(seen[1][0][:, 0], first)[0, 1]) < 0.25


def test_odd_texts(make, spark):
    docs = [(i, "you are a worthless clown" if i % 2 else "a fine day at the lake", "x") for i in range(40)]
    docs += [(100, None, "x"), (101, "", "x"), (102, "fine " * 100_000, "x"), (103, "worthless clown", "x"), (103, "worthless clown", "x"), (None, "clown", "x")]
    df = make(docs, "doc_id long, text string, toxic string")
    labels = make([(i, i % 4 // 2, i % 2) for i in range(40)] + [(100, None, 1), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(df, labels).collect()
    assert len(got) == len(docs)
    assert {r.doc_id for r in got if r.toxic} >= {1, 39, 103} and not {r.doc_id for r in got if r.toxic} & {0, 2, 102}
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in toxicity.classify(df, empty).collect())
    assert toxicity.classify(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []


def test_too_many_categories_are_refused(make):
    names = [f"c{i}" for i in range(7)]
    labels = make([(1, *[0] * 7)], "doc_id long, " + ", ".join(f"{n} int" for n in names))
    with pytest.raises(ValueError):
        toxicity.learn(make([(1, "x")], "doc_id long, text string"), labels, names)


def test_whole_query_equals_plain_prediction(spark, small, documents):
    """Every row's probabilities, one category after the other, from the weights of the fitted chain."""
    import math
    import re

    docs = documents.select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    chain = toxicity.learn(docs, toxicity.categories_of(labels), toxicity.CATEGORIES)

    def plain(text):
        counts = {}
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for feature in [word] + ([word[:5] + "*"] if len(word) >= 5 else []):
                counts[feature] = counts.get(feature, 0) + 1
        out = []
        for c in range(len(chain.categories)):
            score = sum((1 + math.log(n)) * chain.sparse[chain.vocabulary[f], c] for f, n in counts.items() if f in chain.vocabulary)
            score += sum(w * p for w, p in zip(chain.dense[c], [*out, 1.0]))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
        return out

    got = {r.doc_id: (r.p_toxic, r.p_toxic_prose, r.p_toxic_junk) for r in QUERIES["op3_toxicity"](spark, small).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert np.allclose(got[r.doc_id], plain(r.text), atol=1e-9)
