import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.operators import quantised, vectors
from registry import search
from registry.tables import Tables


def exact(rows, question, k):
    unit = lambda v: v / np.linalg.norm(v) if np.any(v) else v * np.nan
    score = [(-round(float(unit(np.float32(v).astype(float)) @ unit(question)), 12), i) for i, v in rows if np.any(v)]
    return [i for _, i in sorted(score)[:k]]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_and_bytes_of_the_registered_query(spark, folder):
    """0.9 of the true neighbours from less than an eighth of the bytes."""
    from quotemill.session import new_work_dir

    t = Tables(spark, f"/root/testdata/{folder}")
    path = new_work_dir(spark, "quantised-test")
    quantised.build_index(t.raw("embeddings"), path, id_column="vec_id")
    used, all_bytes = quantised.bytes_read(spark, path)
    assert used < all_bytes / 8
    stored = lambda name: sum(r["length"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{name}").select("length").collect())
    assert stored("codes") < stored("vectors") / 6
    labels = search._label_questions(t)
    by_id = t.raw("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("question"), "embedding")
    pairs = lambda df: {(r["question"], r["id"]) for r in df.collect()}
    for name, questions in (("labels", labels), ("ids", by_id)):
        wanted = pairs(vectors.semantic_topk(t.raw("embeddings"), questions, 5, "vec_id"))
        recall = len(wanted & pairs(quantised.search(spark, path, questions))) / len(wanted)
        print("recall", folder, name, recall, used / all_bytes)
        assert recall >= 0.9
    assert pairs(quantised.search(spark, path, labels, whole=True)) == pairs(vectors.semantic_topk(t.raw("embeddings"), labels, 5, "vec_id"))


def test_found_rows_are_exact_and_depth_of_all_rows_finds_all(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=10)]) for i in range(300)]
    rows += [(500, [0.0] * 10), (501, None), (502, rows[3][1]), (503, rows[3][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "id long, embedding array<float>, place string").repartition(4)
    quantised.build_index(docs, f"{tmp_path}/index", parts=3)
    asked = [(f"q{i}", [float(x) for x in rng.normal(size=10)]) for i in range(6)] + [("q0", [1.0] * 10)] * 0
    questions = spark.createDataFrame([*asked, asked[0], (None, asked[0][1]), ("none", None)], "question string, embedding array<double>")
    known = [(i, v) for i, v in rows if v is not None]
    for options in ({"depth": 1000}, {"whole": True}):
        found = quantised.search(spark, f"{tmp_path}/index", questions, 4, **options).collect()
        for name, question in asked:
            mine = sorted((r.place, r.id) for r in found if r.question == name)
            assert [i for _, i in mine] == exact(known, np.array(question), 4)
    everything = quantised.search(spark, f"{tmp_path}/index", questions, 1000, depth=1000).where("question = 'q1'").collect()
    assert len(everything) == 303 and max(everything, key=lambda r: r.place).id == 500
    assert [r.similarity is None for r in everything] == [r.id == 500 for r in everything]
    near = quantised.search(spark, f"{tmp_path}/index", questions, 4, depth=40).collect()
    by_id = dict(known)
    for r in near:
        q = np.array(dict(asked)[r.question])
        v = np.float32(by_id[r.id]).astype(float)
        assert r.similarity == pytest.approx(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), abs=1e-9)


def test_empty_index_and_no_questions(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    quantised.build_index(none, f"{tmp_path}/none", parts=2)
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "question string, embedding array<double>")
    assert quantised.search(spark, f"{tmp_path}/none", asked).collect() == []
    docs = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    quantised.build_index(docs, f"{tmp_path}/one", parts=2)
    assert quantised.search(spark, f"{tmp_path}/one", asked.where("false")).collect() == []
    assert [r.id for r in quantised.search(spark, f"{tmp_path}/one", asked).collect()] == [1]


def test_slices_of_questions_and_folders(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)], "id long, embedding array<float>")
    monkeypatch.setattr(quantised, "FOLDER_ROWS", 20)
    quantised.build_index(docs, f"{tmp_path}/a", parts=4)
    asked = docs.where("id < 9").select(F.col("id").cast("string").alias("question"), "embedding")
    once = sorted(map(tuple, quantised.search(spark, f"{tmp_path}/a", asked, 3, depth=30).collect()))
    monkeypatch.setattr(quantised, "TABLE_BYTES", 2 * 4 * 256 * 4)
    assert sorted(map(tuple, quantised.search(spark, f"{tmp_path}/a", asked, 3, depth=30).collect())) == once
    assert all(r[2] == int(r[0]) for r in once if r[1] == 1)
    assert len({r.folder for r in spark.read.parquet(f"{tmp_path}/a/vectors").select("folder").distinct().collect()}) == 20


def test_centres():
    points = np.repeat(np.arange(5.0)[:, None], 3, 1)
    assert np.array_equal(quantised.learn_centres(np.tile(points, (9, 1)), 1), points)
    rng = np.random.default_rng(1)
    many = rng.normal(size=(5000, 2))
    centres = quantised.learn_centres(many, 1)
    error = ((many - centres[quantised.nearest_centres(many, centres)]) ** 2).sum(1).mean()
    assert centres.shape == (256, 2) and error < 0.02
