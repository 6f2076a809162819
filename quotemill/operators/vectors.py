"""Vector search: exact cosine top-k and a bucketed approximate index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.operators.joins import join_summary, settled

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Scores held at once by a task, and the stand-in for "no similarity" below every cosine.
MAX_SCORES = 4_000_000
NO_DIRECTION = -2.0
STEP = 2.0**-16  # of the distance to a plane


def _question_matrix(questions: DataFrame) -> tuple[list, np.ndarray, np.ndarray | None]:
    """Names, unit vectors and, if the questions have `cells`, their (cell, question number) rows by cell."""
    rows = questions.collect()
    if not rows:
        return [], np.empty((0, 0)), None
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    near = None
    if "cells" in questions.columns:
        asked = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r["cells"]) for r in rows])
        near = np.column_stack([np.concatenate([np.array(r["cells"], np.int32) for r in rows]), asked])
        near = near[np.argsort(near[:, 0], kind="stable")]
    return [r["question"] for r in rows], matrix / _lengths(matrix)[:, None], near


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """Row lengths; a zero vector has no direction, so its similarities become NaN and sort last."""
    norms = np.linalg.norm(vectors, axis=1)
    return np.where(norms == 0, np.nan, norms)


def _partition_top(ids_b, matrix_b, near_b, k: int):
    """Per partition: the k best documents of every question, folded block by block.

    With rows of (cell, question number) a document meets only the questions of its own cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, questions = ids_b.value, matrix_b.value
        everyone = np.arange(len(names))
        near = None
        if near_b.value is not None:
            cells, first = np.unique(near_b.value[:, 0], return_index=True)
            near = dict(zip(cells.tolist(), np.split(near_b.value[:, 1].astype(np.int64), first[1:])))
        step = max(k, MAX_SCORES // len(names))
        asked, found = np.empty(0, np.int64), np.empty(0, np.int64)
        best = np.empty(0)
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(batch.num_rows, questions.shape[1])
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            groups = [(np.arange(batch.num_rows), everyone)]
            if near is not None:
                own = batch.column("cell").to_numpy(zero_copy_only=False)
                groups = [(np.flatnonzero(own == cell), near.get(cell, everyone[:0])) for cell in np.unique(own)]
            for rows, start in ((r, s) for r, mine in groups if len(mine) for s in range(0, len(r), step)):
                mine = everyone if near is None else near[own[rows[0]]]
                rows = rows[start : start + step]
                block = vectors[rows].astype(np.float64)
                # Rounded, so equal vectors score equal wherever they lie in a block.
                score = np.round(questions[mine] @ (block / _lengths(block)[:, None]).T, 12)
                score[np.isnan(score)] = NO_DIRECTION
                width = score.shape[1]
                worst = np.partition(score, width - k, axis=1)[:, [width - k]] if width > k else -np.inf
                question, column = np.nonzero(score >= worst)
                asked = np.concatenate([asked, mine[question]])
                found = np.concatenate([found, ids[rows[column]]])
                best = np.concatenate([best, score[question, column]])
                order = np.lexsort((found, -best, asked))
                asked, found, best = asked[order], found[order], best[order]
                keep = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
                asked, found, best = asked[keep], found[keep], best[keep]
        if len(asked):
            best[best == NO_DIRECTION] = np.nan
            yield pa.RecordBatch.from_pydict(
                {
                    "question": pa.array(np.array(names, dtype=object)[asked], pa.string()),
                    "id": pa.array(found, pa.int64()),
                    "similarity": pa.array(best, pa.float64()),
                }
            )

    return run


def _slice_top(docs: DataFrame, questions: DataFrame, k: int, last: bool) -> DataFrame:
    """Candidates of one slice of questions.

    All slices but the last are computed at once and their question matrix is released, so
    the driver and the executors hold one slice at a time.
    """
    context = docs.sparkSession.sparkContext
    names, matrix, near = _question_matrix(questions)
    if not names:
        return docs.sparkSession.createDataFrame([], "question string, id bigint, similarity double")
    shared = [context.broadcast(names), context.broadcast(matrix), context.broadcast(near)]
    found = docs.mapInArrow(_partition_top(*shared, k), "question string, id bigint, similarity double")
    if last:
        return found
    found = settled(found)
    for value in shared:
        value.destroy()
    return found


def semantic_topk(
    docs: DataFrame,
    questions: DataFrame,
    limit: int = 5,
    id_column: str = "id",
) -> DataFrame:
    """(question, place, id, similarity): exact nearest documents by cosine.

    `docs` has an id and `embedding`; NULL embeddings are skipped. `questions` has
    (question, embedding). Each partition scores its documents against the whole question
    matrix and forwards k rows per question, so no pair of rows is ever materialised.
    The matrix is broadcast after its size is checked; a larger batch is cut into slices
    by hash, each below the limit, which run one after another over the documents. If the questions
    have `cells` (an array), a document meets only the questions with its `cell` among them.
    """
    extra = [("cell",), ("cells",)] if "cells" in questions.columns else [(), ()]
    vectors = docs.filter(F.col("embedding").isNotNull()).select(F.col(id_column).alias("id"), "embedding", *extra[0])
    keyed = questions.select(F.col("question").cast("string").alias("question"), "embedding", *extra[1])
    asked = settled(keyed.dropDuplicates(["question"]))
    width = F.size("embedding") + (F.size("cells") if extra[1] else 0)
    count, size = asked.agg(F.count("*"), F.max(width)).first()
    slices = max(1, -(-2 * count * (size or 1) * 8 // MAX_BROADCAST_BYTES))
    candidates = None
    for number in range(slices):
        mine = asked.filter(F.pmod(F.xxhash64("question"), F.lit(slices)) == number)
        part = _slice_top(vectors, mine, limit, number == slices - 1)
        candidates = part if candidates is None else candidates.unionByName(part)
    best = Window.partitionBy("question").orderBy(F.isnan("similarity"), F.desc("similarity"), "id")
    return candidates.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit).select(
        "question", "place", "id", "similarity"
    )


def with_sources(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The found documents with their columns; the found rows are broadcast if counted to be few."""
    return join_summary(docs, settled(found), "id")


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of two array columns, NULL for a zero vector."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    return dot(left, right) / F.nullif(F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)), F.lit(0.0))


# --- approximate index -------------------------------------------------------------------

def _with_cell(df: DataFrame, planes: int, seed: int) -> DataFrame:
    """Append the hyperplane cell of each vector and `sides`, its signed distances to the planes.

    A random projection with narrow buckets is the distance in steps of `STEP`, and its sign tells
    on which side of a random plane the unit vector lies. The planes depend on the seed and
    dimension only, so documents and questions share them.
    """
    unit = Normalizer(inputCol="_vector", outputCol="_unit")
    lsh = BucketedRandomProjectionLSH(
        inputCol="_unit", outputCol="_sides", numHashTables=planes, bucketLength=STEP, seed=seed
    )
    vectors = unit.transform(df.withColumn("_vector", array_to_vector("embedding")))
    model = lsh.fit(vectors.limit(1))
    sides = F.transform(F.col("_sides"), lambda side: vector_to_array(side)[0])
    cell = F.aggregate("sides", F.lit(0), lambda acc, side: acc * 2 + F.when(side < 0, 0).otherwise(1))
    return model.transform(vectors).withColumn("sides", sides).withColumn("cell", cell).drop("_vector", "_unit", "_sides")


def build_vector_index(
    docs: DataFrame, path: str, planes: int = 4, seed: int = 7, id_column: str = "id"
) -> None:
    """Store vectors in folders by cell. Rebalancing gives a full cell as many writers as it needs."""
    vectors = docs.filter(F.col("embedding").isNotNull()).select(F.col(id_column).alias("id"), "embedding")
    placed = _with_cell(vectors, planes, seed).drop("sides").hint("rebalance", "cell")
    placed.write.mode("overwrite").partitionBy("cell").parquet(path)


def _with_near_cells(questions: DataFrame, planes: int, seed: int, reach: int, probes: int | None) -> DataFrame:
    """(question, embedding, cells): the cells within `reach` crossings, or the `probes` nearest ones.

    Near is a small sum of the squared distances to the planes between the question and the cell.
    """
    flips = np.arange(1 << planes)
    crossed = flips[:, None] >> np.arange(planes)[::-1] & 1

    def near(sides: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for distances, cell in zip(sides.to_pylist(), own.to_pylist()):
            if probes is None:
                chosen = flips[crossed.sum(axis=1) <= reach]
            else:
                chosen = np.argsort(crossed @ np.square(np.array(distances)), kind="stable")[:probes]
            out.append((cell ^ chosen).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    near.__annotations__ = {"sides": pa.Array, "own": pa.Array, "return": pa.Array}
    cells = F.arrow_udf(near, "array<int>")(F.col("sides"), F.col("cell"))
    return _with_cell(questions, planes, seed).select("question", "embedding", cells.alias("cells"))


def approximate_topk(
    spark: SparkSession, path: str, questions: DataFrame, limit: int = 5, planes: int = 4, seed: int = 7, reach: int = 1,
    probes: int | None = None,
) -> DataFrame:
    """Nearest documents among the cells near each question; inside the cells the search is exact.

    Near are the cells within `reach` plane crossings or, if given, the `probes` cells nearest to
    the question. Only the cell folders near some question are read, by a join with their distinct
    cells, and a document is scored against the questions its cell is near to.
    """
    keyed = questions.select(F.col("question").cast("string").alias("question"), "embedding")
    asked = settled(_with_near_cells(keyed, planes, seed, reach, probes))
    wanted = asked.select(F.explode("cells").alias("cell")).distinct()  # at most one row per cell
    index = spark.read.schema("id BIGINT, embedding ARRAY<FLOAT>, cell INT").parquet(path)
    return semantic_topk(index.join(F.broadcast(wanted), "cell", "left_semi"), asked, limit)
