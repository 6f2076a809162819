"""Vector index by product quantisation: one byte per subspace, exact scores for the best.

Unit vectors are cut into subspaces. Each subspace has a codebook of up to 256 centres, learned
from a bounded sample, one subspace per task. A vector is stored as the numbers of its nearest
centres. A question looks its products with all centres up in a table, so a scan of the codes
gives approximate similarities; the `depth` best per question are fetched from the stored vectors
and scored exactly. Vectors lie in folders by hash of their id, and only folders that hold a
candidate are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.operators.joins import settled
from quotemill.operators.vectors import cosine, semantic_topk

CENTRES = 256
SAMPLE_ROWS = 16_384  # vectors the codebooks are learned from, the smallest by hash of the id
ROUNDS = 25
FOLDER_ROWS = 4096
MOST_FOLDERS = 10_000
TABLE_BYTES = 32 * 1024 * 1024  # lookup tables of the questions that scan the codes together
BLOCK_SCORES = 1 << 21


def unit_rows(flat: np.ndarray, rows: int) -> np.ndarray:
    """Rows of length one; rows of length zero stay zero."""
    vectors = flat.reshape(rows, -1).astype(np.float64)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def learn_centres(points: np.ndarray, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct points; with few distinct points each is a centre."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    if len(distinct) <= CENTRES:
        return distinct
    centres = distinct[rng.permutation(len(distinct))[:CENTRES]]
    for _ in range(ROUNDS):
        nearest = nearest_centres(points, centres)
        counts = np.bincount(nearest, minlength=CENTRES)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        # A centre without points starts again at a point far from its own centre.
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            away = ((points - centres[nearest]) ** 2).sum(axis=1)
            moved[empty] = points[np.argsort(-away, kind="stable")[: len(empty)]]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, the first on ties, in blocks of bounded size."""
    half = (centres**2).sum(axis=1) / 2
    step = max(1, BLOCK_SCORES // len(centres))
    parts = [np.argmin(half - points[a : a + step] @ centres.T, axis=1) for a in range(0, len(points), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, width, parts + 1).astype(int).tolist()
    return list(zip(edges, edges[1:]))


def train(docs: DataFrame, parts: int = 16, seed: int = 7) -> DataFrame:
    """(part, centres, width): the codebooks, learned from at most SAMPLE_ROWS vectors of (id, embedding)."""
    lots = docs.withColumn("lot", F.xxhash64("id", F.lit(seed)))
    sample = settled(lots.orderBy("lot", "id").limit(SAMPLE_ROWS).select("embedding"))

    def learn(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        vectors = rows["embedding"].combine_chunks()
        units = unit_rows(vectors.flatten().to_numpy(zero_copy_only=False), rows.num_rows)
        a, b = _cuts(units.shape[1], parts)[part]
        centres = learn_centres(units[:, a:b], seed + part).astype("<f4")
        columns = [pa.array([part], pa.int32()), pa.array([centres.tobytes()], pa.binary()), pa.array([b - a], pa.int32())]
        return pa.Table.from_arrays(columns, ["part", "centres", "width"])

    learn.__annotations__ = {"rows": pa.Table, "return": pa.Table}
    subspaces = F.explode(F.array(*[F.lit(m) for m in range(parts)])).alias("part")
    each = sample.where(F.col("embedding").isNotNull()).select("embedding", subspaces)
    # Dealt out by hand: the sample is small, and adaptive execution would put all subspaces into one task.
    return each.repartition(parts, "part").groupBy("part").applyInArrow(learn, "part int, centres binary, width int")


def _books(books: DataFrame) -> list[np.ndarray]:
    """The codebooks: at most 256 centres a subspace, as many numbers as 256 vectors."""
    rows = sorted(books.collect(), key=lambda r: r["part"])
    return [np.frombuffer(bytes(r["centres"]), "<f4").reshape(-1, r["width"]).astype(np.float64) for r in rows]


def build_index(docs: DataFrame, path: str, parts: int = 16, seed: int = 7, id_column: str = "id") -> None:
    """Store codebooks, codes and vectors of all rows with an embedding below `path`."""
    spark = docs.sparkSession
    vectors = docs.where(F.col("embedding").isNotNull()).select(
        F.col(id_column).cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")
    )
    train(vectors, parts, seed).coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
    books = _books(spark.read.parquet(f"{path}/books"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), batch.num_rows)
            cuts = _cuts(units.shape[1], len(books))
            codes = np.stack([nearest_centres(units[:, a:b], book) for (a, b), book in zip(cuts, books)], axis=1).astype(np.uint8)
            # A vector without direction has no code; it comes after all others.
            packed = [row.tobytes() if known else None for row, known in zip(codes, units.any(axis=1).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "code"])

    vectors.mapInArrow(encode, "id bigint, code binary").write.mode("overwrite").parquet(f"{path}/codes")
    rows = spark.read.parquet(f"{path}/codes").count()
    folders = min(MOST_FOLDERS, max(1, rows // FOLDER_ROWS))
    spark.range(1).select(F.lit(folders).alias("folders"), F.lit(rows).cast("bigint").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    dealt = vectors.withColumn("folder", _folder(folders)).hint("rebalance", "folder")
    dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/vectors")


def _folder(folders: int):
    return F.pmod(F.xxhash64("id", F.lit(11)), F.lit(folders)).cast("int")


def default_depth(rows: int) -> int:
    """Vectors scored exactly per question: the root of the rows, at least 24."""
    return max(24, isqrt(rows))


def candidates(spark: SparkSession, path: str, questions: DataFrame, depth: int) -> DataFrame:
    """(question, id): the `depth` best documents of each question by code.

    Each partition of the codes keeps `depth` rows per question of a slice of questions, whose
    lookup tables are bounded; the lists meet by question.
    """
    books = _books(spark.read.parquet(f"{path}/books"))
    asked = settled(questions.dropDuplicates(["question"]))
    codes = spark.read.schema("id BIGINT, code BINARY").parquet(f"{path}/codes")
    count = asked.count()
    per_question = max(1, len(books) * CENTRES * 4)
    slices = max(1, -(-count * per_question // TABLE_BYTES))
    found = None
    for number in range(slices):
        rows = asked.where(F.pmod(F.xxhash64("question"), F.lit(slices)) == number).collect()
        if not rows or not books:
            continue
        units = unit_rows(np.array([r["embedding"] for r in rows]), len(rows))
        cuts = _cuts(units.shape[1], len(books))
        tables = np.zeros((len(books), len(rows), CENTRES), np.float32)
        for m, ((a, b), book) in enumerate(zip(cuts, books)):
            tables[m, :, : len(book)] = units[:, a:b] @ book.T
        shared = spark.sparkContext.broadcast(([r["question"] for r in rows], tables))
        part = codes.mapInArrow(_scan(shared, depth), "question string, id bigint, score float")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "question string, id bigint")
    best = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= depth).select("question", "id")


def _scan(shared, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tables = shared.value
        parts, questions = len(tables), len(names)
        asked, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        step = max(depth, BLOCK_SCORES // max(1, questions))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                block = batch.slice(start, step)
                packed = block.column("code")
                known = packed.is_valid().to_numpy(zero_copy_only=False)
                rows = np.full((block.num_rows, parts), 0, np.uint8)
                rows[known] = np.frombuffer(b"".join(packed.drop_null().to_pylist()), np.uint8).reshape(-1, parts)
                score = np.zeros((questions, block.num_rows), np.float32)
                for m in range(parts):
                    score += tables[m][:, rows[:, m]]
                score[:, ~known] = -np.inf
                width = score.shape[1]
                edge = np.partition(score, width - depth, axis=1)[:, [width - depth]] if width > depth else np.float32(-np.inf)
                q, column = np.nonzero(score >= edge)
                asked = np.concatenate([asked, q])
                ids = np.concatenate([ids, block.column("id").to_numpy(zero_copy_only=False)[column]])
                scores = np.concatenate([scores, score[q, column]])
                order = np.lexsort((ids, -scores, asked))
                asked, ids, scores = asked[order], ids[order], scores[order]
                kept = np.arange(len(asked)) - np.searchsorted(asked, asked) < depth
                asked, ids, scores = asked[kept], ids[kept], scores[kept]
        if len(asked):
            question = pa.array(np.array(names, dtype=object)[asked], pa.string())
            yield pa.RecordBatch.from_arrays([question, pa.array(ids), pa.array(scores)], ["question", "id", "score"])

    return run


def search(spark: SparkSession, path: str, questions: DataFrame, limit: int = 5, depth: int | None = None, whole: bool = False) -> DataFrame:
    """(question, place, id, similarity): nearest documents by cosine among the `depth` best by code.

    `questions` has (question, embedding); rows that repeat a question count once. `depth` is
    `default_depth` of the index unless given; with `whole` all documents are scored exactly.
    Vectors without direction come last, their similarity is null; a null embedding is in no index.
    Ties go to the smaller id. An empty index or batch gives no rows.
    """
    keyed = questions.select(F.col("question").cast("string").alias("question"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = settled(keyed.where("question IS NOT NULL AND embedding IS NOT NULL").dropDuplicates(["question"]))
    shape = spark.read.parquet(f"{path}/shape").first()
    stored = spark.read.schema("id BIGINT, embedding ARRAY<FLOAT>, folder INT").parquet(f"{path}/vectors")
    if whole:
        exact = semantic_topk(stored, asked, limit)
        return exact.withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity")))
    chosen = candidates(spark, path, asked, depth or default_depth(shape["rows"]))
    chosen = settled(chosen.withColumn("folder", _folder(shape["folders"])))
    used = chosen.select("folder").distinct()  # at most MOST_FOLDERS numbers
    fetched = stored.join(F.broadcast(used), "folder", "left_semi").withColumnRenamed("embedding", "vector")
    scored = chosen.join(fetched, ["folder", "id"]).join(asked, "question")
    similarity = F.round(cosine(F.col("vector"), F.col("embedding")), 12).alias("similarity")
    best = Window.partitionBy("question").orderBy(F.desc_nulls_last("similarity"), "id")
    placed = scored.select("question", "id", similarity).withColumn("place", F.row_number().over(best))
    return placed.where(F.col("place") <= limit).select("question", "place", "id", "similarity")


def bytes_read(spark: SparkSession, path: str, depth: int | None = None) -> tuple[int, int]:
    """Bytes of codes and vectors a question needs at most, and bytes of all vectors."""
    rows = spark.read.parquet(f"{path}/shape").first()["rows"]
    books = _books(spark.read.parquet(f"{path}/books"))
    vector = 4 * sum(b.shape[1] for b in books)
    return rows * len(books) + (depth or default_depth(rows)) * vector, rows * vector
