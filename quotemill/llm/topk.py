"""Exact top-k search by inner product: tiles of queries and shards, merged as a tree.

Candidates fall into shards and queries into blocks, both of bounded size. Every (shard, block)
tile is one task group: a matrix product, then a partial selection per query. The lists of a
query are merged FAN shards at a time until one list is left.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SHARD_ROWS = 4096  # at least
TILE_BYTES = 8 << 20  # of the vectors of a shard or a block in double precision, at most
SHARDS = 64  # a small table is cut into no more than so many shards
FAN = 16
EXACT = 2**53  # products below this bound are exact in double precision


def quantised(vector: str = "embedding", scale: int = 1024):
    """Each component x as floor(scale * x) in double precision, as a 64-bit integer."""
    top = float(2**62)
    each = lambda x: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), x.cast("double") * scale)))
    return F.transform(F.col(vector), each).cast("array<long>")


def usable(vector: str = "embedding"):
    """False for a null vector and for one with a null, NaN or infinite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(F.col(vector), finite), F.lit(False))


def scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; exact, and kept within 64 bits where they would overflow."""
    if not queries.size or not shard.size:
        return np.zeros((len(queries), len(shard)), np.int64)
    largest = int(np.abs(queries.astype(np.float64)).max()) * int(np.abs(shard.astype(np.float64)).max())
    if largest * queries.shape[1] < EXACT:
        return (queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ shard.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, best first."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        kept = np.flatnonzero(score >= edge)
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], ~score[kept]))][:k]  # ~ reverses the order without overflow


def search(
    candidates: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of (vec_id, vector array<long>) per query.

    A query never meets rows with its own vec_id. Vectors of different lengths do not meet. Ties
    go to the smaller vec_id. Rows that repeat a vec_id are candidates of their own; repeated query
    rows count as one if vector and id agree. Null ids and null vectors take no part.
    """
    known = "vec_id IS NOT NULL AND vector IS NOT NULL"
    rows, asked = candidates.where(known), queries.where(known).dropDuplicates(["vec_id", "vector"])
    count, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    # Large tiles: a vector is copied once per tile of the other side.
    most = max(256, TILE_BYTES // (8 * max(1, width or 1)))
    shard_rows = shard_rows or min(most, max(SHARD_ROWS, count // SHARDS))
    block_rows = block_rows or most
    shards = max(1, ceil(count / shard_rows))
    blocks = max(1, ceil(queries.count() / block_rows))
    spread = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["d", "shard", "block"]
    content = [F.col("vec_id").alias("name"), F.col("vector").alias("row")]
    left = rows.select(F.size("vector").alias("d"), spread(shards, 1).alias("shard"), every(blocks).alias("block"), *content)
    right = asked.select(F.size("vector").alias("d"), every(shards).alias("shard"), spread(blocks, 2).alias("block"), *content)

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table["name"].to_numpy()
        vectors = table["row"].combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, flat.reshape(len(ids), flat.size // max(1, len(ids)))

    def tile(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if shard.num_rows and block.num_rows:
            (ids, vectors), (names, asked) = matrix(shard), matrix(block)
            number = shard["shard"][0].as_py()
            for start in range(0, len(names), 128):
                for name, row in zip(names[start : start + 128], scores(asked[start : start + 128], vectors)):
                    others = np.flatnonzero(ids != name)
                    if len(others):
                        top = others[best(row[others], ids[others], k)]
                        for column, values in zip(out, ([name] * len(top), [number] * len(top), ids[top], row[top])):
                            column.extend(values)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["query_id", "part", "vec_id", "score"])

    tile.__annotations__ = {"shard": pa.Table, "block": pa.Table, "return": pa.Table}
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        tile, "query_id long, part int, vec_id long, score long"
    )
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN:
        shards = ceil(shards / FAN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        ranked = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))
        lists = lists.withColumn("rank", ranked).where(F.col("rank") <= k).drop("rank")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    lists = lists.withColumn("rank", ranked).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")
