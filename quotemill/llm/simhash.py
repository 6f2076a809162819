"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position i carries a non-zero label m(i) of `radius + 1` bits. For each non-zero v a
table masks the bits with odd <m(i), v>. Two fingerprints that differ in at most `radius` bits
give at most `radius` linear conditions on v, so some non-zero v is orthogonal to all of their
labels: the mask of that table hides every differing bit and the pair falls into one bucket.
No pair within the radius is missed.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from quotemill.llm.common import components, saved

SEED = 42
BITS = 64
SMALL_BUCKET = 32  # larger buckets are linked through shared centres, see `_large_links`


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Majority vote, bit by bit, over the hashes of all word shingles; 0 without a word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    spans = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    count = max(1, len(words) - shingle + 1)
    digest = partial(xxh64_intdigest, seed=SEED)
    hashes = np.fromiter(map(digest, map(b" ".join, spans)), dtype="<u8", count=count)
    votes = np.zeros(BITS, dtype=np.int64)
    for start in range(0, count, 8192):
        bits = np.unpackbits(hashes[start : start + 8192, None].view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every row; a null text has no words."""

    def batches(stream):
        for batch in stream:
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks: one per non-zero vector of `radius + 1` bits."""
    codes = 2 ** (radius + 1) - 1
    labels = [1 + i % codes for i in range(BITS)]
    return [
        sum(1 << i for i, m in enumerate(labels) if (m & v).bit_count() % 2) for v in range(1, codes + 1)
    ]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of "distinct `fp` at most `radius` bits apart"."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    tables = [
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bucket"))
        for t, m in enumerate(masks(radius))
    ]
    keys = prints.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.t", "k.bucket")
    # Stored before the join, which adaptive execution can then split where a bucket is hot.
    sizes = saved(keys.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    held = keys.join(sizes, ["t", "bucket"])
    return (
        _small_links(held.where(F.col("n") <= SMALL_BUCKET), radius)
        .unionByName(_large_links(held.where(F.col("n") > SMALL_BUCKET), radius))
        .where("a <> b")
        .distinct()
    )


def _small_links(held: DataFrame, radius: int) -> DataFrame:
    """Check every pair of a bucket of at most SMALL_BUCKET fingerprints."""
    close = lambda x, ys: F.filter(ys, lambda y: F.bit_count(x.bitwiseXOR(y)) <= radius)
    pairs = F.flatten(
        F.transform(
            "fps",
            lambda x, i: F.transform(
                close(x, F.slice("fps", i + F.lit(2), F.size("fps"))),
                lambda y: F.struct(x.alias("a"), y.alias("b")),
            ),
        )
    )
    buckets = held.groupBy("t", "bucket").agg(F.collect_list("fp").alias("fps"))
    return buckets.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _large_links(held: DataFrame, radius: int) -> DataFrame:
    """Link a large bucket without pairing its members.

    Two fingerprints at most 2 bits apart share a centre at most 1 bit from both, and two that
    share such a centre are at most 2 bits apart. The differing bits are among those the mask
    hides, so each member names itself and its flips of hidden bits as centres, and is linked to
    the smallest member of each centre. With radius 1 the centre itself must be a member.
    """
    hidden = [[b for b in range(BITS) if not m >> b & 1] for m in masks(radius)]
    flips = F.array(*[F.array(*[F.lit(0), *[F.lit(signed(1 << b)) for b in bits]]) for bits in hidden])
    named = held.select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")
    ).distinct()
    own = F.max(F.when(F.col("fp") == F.col("centre"), F.col("fp")))
    root = F.min("fp") if radius == 2 else own
    met = named.groupBy("centre").agg(F.count("*").alias("n"), root.alias("root"))
    met = saved(met.where("n > 1 AND root IS NOT NULL").select("centre", "root"), "simhash-centres")
    return named.join(met, "centre").select(F.col("fp").alias("a"), F.col("root").alias("b"))


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, fp (signed), component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a
    shingle is one shingle; a null or wordless text has fingerprint 0 and links like any other.
    component_id is the smallest doc_id reachable over links of at most `radius` bits. Rows that
    repeat a doc_id are rows of their own; a null doc_id gets the component of its fingerprint,
    and null if no row of the component has an id. Other columns are ignored.
    """
    prints = saved(fingerprints(docs, shingle, key, text), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """`docs` without those whose group holds a smaller doc_id; all columns as they were.

    Rows that share a doc_id stay or go together; rows with a null doc_id stay.
    """
    classes = near_duplicates(docs, shingle, radius)
    gone = saved(classes.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone")
    return docs.join(gone, "doc_id", "left_anti")
