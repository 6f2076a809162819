"""Drop lines that many documents share, found with two Bloom filters.

Pass 1: each task puts the key of every line into a "once seen" filter, or into a "twice seen"
filter if the first already holds it. The filters are merged in a tree, segment by segment: bits
two "once" filters share go to "twice". Pass 2: only lines whose key the merged "twice" filter
holds are shuffled; exact counts confirm them. The filter has no false negatives, so it only
decides how much is shuffled, never the result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from quotemill.llm.common import saved

PROBES = 3
SEGMENT = 1 << 16  # bytes of a filter that travel as one row
LEAVES = 64  # groups of the first merging level
BITS_PER_ROW = 64  # filter bits per document
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 28  # bounds of a filter: 128 KiB and 32 MiB


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, None if it has fewer than `least` code points."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < least:
        return None
    if len(key) < 4 * least and sum((b & 0xC0) != 0x80 for b in key) < least:
        return None
    return key


def keys_of(text: bytes | None, least: int) -> set[bytes]:
    """The distinct keys of a text."""
    found = {line_key(line, least) for line in text.split(b"\n")} if text else set()
    found.discard(None)
    return found


def hashes_of(keys) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions per hash; `bits` is a power of two."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(1, PROBES + 1, dtype=np.uint64)[:, None]
    return ((low + steps * high + steps * steps) & np.uint64(bits - 1)).astype(np.int64)


def holds(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def put(filter_: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filter_, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def filter_bits(rows: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, 1 << ceil(log2(max(1, rows * BITS_PER_ROW)))))


def twice_seen(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The merged "twice seen" filter over the lines of all rows of (doc_id, text)."""
    schema = "part int, segment int, once binary, twice binary"
    names = ["part", "segment", "once", "twice"]

    def packed(part: int, segment: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
        squeeze = lambda x: zlib.compress(x.tobytes(), 1)
        values = [[part], [segment], [squeeze(once)], [squeeze(twice)]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    def fill(stream):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                met: Counter = Counter()
                for text in batch.column(0).slice(start, 512).to_pylist():
                    met.update(keys_of(text, least))
                if met:
                    at = probes(hashes_of(met), bits)
                    many = np.fromiter(met.values(), np.int64, len(met)) > 1
                    put(twice, at[:, many | holds(once, at)])
                    put(once, at)
        for segment, start in enumerate(range(0, bits // 8, SEGMENT)):
            a, b = once[start : start + SEGMENT], twice[start : start + SEGMENT]
            if a.any():
                yield packed(part % LEAVES, segment, a, b)

    def merge(keys, stream):
        once = twice = None
        for batch in stream:
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(zlib.decompress(batch[c][i].as_py()), np.uint8) for c in ("once", "twice"))
                if once is None:
                    once, twice = a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        yield packed(0, keys[-1].as_py(), once, twice)

    merge.__annotations__ = {
        "keys": tuple[pa.Scalar, ...], "stream": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch],
    }
    tables = docs.select("text").mapInArrow(fill, schema)
    leaves = tables.groupBy("part", "segment").applyInArrow(merge, schema)
    roots = leaves.groupBy("segment").applyInArrow(merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in roots.select("segment", "twice").toLocalIterator():
        found = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
        out[row.segment * SEGMENT : row.segment * SEGMENT + len(found)] = found
    return out


def suspects(docs: DataFrame, filter_: np.ndarray, least: int) -> DataFrame:
    """(doc_id, key): the distinct keys of each row of (doc_id, text) that the filter holds."""
    bits = len(filter_) * 8
    shared = docs.sparkSession.sparkContext.broadcast(filter_.tobytes())

    def pick(stream):
        held = np.frombuffer(shared.value, np.uint8)
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                owners, keys = [], []
                for owner, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = keys_of(text, least)
                    owners.extend([owner] * len(found))
                    keys.extend(found)
                if keys:
                    hit = pa.array(holds(held, probes(hashes_of(keys), bits)))
                    columns = [pa.array(owners, pa.int64()).filter(hit), pa.array(keys, pa.binary()).filter(hit)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key"])

    return docs.mapInArrow(pick, "doc_id long, key binary")


def repeated_lines(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, drop array<binary>): the line keys each document loses.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at
    least `least_chars` code points in at least `least_docs` rows is kept in the rows of the
    largest doc_id that has it and dropped in all others. A key counts once per row. Rows with a
    null doc_id neither count nor lose lines; rows that repeat a doc_id count one by one and share
    what they lose.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    filter_ = twice_seen(rows, least_chars, filter_bits(docs.count()))
    found = saved(suspects(rows, filter_, least_chars), "lines")
    confirmed = (
        found.groupBy("key")
        .agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= least_docs)
    )
    # A table of its own: a key in very many documents is then a skewed join, which adaptive
    # execution splits; right after the aggregation it could not.
    lost = found.join(saved(confirmed, "lines-shared"), "key").where("doc_id <> keeper")
    return saved(lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop")), "lines-lost")


def _cut(text: bytes | None, drop, least: int) -> tuple[bytes, int, int]:
    lines = (text or b"").split(b"\n")
    if drop is None:
        return text or b"", len(lines), 0
    gone = set(drop)
    kept = [line for line in lines if line_key(line, least) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def drop_repeated(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, kept (string), n_lines, n_dropped.

    Texts are cut at \\n; a null or empty text is one empty line. Kept lines stay as they are,
    joined by \\n. See `repeated_lines` for the rule. Other columns are ignored.
    """
    lost = repeated_lines(docs, least_chars, least_docs, key, text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def cut(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                columns = [part.column(i).to_pylist() for i in (1, 2)]
                done = [_cut(t, d, least_chars) for t, d in zip(*columns)]
                kept, lines, dropped = zip(*done) if done else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.array(lines, pa.int64()),
                        pa.array(dropped, pa.int64()),
                    ],
                    ["doc_id", "kept", "n_lines", "n_dropped"],
                )

    joined = rows.join(lost, "doc_id", "left").select("doc_id", "text", "drop")
    return joined.mapInArrow(cut, "doc_id long, kept string, n_lines long, n_dropped long")


def without_repeated(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """`docs` (doc_id, text, n_chars, ...) with repeated lines cut out of `text`.

    n_chars follows the new text where the column exists; a null text stays null. All other
    columns are as they were.
    """
    column = "_lost_lines"
    while column in docs.columns:
        column += "_"
    lost = repeated_lines(docs, least_chars, least_docs).withColumnRenamed("drop", column)

    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        return pa.array([_cut(t, d, least_chars)[0] for t, d in zip(texts.to_pylist(), drops.to_pylist())], pa.binary())

    cut.__annotations__ = {"texts": pa.Array, "drops": pa.Array, "return": pa.Array}
    shorter = F.arrow_udf(cut, "binary")(F.col("text").cast("binary"), F.col(column)).cast("string")
    joined = docs.join(lost, "doc_id", "left")
    out = joined.withColumn("text", F.when(F.col(column).isNull(), F.col("text")).otherwise(shorter))
    if "n_chars" in docs.columns:
        count = F.when(F.col(column).isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
