"""SentencePiece ids by a table of distinct marked words.

The library turns each space into the marker U+2581, puts one in front, and merges symbols into
pieces. When no piece holds a marker after another character, no merge crosses the place before
a marker that follows another character: the text falls into chunks (markers, then the rest)
whose segmentations are independent.

Texts are read in blocks. Each block sends its distinct chunks, by hash bucket, to the table of
all distinct chunks, where a chunk is segmented once; the ids come back to the block and are
joined by position, a bounded batch of texts at a time. A block sends its texts as chunk
numbers, so no text is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
CROSSING = re.compile(f"[^{MARK}]{MARK}")
BLOCK_CHARS = 12_000_000  # a block ends with the text that reaches this size
FEWEST_BUCKETS = 16
DOCS_ROOT_PER_BUCKET = 8  # buckets follow the root of the documents, as distinct words do
MOST_REMEMBERED = 1_000_000  # chunks of a bucket whose ids a task holds at a time
OUT_IDS = 1 << 18  # ids of one batch of joined texts


def chunks_of(text: str | None) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


def id_list(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<u4").tolist()


class Segmenter:
    """The library's ids of single chunks."""

    def __init__(self, proto: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.begin = id_bytes([self.model.bos_id()])
        self.end = id_bytes([self.model.eos_id()])
        self.mark = id_bytes([self.model.piece_to_id(MARK)])

    def ids(self, chunks: list[str]) -> list[bytes]:
        # The library adds the first marker itself, so it gets the chunk without it.
        found = self.model.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1) if chunks else []
        return [self.mark if c == MARK else id_bytes(ids) for c, ids in zip(chunks, found)]

    def encode(self, text: str) -> list[int]:
        """Begin id, the ids of the chunks in their order, end id."""
        return id_list(b"".join([self.begin, *self.ids(chunks_of(text)), self.end]))


def check_model(proto: bytes) -> None:
    """Raise ValueError unless chunks are independent under this model."""
    segmenter = Segmenter(proto)
    model = segmenter.model
    if any(CROSSING.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("a piece crosses a white space marker")
    probe = "  a  b c d\n  ① "
    if segmenter.encode(probe) != model.encode(probe, add_bos=True, add_eos=True):
        raise ValueError("the model's normalisation does not leave marked words apart")


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, byte by byte: the high bytes of small numbers are all alike."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    starts = [0, *np.cumsum(sizes, dtype=np.int64).tolist()]
    return [data[a:b] for a, b in zip(starts, starts[1:])]


def pack_chunks(chunks: list[bytes]) -> tuple[bytes, bytes]:
    """The sizes and the content of byte strings, compressed."""
    return pack_numbers(np.asarray([len(c) for c in chunks], np.uint32)), zlib.compress(b"".join(chunks), 1)


def unpack_chunks(sizes: bytes, content: bytes) -> list[bytes]:
    return cut(zlib.decompress(content), unpack_numbers(sizes))


def pack_ids(lists: list[bytes]) -> tuple[bytes, bytes]:
    """The sizes and the numbers of lists of ids, compressed."""
    return pack_numbers(np.asarray([len(x) for x in lists], np.uint32)), pack_numbers(np.frombuffer(b"".join(lists), "<u4"))


def unpack_ids(sizes: bytes, numbers: bytes) -> list[bytes]:
    return cut(unpack_numbers(numbers).tobytes(), unpack_numbers(sizes))


class Block:
    """Texts as numbers of their chunks; chunks are numbered by (bucket, first occurrence)."""

    def __init__(self):
        self.owners: list[int | None] = []
        self.sizes: list[int] = []
        self.places: list[np.ndarray] = []
        self.index: dict[str, int] = {}
        self.chars = 0

    def add(self, owner: int | None, text: str | None) -> None:
        chunks, index = chunks_of(text), self.index
        for chunk in chunks:
            if chunk not in index:
                index[chunk] = len(index)
        self.owners.append(owner)
        self.sizes.append(len(chunks))
        self.places.append(np.fromiter(map(index.__getitem__, chunks), np.uint32, len(chunks)))
        self.chars += len(text or "") + 1

    def numbered(self, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
        """The chunks in order of their numbers, their buckets, the texts' numbers, a checksum."""
        chunks = [c.encode() for c in self.index]
        bucket = np.fromiter((xxh32_intdigest(c) % buckets for c in chunks), np.int64, len(chunks))
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(chunks), np.uint32)
        number[order] = np.arange(len(chunks), dtype=np.uint32)
        ordered = [chunks[i] for i in order.tolist()]
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        check = xxh64_intdigest(b"\0".join(ordered)) >> 1
        return ordered, bucket[order], number[places], check


def blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """The blocks of a task with their numbers."""
    from pyspark import TaskContext

    number, block = TaskContext.get().partitionId() << 32, Block()
    for batch in stream:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for owner, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                block.add(owner, text)
                if block.chars >= BLOCK_CHARS:
                    yield number, block
                    number, block = number + 1, Block()
    if block.owners:
        yield number, block


def distinct_chunks(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, sum, sizes, content): the distinct chunks of every block, one row per bucket."""

    def run(stream):
        for number, block in blocks(stream):
            chunks, bucket, _, check = block.numbered(buckets)
            found, starts = np.unique(bucket, return_index=True)
            ends = [*starts[1:].tolist(), len(chunks)]
            sizes, content = zip(*[pack_chunks(chunks[a:b]) for a, b in zip(starts.tolist(), ends)]) if len(found) else ((), ())
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(found, pa.int32()),
                    "block": pa.array([number] * len(found), pa.int64()),
                    "sum": pa.array([check] * len(found), pa.int64()),
                    "sizes": pa.array(sizes, pa.binary()),
                    "content": pa.array(content, pa.binary()),
                }
            )

    return rows.mapInArrow(run, "bucket int, block long, sum long, sizes binary, content binary")


def segmented(chunks: DataFrame, proto: bytes) -> DataFrame:
    """(block, sum, bucket, sizes, ids) for `distinct_chunks`: each chunk of a bucket is segmented once.

    A bucket of more than MOST_REMEMBERED distinct chunks forgets what it has and goes on, so its
    memory is bounded; a chunk met again is then segmented again.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, table = Segmenter(proto), {}
        for batch in stream:
            for i in range(batch.num_rows):
                mine = unpack_chunks(batch.column("sizes")[i].as_py(), batch.column("content")[i].as_py())
                if len(table) > MOST_REMEMBERED:
                    table = {}
                new = [c for c in mine if c not in table]
                table.update(zip(new, segmenter.ids([c.decode() for c in new])))
                row = batch.slice(i, 1)
                packed = [pa.array([x], pa.binary()) for x in pack_ids([table[c] for c in mine])]
                columns = [row.column("block"), row.column("sum"), row.column("bucket"), *packed]
                yield pa.RecordBatch.from_arrays(columns, ["block", "sum", "bucket", "sizes", "ids"])

    run.__annotations__ = {"stream": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return chunks.groupBy("bucket").applyInArrow(run, "block long, sum long, bucket int, sizes binary, ids binary")


def numbered_texts(rows: DataFrame, buckets: int) -> DataFrame:
    """(block, sum, bucket -1, sizes, ids, owners): the texts of every block as chunk numbers in `ids`, one row each."""

    def run(stream):
        for number, block in blocks(stream):
            _, _, places, check = block.numbered(buckets)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "sum": pa.array([check], pa.int64()),
                    "bucket": pa.array([-1], pa.int32()),
                    "sizes": pa.array([pack_numbers(np.asarray(block.sizes, np.uint32))], pa.binary()),
                    "ids": pa.array([pack_numbers(places)], pa.binary()),
                    "owners": pa.array([block.owners], pa.list_(pa.int64())),
                }
            )

    return rows.mapInArrow(run, "block long, sum long, bucket int, sizes binary, ids binary, owners array<long>")


def gathered(starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The ids of the chunks `places` one after the other; chunk c has ids[starts[c] : starts[c] + sizes[c]]."""
    lengths = sizes[places]
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    return ids[np.repeat(starts[places], lengths) + within]


def joined_texts(parts: list[tuple[int, bytes, bytes]], text_sizes: bytes, numbers: bytes, segmenter: Segmenter):
    """Batches of (first text, ids of each text): the parts' ids in the order of the texts' chunk numbers."""
    unpacked = [(unpack_numbers(s) // 4, unpack_numbers(i)) for _, s, i in sorted(parts)]
    sizes = np.concatenate([s for s, _ in unpacked]).astype(np.int64) if unpacked else np.zeros(0, np.int64)
    ids = np.concatenate([i for _, i in unpacked]) if unpacked else np.zeros(0, np.uint32)
    starts, places = np.cumsum(sizes) - sizes, unpack_numbers(numbers)
    ends = np.cumsum(unpack_numbers(text_sizes), dtype=np.int64)
    text, begun = 0, 0
    while text < len(ends):
        # The texts up to about OUT_IDS chunks, one at least.
        last = max(text + 1, int(np.searchsorted(ends, begun + OUT_IDS, "right")))
        held = places[begun : ends[last - 1]]
        flat = gathered(starts, sizes, ids, held).astype("<u4")
        edges = np.concatenate([[0], np.cumsum(sizes[held])])[np.concatenate([[begun], ends[text:last]]) - begun]
        pairs = zip(edges.tolist(), edges[1:].tolist())
        yield text, [b"".join([segmenter.begin, flat[a:b].tobytes(), segmenter.end]) for a, b in pairs]
        text, begun = last, int(ends[last - 1])


def encode(docs: DataFrame, proto: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, ids (binary), decoded (string).

    `proto` is the model file's content (checked to be below 64 MB, as it travels with the job).
    `ids` are little-endian unsigned 32-bit ids of the whole text with begin and end ids; a null
    or empty text gives just these two. Repeated rows and null keys are rows like any other;
    other columns are ignored.

    `docs` is read twice and must give the same rows in the same order, as a stored table does;
    a checksum per block turns a difference into an error.
    """
    if len(proto) > 64 << 20:
        raise ValueError("the model is too large to travel with the job")
    check_model(proto)
    buckets = max(FEWEST_BUCKETS, isqrt(docs.count()) // DOCS_ROOT_PER_BUCKET)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def join(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, parts, texts, sums = Segmenter(proto), [], [], set()
        for batch in stream:
            for row in batch.to_pylist():
                sums.add(row["sum"])
                packed = (row["bucket"], row["sizes"], row["ids"])
                (texts if row["bucket"] < 0 else parts).append((*packed, row["owners"]) if row["bucket"] < 0 else packed)
        if len(texts) != 1 or len(sums) != 1:
            raise RuntimeError("the texts changed between two reads; store them first")
        _, sizes, numbers, owners = texts.pop()
        for first, found in joined_texts(parts, sizes, numbers, segmenter):
            decoded = [segmenter.model.decode(id_list(ids)) for ids in found]
            names = pa.array(owners[first : first + len(found)], pa.int64())
            columns = [names, pa.array(found, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    join.__annotations__ = {"stream": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = segmented(distinct_chunks(rows, buckets), proto).withColumn("owners", F.lit(None).cast("array<long>"))
    both = numbered_texts(rows, buckets).unionByName(parts)
    return both.groupBy("block").applyInArrow(join, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `encode`'s rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
