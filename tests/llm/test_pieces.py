import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from quotemill.llm import pieces
from quotemill.llm.queries import QUERIES, piece_model

from . import brute

PROTO = piece_model()
MODEL = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
SEGMENTER = pieces.Segmenter(PROTO)


def expected(text):
    ids = MODEL.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), brute.sha(np.asarray(ids, "<u4").tobytes()), brute.sha(MODEL.decode(ids).encode())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabé漢🙂."), st.characters(codec="utf-8")), max_size=60))
def test_chunks_give_the_librarys_ids(text):
    assert SEGMENTER.encode(text) == MODEL.encode(text, add_bos=True, add_eos=True)


def test_whole_query_equals_the_library(spark, small, documents):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op5_piece_ids"](spark, small).collect()}
    assert got == {r.doc_id: expected(r.text) for r in documents.collect()}


def test_odd_texts(make, spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b "), (5, "▁x ▁"), (6, "w" * 100_000), (6, "one"), (None, "two"), (7, "ab " * 30_000)]
    got = pieces.digests(pieces.encode(make([(*r, "x") for r in rows], "doc_id long, text string, ids string"), PROTO)).collect()
    assert sorted(map(str, ((r.doc_id, *r[1:]) for r in got))) == sorted(str((i, *expected(t))) for i, t in rows)
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PROTO).collect() == []


def test_many_small_blocks_and_buckets(make, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 40)
    monkeypatch.setattr(pieces, "FEWEST_BUCKETS", 60)
    monkeypatch.setattr(pieces, "MOST_REMEMBERED", 3)
    monkeypatch.setattr(pieces, "OUT_IDS", 7)
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(120)]
    got = pieces.digests(pieces.encode(make(rows, "doc_id long, text string"), PROTO)).collect()
    assert {tuple(r) for r in got} == {(i, *expected(t)) for i, t in rows}


def test_a_chunk_is_segmented_once(make):
    rows = make([(i, "a common text with common words") for i in range(50)], "doc_id long, text string")
    chunks = pieces.distinct_chunks(rows, 16).collect()
    found = [c for r in chunks for c in pieces.unpack_chunks(bytes(r.sizes), bytes(r.content))]
    assert len(found) == 5 * len({r.block for r in chunks})
    ids = pieces.segmented(pieces.distinct_chunks(rows, 16), PROTO).collect()
    by_bucket = {}
    for r in ids:
        by_bucket.setdefault(r.bucket, set()).add((bytes(r.sizes), bytes(r.ids)))
    assert sum(len(pieces.unpack_ids(*next(iter(v)))) for v in by_bucket.values()) == 5


def test_packing_round_trips():
    for items in ([], [b""], [b"a", b"", b"\0x" * 70_000]):
        assert pieces.unpack_chunks(*pieces.pack_chunks(items)) == items
    for lists in ([], [b""], [pieces.id_bytes([1, 70_000]), b"", pieces.id_bytes([31_999])]):
        assert pieces.unpack_ids(*pieces.pack_ids(lists)) == lists
    for numbers in ([], [0], [1, 255, 256, 70_000, 2**31]):
        assert pieces.unpack_numbers(pieces.pack_numbers(np.asarray(numbers, np.uint32))).tolist() == numbers


def test_a_too_large_model_is_refused(spark):
    with pytest.raises(ValueError):
        pieces.encode(spark.createDataFrame([], "doc_id long, text string"), bytes(65 << 20))


def test_texts_are_joined_in_small_batches(monkeypatch):
    monkeypatch.setattr(pieces, "OUT_IDS", 3)
    ids = [pieces.id_bytes(x) for x in ([5], [6, 7], [], [8, 9, 10])]
    parts = [(1, *pieces.pack_ids(ids[2:])), (0, *pieces.pack_ids(ids[:2]))]
    texts = [[0, 1], [], [3, 3, 3, 2], [], [1]]
    sizes, numbers = (pieces.pack_numbers(np.asarray(x, np.uint32)) for x in ([len(t) for t in texts], sum(texts, [])))
    batches = list(pieces.joined_texts(parts, sizes, numbers, SEGMENTER))
    assert len(batches) > 1 and [first for first, _ in batches] == list(np.cumsum([0, *(len(f) for _, f in batches)]))[:-1]
    joined = [b"".join([SEGMENTER.begin, *(ids[c] for c in t), SEGMENTER.end]) for t in texts]
    assert [x for _, found in batches for x in found] == joined
    assert list(pieces.joined_texts([], pieces.pack_numbers(np.zeros(2, np.uint32)), pieces.pack_numbers(np.zeros(0, np.uint32)), SEGMENTER)) == [
        (0, [SEGMENTER.begin + SEGMENTER.end] * 2)
    ]
