import json
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quotemill.llm import bpe_tree
from quotemill.llm.queries import QUERIES, word_tokenizer

from . import brute

RULES = word_tokenizer()
LIBRARY = Tokenizer.from_str(RULES)
ENCODER = bpe_tree.TreeEncoder(RULES)
SIGNS = "aab '.!tsrelvmd<|>09ÀéİΣ漢🙂é\n\tſ"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def expected(text):
    ids = ids_of(text)
    return len(ids), brute.sha(np.asarray(ids, "<u4").tobytes()), brute.sha(LIBRARY.decode(ids, skip_special_tokens=False).encode())


@settings(max_examples=400, deadline=None)
@given(
    st.text(alphabet=st.one_of(st.sampled_from(SIGNS), st.characters(codec="utf-8")), max_size=150),
    st.sampled_from([1, 2, 3, 7, 30]), st.sampled_from([1, 4, 64]), st.sampled_from([4, 8, 32]),
)
def test_joined_leaves_give_the_librarys_ids(text, leaf, reach, run):
    before = bpe_tree.LEAF, bpe_tree.FIRST_REACH, bpe_tree.LONG_RUN
    bpe_tree.LEAF, bpe_tree.FIRST_REACH, bpe_tree.LONG_RUN = leaf, reach, run
    try:
        assert ENCODER.encode([text])[0].tolist() == ids_of(text)
    finally:
        bpe_tree.LEAF, bpe_tree.FIRST_REACH, bpe_tree.LONG_RUN = before


@pytest.mark.parametrize("signs", ["ab", "a", "'", "!'", "thequickbrownfox", "é漢", "'s ", "ab'"])
def test_long_runs_are_joined_by_tokens(signs, monkeypatch):
    rng = random.Random(signs)
    for leaf in (37, 64, 500):
        monkeypatch.setattr(bpe_tree, "LEAF", leaf)
        text = "".join(rng.choice(signs) for _ in range(3000))
        for whole in (text, f"x {text} y", f"!!{text}s<|endoftext|>{text}"):
            assert ENCODER.encode([whole])[0].tolist() == ids_of(whole)


def test_windows_stay_small_in_one_long_word(monkeypatch):
    """A join inside a word encodes a window, not the word again."""
    rng = random.Random(3)
    text = "".join(rng.choice("thequickbrownfoxjumpsoverlazydog") for _ in range(200_000))
    seen = []
    tokenized = ENCODER.inner.tokenize

    class Counting:
        def tokenize(self, window):
            seen.append(len(window))
            return tokenized(window)

    monkeypatch.setattr(ENCODER, "inner", Counting())
    assert ENCODER.encode([text])[0].tolist() == ids_of(text)
    assert len(seen) >= 200_000 // bpe_tree.LEAF and sum(seen) < 20_000


def test_whole_query_equals_the_library(spark, small, documents):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_bpe_ids"](spark, small).collect()}
    assert got == {r.doc_id: expected(r.text) for r in documents.collect()}


def test_odd_texts(make, spark):
    rng = random.Random(5)
    words = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(5000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "A  b "), (5, "<|endoftext|>"), (6, "w" * 30_000), (6, "one"), (6, "one"),
        (None, "two"), (7, "İ<|startoftext|> x" * 400), (12, "a\x85B\xa0C\x1cD \u2028 É"), (8, words), (9, words * 50),
        (10, ("ab" * 200_000 + "<|endoftext|>") * 3), (11, "é!" * 300_000), (None, " " * 1_100_000),
    ]
    got = bpe_tree.digests(bpe_tree.encode(make([(*r, "x") for r in rows], "doc_id long, text string, ids string"), RULES)).collect()
    assert sorted(map(str, ((r.doc_id, *r[1:]) for r in got))) == sorted(str((i, *expected(t))) for i, t in rows)
    assert bpe_tree.encode(spark.createDataFrame([], "doc_id long, text string"), RULES).collect() == []


def test_stretches_of_a_text_meet_again(make, monkeypatch):
    monkeypatch.setattr(bpe_tree, "SPREAD", 50)
    monkeypatch.setattr(bpe_tree, "STRETCH", 16)
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(SIGNS if i % 2 else "ab'") for _ in range(rng.randint(0, 300)))) for i in range(60)]
    rows += [(60, "<|endoftext|>" * 9), (61, " " * 99)]
    got = bpe_tree.digests(bpe_tree.encode(make(rows, "doc_id long, text string"), RULES)).collect()
    assert {tuple(r) for r in got} == {(i, *expected(t)) for i, t in rows}


def test_other_tokenizers_are_refused():
    rules = json.loads(RULES)
    merges = rules["model"]["merges"]
    for change in (
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"truncation": {"max_length": 5}},
        {"added_tokens": [rules["added_tokens"][0] | {"lstrip": True}]},
        {"model": rules["model"] | {"dropout": 0.1}},
        {"model": rules["model"] | {"merges": merges[::-1]}},
        {"model": rules["model"] | {"merges": [*merges, merges[5]]}},
    ):
        with pytest.raises(ValueError):
            bpe_tree.check_settings(json.dumps(rules | change))
