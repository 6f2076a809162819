import random

import numpy as np

from quotemill.llm import line_dedup
from quotemill.llm.queries import QUERIES

from . import brute


def plain(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in df.collect()}


def test_whole_query_equals_brute_force(spark, small, documents):
    expected = brute.cut_lines([(r.doc_id, r.text) for r in documents.collect()])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op6_line_dedup"](spark, small).collect()}
    assert got == {i: (n, d, brute.sha(k.encode())) for i, (n, d, k) in expected.items()}


def test_odd_lines(make):
    shared = "A line that many documents share"
    rows = [
        (1, f"{shared}\nown"), (2, f"  {shared.upper()} \t\nx\n{shared}"), (3, f"{shared}\r\n"), (9, f"{shared}\n{shared}"),
        (4, None), (5, ""), (6, "\n\n"), (7, "two documents hold this line"), (8, "two documents hold this line"),
        (10, "é" * 19 + "\n" + "é" * 20), (11, "é" * 19 + "\n" + "é" * 20), (12, "é" * 19 + "\n" + "É" * 20), (13, "é" * 20),
        (14, "z" * 200_000), (15, "z" * 200_000), (16, "z" * 200_000 + "\n" + "short"),
    ]
    got = line_dedup.drop_repeated(make([(*r, 1) for r in rows], "doc_id long, text string, drop int"))
    assert plain(got) == brute.cut_lines(rows)


def test_null_and_repeated_ids(make):
    line = "a line of more than twenty characters"
    rows = [(None, line)] * 3 + [(1, line)] * 2 + [(2, line)]
    dropped = lambda rows: sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.drop_repeated(make(rows, "doc_id long, text string")).collect())
    # Documents count, not rows: two hold the line; of three the largest id keeps it. Rows without id stay.
    assert dropped(rows) == [(0, 0), (0, 0), (0, 0), (1, 0), (1, 0), (2, 0)]
    assert dropped([*rows, (3, line)]) == [(0, 0), (0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 0)]


def test_empty_table(spark):
    assert line_dedup.drop_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_saturated_filter_changes_nothing(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "filter_bits", lambda rows: 1 << 10)
    rng = random.Random(3)
    lines = [f"line number {i} of all the lines" for i in range(300)]
    rows = [(i, "\n".join(rng.choices(lines, k=8))) for i in range(150)]
    assert plain(line_dedup.drop_repeated(make(rows, "doc_id long, text string"))) == brute.cut_lines(rows)


def test_the_merged_filter_misses_no_repeat(make):
    rows = [(i, f"only in document {i} and nowhere else\nin every second document {i % 2}") for i in range(64)]
    df = make(rows, "doc_id long, text string").repartition(7).selectExpr("doc_id", "CAST(text AS binary) AS text")
    found = line_dedup.twice_seen(df, 20, 1 << 20)
    repeated = [b"in every second document 0", b"in every second document 1"]
    single = [b"only in document %d and nowhere else" % i for i in range(64)]
    hit = lambda keys: line_dedup.holds(found, line_dedup.probes(line_dedup.hashes_of(keys), 1 << 20))
    assert hit(repeated).all() and np.count_nonzero(hit(single)) <= 2


def test_columns_stay(make):
    line = "a line of more than twenty characters"
    rows = [(i, f"{line}\nrest {i}", "en", 99, "k") for i in range(4)] + [(9, None, "en", 7, "k")]
    got = line_dedup.without_repeated(make(rows, "doc_id long, text string, lang string, n_chars long, key string"))
    assert got.columns == ["doc_id", "text", "lang", "n_chars", "key"]
    found = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert found == {0: ("rest 0", 6), 1: ("rest 1", 6), 2: ("rest 2", 6), 3: (f"{line}\nrest 3", 99), 9: (None, 7)}


def test_a_column_of_the_working_name(make):
    line = "a line of more than twenty characters"
    rows = [(i, f"{line}\nrest {i}", "mine") for i in range(4)]
    got = line_dedup.without_repeated(make(rows, "doc_id long, text string, _lost_lines string"))
    assert got.columns == ["doc_id", "text", "_lost_lines"]
    assert {(r.text, r._lost_lines) for r in got.collect()} == {("rest 0", "mine"), ("rest 1", "mine"), ("rest 2", "mine"), (f"{line}\nrest 3", "mine")}
