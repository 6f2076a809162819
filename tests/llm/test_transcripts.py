import itertools
from zlib import crc32

import numpy as np
import pytest

from quotemill.llm import transcripts as tr
from quotemill.llm.queries import QUERIES


def model(seed=0):
    rng = np.random.default_rng(seed)
    counts = {("move", a, b): int(rng.integers(0, 30)) for a in range(tr.STATES) for b in range(tr.STATES)}
    counts |= {("start", a, 0): int(rng.integers(0, 30)) for a in range(0, tr.STATES, 2)}
    counts |= {(str(i), s, v): int(rng.integers(0, 30)) for i, n in enumerate(tr.SIZES) for s in range(tr.STATES) for v in range(n)}
    return tr.Model.from_counts(counts)


def best_score(m, seen):
    """Brute force: the score of the best state sequence."""
    emitted = m.scores(seen)
    best = -np.inf
    for path in itertools.product(range(tr.STATES), repeat=len(seen)):
        score = m.start[path[0]] + emitted[0, path[0]]
        score += sum(m.move[a, b] + emitted[i, b] for i, (a, b) in enumerate(itertools.pairwise(path), 1))
        best = max(best, score)
    return best


def path_score(m, seen, path):
    emitted = m.scores(seen)
    return m.start[path[0]] + emitted[0, path[0]] + sum(m.move[a, b] + emitted[i, b] for i, (a, b) in enumerate(itertools.pairwise(path), 1))


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    m = model(seed)
    seen = np.column_stack([rng.integers(0, n, 5) for n in tr.SIZES])
    ends = m.matrix(seen)[-1]
    path = m.decode(seen, tr.STATES, int(ends.argmax()))
    assert np.isclose(ends.max(), best_score(m, seen)) and np.isclose(path_score(m, seen, path), best_score(m, seen))


def test_pieces_and_tree_equal_one_viterbi(make, monkeypatch):
    """Small segments force a tree of several levels; the scores must be those of one pass."""
    m = model(7)
    rng = np.random.default_rng(7)
    lines = [(p, rng.choice(["User: hi", "AI: well", "and so on", "is it?", "", "System: be kind", "x" * 400])) for p in range(300)]
    seen = np.asarray([tr.observe(str(t), True)[0] for _, t in lines])
    whole = m.matrix(seen)[-1]
    monkeypatch.setattr(tr, "SEGMENT", 4)
    rows = [(1, p, str(t)) for p, t in lines] + [(2, 5, "AI: hello")]
    got = tr.parse(make(rows, "conv_id long, pos long, text string"), m).collect()
    pieces = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.seg, r.n))
    path = []
    for r in pieces:
        role = 2 * tr.ROLES.index(r.role)
        path += [role + 1 if r.continued or i else role for i in range(len(r.text.split("\n")))]
    assert len(path) == 300
    assert np.isclose(path_score(m, seen, path), whole.max())


def test_whole_query_recovers_the_roles(spark, small):
    folder = "/root/testdata/sf0.01"
    truth, asides = {}, 0
    plain = tr.defaced(spark.read.parquet(f"{folder}/conversations.parquet"))
    for r in plain.orderBy("conv_id", "pos").collect():
        truth.setdefault(r.conv_id, []).append((r.role, r.said))
        asides += r.said.split("\n")[-1] in tr.ASIDES
    found = {}
    for r in sorted(QUERIES["op8_chat_formatting"](spark, folder).collect(), key=lambda r: (r.conv_id, r.seg, r.n)):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.rendered == ("" if r.continued else f"<|{r.role}|>\n") + r.text
    assert found.keys() == truth.keys() and asides > 50
    # Scored on the conversations the model did not learn from.
    held = [c for c in truth if crc32(str(c).encode()) % 5 == 0]
    assert len(held) >= 15 and sum(found[c] == truth[c] for c in held) >= 0.9 * len(held)
    assert sum(found[c] == truth[c] for c in truth) >= 0.9 * len(truth)


@pytest.fixture(scope="module")
def learned(spark):
    return tr.learn(tr.defaced(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))


def test_marker_like_lines_inside_a_turn_stay(make, learned):
    """The answers are options of one question; only what opens a block begins a turn."""
    rows = [
        (1, 0, "User: Which city is it?\nQ: warm-up\nA: Paris\nContext: Europe"), (1, 1, "Assistant: It is Paris.\nAnswer: 42"), (1, 2, "User: Thanks."),
        (1, 3, "Assistant: You are welcome."),
    ]
    got = sorted(tr.parse(make(rows, "conv_id long, pos long, text string"), learned).collect(), key=lambda r: (r.seg, r.n))
    assert [(r.role, r.text) for r in got] == [
        ("user", "Which city is it?\nQ: warm-up\nA: Paris\nContext: Europe"), ("assistant", "It is Paris.\nAnswer: 42"), ("user", "Thanks."),
        ("assistant", "You are welcome."),
    ]


def test_odd_rows(make, spark, learned):
    rows = [
        (1, 0, "User: hi\nmore", "k"), (1, 0, "User: hi\nmore", "k"), (1, 1, "AI: yes", "k"), (2, None, None, "k"), (3, 4, "", "k"),
        (None, 1, "User: x", "k"), (4, -70, "User: a?", "k"), (4, 500, "Assistant: b", "k"), (5, 1, "User: " + "word\n" * 20_000, "k"),
    ]
    got = tr.parse(make(rows, "conv_id long, pos long, text string, role string"), learned).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.seg, r.n)):
        found.setdefault(r.conv_id, []).append(r.text)
    assert found.keys() == {1, 2, 3, 4, 5}
    assert "\n".join(found[1]) == "hi\nmore\nyes" and found[2] == [""] and "\n".join(found[4]) == "a?\nb"
    assert "\n".join(found[5]) == "word\n" * 20_000
    empty = spark.createDataFrame([], "conv_id long, pos long, text string, role string")
    assert tr.parse(empty, tr.learn(empty)).collect() == []


@pytest.mark.parametrize("line, role, rest", [("User: a", "user", "a"), ("  **AI**: b", "assistant", "b"), ("### system: c", "system", "c"), ("Q: d", "user", "d"), ("Useful: e", None, "Useful: e"), ("", None, "")])
def test_markers(line, role, rest):
    features, text = tr.observe(line, True)
    assert text == rest and features[0] == (0 if role is None else 1 + tr.ROLES.index(role))


def test_blocks_without_a_position_fill_segments(make, learned, monkeypatch):
    monkeypatch.setattr(tr, "SEGMENT", 4)
    rows = [(1, None, f"User: line {i:03}") for i in range(50)] + [(1, 3, "Assistant: done"), (2, 7, "User: x"), (2, None, "User: a")]
    df = make(rows, "conv_id long, pos long, text string")
    sizes = tr.blocks(df).groupBy("conv_id", "seg").count().collect()
    assert max(r["count"] for r in sizes) <= 4 and min(r.seg for r in sizes) == 0
    found = {}
    for r in sorted(tr.parse(df, learned).collect(), key=lambda r: (r.conv_id, r.seg, r.n)):
        found.setdefault(r.conv_id, []).append(r.text)
    lines = lambda c: "\n".join(found[c]).replace("User: ", "").split("\n")
    assert lines(1) == [f"line {i:03}" for i in range(50)] + ["done"] and lines(2) == ["a", "x"]
