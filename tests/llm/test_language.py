import numpy as np
from zlib import crc32

from quotemill.llm import language
from quotemill.llm.queries import QUERIES


def test_held_out_accuracy(spark, documents):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_language_id"](spark, folder).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_filter_returns_all_languages_of_an_ngram():
    words = {"a": "alpha beta", "b": "beta gamma", "c": "delta"}
    names = list(words)
    model = language.LanguageFilter.build(names, {n: np.unique(language.grams(t)) for n, t in words.items()})
    assert model.shares("beta")[:2].min() == 1.0 and model.shares("beta")[2] < 0.5
    for name, text in words.items():
        assert model.predict(text)[0] == name or model.shares(text).max() == 1.0
    assert model.predict("delta") == ("c", 1.0)


def test_false_positives_are_corrected():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2**63, 4000).astype(np.uint64)
    model = language.LanguageFilter(["x"], np.zeros(2048, np.uint64))
    for at in language.places(grams[:600], 2048):
        model.table[at] |= np.uint64(1)
    model = language.LanguageFilter(["x"], model.table)
    assert 0.05 < model.false_rate[0] < 0.6
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(3000))
    assert model.shares(text)[0] < 0.05


def test_odd_texts(make, spark):
    rows = [(1, "le chat et la souris " * 20, "fr"), (2, "the cat and the mouse " * 20, "en"), (3, "the dog and the house " * 20, "en"),
            (4, None, "en"), (6, "le chien et la maison " * 20, "fr"), (7, "12 !", "fr"), (8, "", None), (9, "x", None), (None, "the cat", "en"),
            (10, "the cat and the mouse " * 20_000, None), (10, "the cat and the mouse " * 20_000, None)]
    df = make([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = [tuple(r) for r in language.identify(df).select("doc_id", "lang_pred", "held_out").collect()]
    assert len(got) == len(rows)
    found = {g[0]: g[1] for g in got}
    assert found[4] == found[7] == found[8] == "und" and found[9] in ("en", "fr") and found[10] == "en"
    assert {g[2] for g in got if g[0] is None} == {False}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(empty).collect() == [] and language.accepted(empty).collect() == []


def test_nothing_to_learn_from(make):
    df = make([(1, "some text", None), (2, None, None), (3, "...", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(df).collect()} == {"und"}
    assert [r.doc_id for r in language.accepted(df).collect()] == [1]


def test_accepted_keeps_every_column(spark, documents):
    kept = language.accepted(documents.withColumn("lang_pred", documents.lang))
    assert kept.columns == [*documents.columns, "lang_pred"]
    assert kept.count() >= 0.99 * documents.count()


def test_more_languages_than_bits_in_a_word(make):
    rng = np.random.default_rng(1)
    rows = []
    for l in range(150):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(30)]
        for d in range(5 if l < 70 else 4):
            rows.append((1000 * l + d, " ".join(rng.permutation(words)), f"l{l:03}"))
    df = make(rows, "doc_id long, text string, lang string")
    truth = {r[0]: r[2] for r in rows}
    learned = {r[2] for r in rows if crc32(str(r[0]).encode()) % 5}
    got = language.identify(df).collect()
    right = [r.lang_pred == truth[r.doc_id] for r in got if truth[r.doc_id] in learned]
    assert len(learned) > 140 and len(right) > 600 and all(right)
    assert language.accepted(df).where(f"lang IN {tuple(sorted(learned))}").count() == len(right)


def plain_prediction(model, text):
    """n-gram by n-gram in plain integers: (language, score)."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    spaced = f" {' '.join(language.WORD.findall(text.lower()))} "
    table = [[int(w) for w in row] for row in model.table.reshape(len(model.table), -1)]
    hits, count = [0] * len(model.languages), 0
    for i in range(len(spaced) - language.SIZE + 1):
        h = 0
        for c in spaced[i : i + language.SIZE]:
            h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
        low, high = h & 0xFFFFFFFF, h >> 32 | 1
        rows = [table[(low + p * high) % 2**64 % len(table)] for p in range(language.PROBES)]
        count += 1
        for l in range(len(hits)):
            hits[l] += all(row[l // 64] >> l % 64 & 1 for row in rows)
    shares = [min(1.0, max(0.0, (n / max(1, count) - f) / max(1e-9, 1 - f))) for n, f in zip(hits, model.false_rate)]
    best = max(range(len(shares)), key=lambda l: (shares[l], -l))
    return model.languages[best], shares[best]


def test_whole_query_equals_plain_prediction(spark, small, documents, monkeypatch):
    # Small tables, so that false positives occur and are corrected.
    monkeypatch.setattr(language, "MOST_TABLE_BYTES", 1 << 14)
    rows = documents.select("doc_id", "text", "lang")
    model = language.learn(rows.where(~language.held_out()))
    assert len(model.table) == 2048 and model.false_rate.max() > 0.01
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op7_language_id"](spark, small).collect()}
    for r in rows.collect():
        name, score = plain_prediction(model, r.text)
        assert got[r.doc_id][0] == name and abs(got[r.doc_id][1] - score) < 1e-9
