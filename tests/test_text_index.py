from collections import Counter
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotemill.functions.texts import STOP_WORDS, WORD, stem_word
from quotemill.operators import keyword
from quotemill.operators.text_index import TextIndex

SCHEMA = "id bigint, title string, description string, published_at timestamp_ntz"
ROWS = [
    (1, "Bitcoin rises", "the market follows", datetime(2024, 1, 1)),
    (2, "Markets", "bitcoin and the bitcoins", datetime(2024, 1, 2)),
    (3, "Weather", None, datetime(2024, 1, 3)),
    (4, "of the", "", None),
    (5, "Bitcoin falls with the market", "markets fall", datetime(2024, 1, 5)),
    (6, "Rising weather", "market", datetime(2024, 1, 6)),
]
QUERIES = ["bitcoin market", "weather", "falling", "nothing", "the"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def asked(spark):
    return spark.createDataFrame([(q,) for q in QUERIES], "query string")


def rows_of(df):
    return sorted(map(tuple, df.select("query", "place", "id", "relevance").collect()))


def files_of(folder):
    return {(str(f), f.stat().st_mtime_ns) for f in folder.rglob("*.parquet")}


def test_batches_replay_delete_and_merge(spark, docs, tmp_path):
    index = TextIndex(f"{tmp_path}/i", buckets=3)
    direct = lambda ids: rows_of(keyword.search(docs.where(F.col("id").isin(ids)), asked(spark)))
    assert rows_of(index.search(docs, asked(spark))) == []
    index.add(docs.where("id < 3"), "a")
    before = files_of(tmp_path / "i/postings/name=a")
    assert before and rows_of(index.search(docs, asked(spark))) == direct([1, 2])
    index.add(docs.where("id IN (3, 4)"), "b")
    index.add(docs.where("id > 4"), "c")
    index.add(docs.where("id IN (3, 4)"), "b")
    assert rows_of(index.search(docs, asked(spark))) == direct([1, 2, 3, 4, 5, 6])
    index.delete(spark.createDataFrame([(2,), (2,), (77,), (None,)], "id bigint"), "d1")
    assert rows_of(index.search(docs, asked(spark))) == direct([1, 3, 4, 5, 6])
    index.delete(spark.createDataFrame([(2,), (4,), (6,)], "id bigint"), "d2")
    index.delete(spark.createDataFrame([(2,), (4,), (6,)], "id bigint"), "d2")
    wanted = direct([1, 3, 5])
    assert rows_of(index.search(docs, asked(spark))) == wanted and wanted
    assert files_of(tmp_path / "i/postings/name=a") == before
    index.add(spark.createDataFrame([], SCHEMA), "empty")
    assert rows_of(index.search(docs, asked(spark))) == wanted
    index.merge(spark, "m")
    assert rows_of(index.search(docs, asked(spark))) == wanted
    index.add(docs.where("id = 2"), "again")
    assert rows_of(index.search(docs, asked(spark))) == direct([1, 2, 3, 5])
    with pytest.raises(ValueError):
        index.merge(spark, "m")


def test_a_segment_without_catalogue_is_not_seen(spark, docs, tmp_path):
    index = TextIndex(f"{tmp_path}/i", buckets=2)
    index.add(docs.where("id = 1"), "a")
    index._write(keyword.postings(docs, keyword.search_text()), "half")
    assert {r[2] for r in rows_of(index.search(docs, asked(spark)))} == {1}


def test_only_the_buckets_of_the_terms_are_read(spark, docs, tmp_path):
    index = TextIndex(f"{tmp_path}/i", buckets=16)
    index.add(docs, "a")
    terms = keyword.query_terms(spark.createDataFrame([("weather",)], "query string"))
    used = {r["b"] for r in terms.select(keyword._bucket(16).alias("b")).collect()}
    others = [f for f in (tmp_path / "i/postings/name=a").glob("bucket=*") if int(f.name.split("=")[1]) not in used]
    assert others
    for file in (x for folder in others for x in folder.iterdir()):
        file.write_bytes(b"broken") if file.suffix == ".parquet" else file.unlink()
    assert {r["id"] for r in index.matches(terms).collect()} == {3, 6}


def test_a_segment_stores_lists_of_entries(spark, tmp_path):
    """A row is a term with the entries of many documents, not a term of one document."""
    index = TextIndex(f"{tmp_path}/i", buckets=4)
    docs = spark.range(60).selectExpr("id", "'Rising markets' AS title", "'weather' AS description", "timestamp_ntz'2024-01-01' AS published_at")
    index.add(docs.coalesce(1), "a")
    assert spark.read.parquet(f"{tmp_path}/i/postings/name=a").count() == 4
    index.delete(docs.where("id < 50").select("id"), "d")
    found = index.search(docs, asked(spark), 100).where("query = 'weather'")
    assert {r["id"] for r in found.collect()} == set(range(50, 60))
    index.merge(spark, "m")
    assert {r["id"] for r in index.search(docs, asked(spark), 100).where("query = 'weather'").collect()} == set(range(50, 60))


@pytest.mark.parametrize("at_once", [1, 7, 10**6])
def test_lists_hold_the_postings(monkeypatch, at_once):
    control = "".join(map(chr, range(128)))
    content = ["Bitcoin rises, the bitcoin\u2028falls_down", None, "", "of the", control, f"réaux {control}", "İstanbul ΑΣ x²", "Markets 42 markets"]
    rows = {"id": [1, 2, None, 4, 4, 6, 7, 8], "published_at": [datetime(2024, 1, 1), None] * 4, "text": content}
    schema = pa.schema([("id", pa.int64()), ("published_at", pa.timestamp("us")), ("text", pa.string())])
    batches = pa.table(rows, schema).to_batches(max_chunksize=3)

    def rows_of_lists(lists):
        out = []
        for row in (r for batch in lists for r in batch.to_pylist()):
            assert row["docs"] == len(row["entries"])
            out += [(e["id"] or 0, row["term"], e["tf"], e["length"], str(e["published_at"])) for e in row["entries"]]
        return sorted(out)

    want = []
    for i, at, text in zip(*rows.values()):
        words = [w for w in WORD.findall((text or "").lower()) if w not in STOP_WORDS]
        counts = Counter(map(stem_word, words))
        want += [(i or 0, t, n, len(words), str(at)) for t, n in [*counts.items(), ("", 0)]]
    monkeypatch.setattr(keyword, "LISTED_AT_ONCE", at_once)
    monkeypatch.setattr(keyword, "DOCS_AT_ONCE", 2)
    assert rows_of_lists(keyword._gathered(iter(batches))) == sorted(want)
    assert rows_of_lists(keyword._listed(keyword._counted(iter(batches)))) == sorted(want)
