from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quotemill.sources import key_filters, sinks

SCHEMA = "id bigint, url string, source string, at timestamp_ntz"


def rows(spark, *items):
    return spark.createDataFrame([(i, u, "s", datetime(2024, 1, d)) for i, u, d in items], SCHEMA)


def store(df, root, batch):
    sinks.write_batch(df, f"{root}/data", batch, F.to_date("at"))
    key_filters.write_filters(df, f"{root}/keys", batch, ["url"], F.to_date("at"))


def test_possible_days(spark, tmp_path):
    assert key_filters.possible_days(spark, f"{tmp_path}/keys", rows(spark, (1, "a", 1)), ["url"]) is None
    store(rows(spark, (1, "a", 1), (2, "b", 2), (3, None, 3), (4, "a", 4)), tmp_path, 0)
    store(rows(spark, (5, "c", 2)), tmp_path, 1)
    days = lambda *urls, **of: key_filters.possible_days(spark, f"{tmp_path}/keys", rows(spark, *[(9, u, 9) for u in urls]), ["url"], **of)
    assert days("a") == [date(2024, 1, 1), date(2024, 1, 4)]
    assert days("b", "zzz", None) == [date(2024, 1, 2)]
    assert days("zzz") == [] and days(None) == []
    assert days("c", but_batch=1) == [] and days("c", but_batch=0) == [date(2024, 1, 2)]


def test_all_bits_are_found(spark, tmp_path):
    many = spark.range(40_000).select("id", F.concat(F.lit("u"), "id").alias("url"), F.lit("s").alias("source"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("at"))
    key_filters.write_filters(many, f"{tmp_path}/keys", 0, ["url"], F.to_date("at"), buckets=4)
    placed = key_filters._places(many, ["url"], 4)
    stored = spark.read.schema(key_filters.SCHEMA).parquet(f"{tmp_path}/keys")
    held = placed.join(stored, "bucket").select(key_filters._holds(F.col("bitmap"), F.col("bit")).alias("x"))
    assert held.where("x").count() == 40_000
    others = key_filters._places(many.withColumn("url", F.concat("url", F.lit("x"))), ["url"], 4).join(stored, "bucket")
    share = others.where(key_filters._holds(F.col("bitmap"), F.col("bit"))).count() / 40_000
    assert 0.15 < share < 0.35  # 40,000 keys in 131,072 bits


def test_a_batch_reads_only_days_with_a_possible_hit(spark, tmp_path):
    store(rows(spark, (1, "a", 1), (2, "b", 2), (3, None, 3)), tmp_path, 0)
    for day in (2, 3):
        for file in (tmp_path / f"data/date=2024-01-0{day}").rglob("*"):
            if file.is_file():
                file.write_bytes(b"broken") if file.suffix == ".parquet" else file.unlink()
    stored = spark.read.schema(f"{SCHEMA}, date DATE, batch_id BIGINT").parquet(f"{tmp_path}/data")
    incoming = rows(spark, (7, "a", 7), (8, "new", 8), (9, "new", 9), (10, None, 9), (11, None, 9))
    fresh = key_filters.insert_if_absent(stored, f"{tmp_path}/keys", incoming, ["url"], [F.col("id")])
    assert sorted(r["id"] for r in fresh.collect()) == [8, 10, 11]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-01" in plan and "2024-01-02" not in plan
    with pytest.raises(Exception):
        sinks.insert_if_absent(stored, incoming, ["url"], [F.col("id")]).collect()


def test_without_filters_all_days_are_read(spark, tmp_path):
    sinks.write_batch(rows(spark, (1, "a", 1)), f"{tmp_path}/data", 0, F.to_date("at"))
    stored = spark.read.parquet(f"{tmp_path}/data")
    fresh = key_filters.insert_if_absent(stored, f"{tmp_path}/keys", rows(spark, (2, "a", 2), (3, "b", 2)), ["url"], [F.col("id")])
    assert [r["id"] for r in fresh.collect()] == [3]
