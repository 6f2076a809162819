"""Rule lists per table, the failure log, plan shape."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.operators.quality import run_checks, summary_line
from quotemill.operators.quality.log import failure_log, failures

NOW = datetime(2026, 4, 1, 12)
CLOCK = Clock(NOW)
PRICE = "symbol string, price_usd double, volume_24h bigint, price_change_24h double, timestamp timestamp_ntz"
WEATHER = "city string, temperature double, humidity int, weather_condition string"
NEWS = "title string, source string, url string, published_at timestamp_ntz"


@pytest.mark.parametrize(
    "table, schema, record, failed",
    [
        ("crypto_prices", PRICE, ("BTC", 50000.0, 1000000, 2.5, NOW), []),
        ("crypto_prices", PRICE, ("BTC", 50000.0, 1000000, 2.5, NOW + timedelta(days=365)), ["FutureTimestampCheck:timestamp"]),
        ("unknown", "some string", ("data",), []),
        ("weather_data", WEATHER, ("Warsaw", 20.5, 60, "sunny"), []),
        ("news_articles", NEWS, ("Bitcoin rises", "BBC News", "https://bbc.com/news/123", NOW), []),
        ("news_articles", NEWS, ("", "BBC News", "https://bbc.com/news/123", NOW), ["NotNullCheck:title"]),
    ],
)
def test_rules(spark, table, schema, record, failed):
    row = run_checks(spark.createDataFrame([record], schema), table, CLOCK, F.lit("key")).first()
    assert row["failed_checks"] == failed
    assert row["dq_passed"] is (not failed)
    assert row["dq_table"] == table and row["record_id"] == "key"
    assert (row["total_checks"] == 0) is (table == "unknown")


def test_rows_are_flagged_not_dropped(tables):
    assert tables.report("weather_data").count() == tables.weather.count()


def test_only_failures_are_logged(spark):
    rows = [("Warsaw", 20.5, 60, "sunny"), ("Warsaw", 20.5, 160, "sunny")]
    report = run_checks(spark.createDataFrame(rows, WEATHER), "weather_data", CLOCK, F.col("city"))
    logged = failure_log(report).collect()
    assert len(logged) == 1
    body = json.loads(logged[0]["content"])
    assert list(body) == [
        "table", "record_id", "failed_checks", "total_checks", "auto_repaired", "checked_at", "original_record", "fixed_record",
    ]
    assert body["original_record"]["humidity"] == 160 and body["fixed_record"]["humidity"] == 100
    assert body["auto_repaired"] is True and body["checked_at"] == "2026-04-01 12:00:00"


def test_log_strips_vectors_and_writes_nulls(spark):
    df = spark.createDataFrame([("", None, [0.5, 1.0], NOW)], "title string, source string, embedding array<float>, published_at timestamp_ntz")
    report = run_checks(df, "news_articles", CLOCK, F.col("title"))
    body = json.loads(failure_log(report).first()["content"])
    assert body["original_record"] == {
        "title": "", "source": None, "embedding": "<vector 2 dims>", "published_at": "2026-04-01 12:00:00",
    }
    assert body["fixed_record"] is None


def test_failures_read_back(spark):
    report = run_checks(spark.createDataFrame([("", 60.0, -1, " ")], WEATHER), "weather_data", CLOCK, F.col("city"))
    row = failures(failure_log(report)).first()
    assert row["table_name"] == "weather_data" and row["auto_repaired"] == "true"
    assert row["failed_checks"] == [
        "NotNullCheck:city", "RangeCheck:temperature[-50.0,50.0]", "RangeCheck:humidity[0.0,100.0]", "NotNullCheck:weather_condition",
    ]
    assert json.loads(row["original_record"])["humidity"] == -1


def test_summary_line(spark):
    rows = [("Warsaw", 20.5, 60, "sunny"), ("Warsaw", 20.5, 160, "sunny")]
    report = run_checks(spark.createDataFrame(rows, WEATHER), "weather_data", CLOCK, F.col("city"))
    lines = [r[0] for r in report.select(summary_line(report)).collect()]
    assert lines[0] == "✅ weather_data [Warsaw] — wszystkie 4 checks OK"
    assert lines[1] == "⚠️  weather_data [Warsaw] — FAILED: ['RangeCheck:humidity[0.0,100.0]'] (🔧 naprawiono)"


def test_a_run_is_one_stage_without_python(tables):
    plan = tables.report("crypto_prices")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_typed_records_are_read_by_path(spark, tables, tmp_path):
    """Logs of tables with different rows fit one store; vectors and times are kept as in the JSON body."""
    from pyspark.sql import functions as F

    from quotemill.operators.quality.log import failure_records, failures, failures_by_day
    from registry.tables import CLOCK

    path = f"{tmp_path}/records"
    for batch in (0, 0):
        tables.failure_records.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")
    stored = spark.read.parquet(path)
    assert dict(stored.dtypes)["original_record"] == "variant"
    from_json = {(r["id"], tuple(r["failed_checks"]), r["auto_repaired"], r["date"]) for r in failures_by_day(tables.failures, CLOCK.zone).collect()}
    typed = {(r["id"], tuple(r["failed_checks"]), r["auto_repaired"], r["date"]) for r in failures_by_day(stored, CLOCK.zone).collect()}
    assert typed == from_json and typed
    body = tables.failures.select("id", F.get_json_object("content", "$.original_record.timestamp").alias("a"))
    path_read = failures(stored).select("id", F.try_variant_get("original_record", "$.timestamp", "string").alias("b"))
    assert body.join(path_read, "id").where("NOT a <=> b").count() == 0
    with_vector = tables.logged("news_articles", failure_records)
    assert with_vector.count() > 0


def test_a_record_with_a_vector_names_its_size(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from quotemill.clock import Clock
    from quotemill.operators.quality import run_checks
    from quotemill.operators.quality.log import failure_records

    rows = spark.createDataFrame([(1, "", [0.5, 0.25])], "id long, title string, embedding array<float>")
    record = failure_records(run_checks(rows, "news_articles", Clock(datetime(2024, 1, 1)))).select(
        F.variant_get("original_record", "$.embedding", "string").alias("v"), F.variant_get("original_record", "$.id", "int").alias("id")).first()
    assert (record["v"], record["id"]) == ("<vector 2 dims>", 1)
