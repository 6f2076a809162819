"""Record checks: valid and invalid values, NULL, absent fields, repairs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.operators.quality import (
    ExpressionCheck,
    FutureTimestampCheck,
    NotNullCheck,
    RangeCheck,
    UrlFormatCheck,
    run_checks,
)

NOW = datetime(2026, 4, 1, 12)
CLOCK = Clock(NOW)


def run_one(spark, check, value, schema, field="f"):
    df = spark.createDataFrame([(value,)], f"{field} {schema}")
    row = run_checks(df, "t", CLOCK, rules={"t": [check]}).first()
    return row["dq_passed"], row[field], row


@pytest.mark.parametrize(
    "value, passes", [("Bitcoin", True), (None, False), ("", False), (" \t\n", False), (" x", True)]
)
def test_not_null(spark, value, passes):
    ok, kept, _ = run_one(spark, NotNullCheck("f"), value, "string")
    assert ok is passes and kept == value


def test_not_null_absent_field_fails_and_numbers_pass(spark):
    assert run_one(spark, NotNullCheck("g"), "x", "string")[0] is False
    assert run_one(spark, NotNullCheck("f"), 0, "int")[0] is True


@pytest.mark.parametrize(
    "check, value, passes",
    [
        (RangeCheck("f", 0, 100), 50.0, True),
        (RangeCheck("f", 0), -10.0, False),
        (RangeCheck("f", 0, 100), 150.0, False),
        (RangeCheck("f", 0, exclusive_min=True), 0.0, False),
        (RangeCheck("f", 0, exclusive_min=True), 0.01, True),
        (RangeCheck("f", 0, nullable=True), None, True),
        (RangeCheck("f", 0), None, False),
        (RangeCheck("f", 0, 100), float("nan"), True),
        (RangeCheck("f", 0, 100), float("inf"), False),
    ],
)
def test_range(spark, check, value, passes):
    assert run_one(spark, check, value, "double")[0] is passes


@pytest.mark.parametrize("value, passes", [("not a number", False), (" 50 ", True), ("150", False), ("1e1", True)])
def test_range_on_text(spark, value, passes):
    assert run_one(spark, RangeCheck("f", 0, 100), value, "string")[0] is passes


def test_range_absent_field_follows_nullable(spark):
    assert run_one(spark, RangeCheck("g", 0), 1.0, "double")[0] is False
    assert run_one(spark, RangeCheck("g", 0, nullable=True), 1.0, "double")[0] is True


@pytest.mark.parametrize("value, fixed", [(150, 100), (-20, 0)])
def test_humidity_is_clamped(spark, value, fixed):
    ok, kept, row = run_one(spark, RangeCheck("humidity", 0, 100), value, "int", "humidity")
    assert not ok and kept == fixed and row["auto_repaired"]
    assert row["original_record"]["humidity"] == value and row["fixed_record"]["humidity"] == fixed


@pytest.mark.parametrize("value", [None, "wet"])
def test_humidity_without_number_stays(spark, value):
    ok, kept, row = run_one(spark, RangeCheck("humidity", 0, 100), value, "string", "humidity")
    assert not ok and kept == value and not row["auto_repaired"]


def test_other_fields_are_not_repaired(spark):
    ok, kept, row = run_one(spark, RangeCheck("price", 0, 100), 150.0, "double", "price")
    assert not ok and kept == 150.0 and not row["auto_repaired"]


@pytest.mark.parametrize(
    "value, passes",
    [("http://example.com", True), ("https://bbc.com/news", True), ("example.com", False), ("", False), (None, False),
     ("  https://x", True), ("HTTP://x", False)],
)
def test_url(spark, value, passes):
    assert run_one(spark, UrlFormatCheck("f"), value, "string")[0] is passes


def test_url_on_numbers_fails(spark):
    assert run_one(spark, UrlFormatCheck("f"), 5, "int")[0] is False


@pytest.mark.parametrize("minutes, passes", [(-60, True), (0, True), (3, True), (10, False)])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_future(spark, minutes, passes, kind):
    value = NOW + timedelta(minutes=minutes)
    df = spark.createDataFrame([(value.isoformat(sep=" "),)], "s string").select(F.col("s").cast(kind).alias("f"))
    row = run_checks(df, "t", CLOCK, rules={"t": [FutureTimestampCheck("f")]}).first()
    assert row["dq_passed"] is passes


def test_future_null_and_text_pass(spark):
    assert run_one(spark, FutureTimestampCheck("f"), None, "timestamp_ntz")[0] is True
    assert run_one(spark, FutureTimestampCheck("f"), "2099-01-01", "string")[0] is True


def test_names_carry_python_number_text():
    assert RangeCheck("price_usd", min_val=0.0).name == "RangeCheck:price_usd[0.0,None]"
    assert RangeCheck("price_change_24h", -100.0, 100.0).name == "RangeCheck:price_change_24h[-100.0,100.0]"
    assert NotNullCheck("title").name == "NotNullCheck:title"


def test_later_checks_see_earlier_repairs(spark):
    df = spark.createDataFrame([(150,)], "humidity int")
    rules = {"t": [RangeCheck("humidity", 0, 100), ExpressionCheck("dry", "humidity <= 100")]}
    row = run_checks(df, "t", CLOCK, rules=rules).first()
    assert row["failed_checks"] == ["RangeCheck:humidity[0,100]"]


def test_check_that_cannot_run_is_an_error_and_the_chain_continues(spark):
    df = spark.createDataFrame([("",)], "title string")
    rules = {"t": [ExpressionCheck("broken", "nothing > 1"), NotNullCheck("title")]}
    row = run_checks(df, "t", CLOCK, rules=rules).first()
    assert row["failed_checks"] == ["ExpressionCheck:broken[ERROR]", "NotNullCheck:title"]
    assert row["total_checks"] == 2
