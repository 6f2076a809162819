"""Failure log: records of failed reports, typed or with a JSON body, and the columns read back.

Typed records keep the failed row as VARIANT: written once, read by path, the other fields as
columns, so no reader parses JSON text. The JSON body is the form of the service's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.times import local_date
from quotemill.sources.sinks import insight


# The body is parsed once; the flag and the record stay JSON text.
BODY_SCHEMA = (
    "table STRING, record_id STRING, failed_checks ARRAY<STRING>, auto_repaired STRING, original_record STRING"
)


def safe_record(record: Column, schema: T.StructType) -> Column:
    """A record as JSON-safe struct: vectors become `<vector N dims>`, times become text."""
    parts = []
    for field in schema.fields:
        value = record[field.name]
        if field.name == "embedding":
            value = F.when(
                F.size(value) > 0, F.concat(F.lit("<vector "), F.size(value).cast("string"), F.lit(" dims>"))
            )
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            value = value.cast("string")
        parts.append(value.alias(field.name))
    return F.struct(*parts)


def failure_body(report: DataFrame) -> Column:
    """JSON body of one report row, NULLs written out."""
    schema = report.schema["original_record"].dataType
    body = F.struct(
        F.col("dq_table").alias("table"),
        "record_id",
        "failed_checks",
        "total_checks",
        "auto_repaired",
        F.col("checked_at").cast("string").alias("checked_at"),
        safe_record(F.col("original_record"), schema).alias("original_record"),
        F.when(F.col("auto_repaired"), safe_record(F.col("fixed_record"), schema)).alias("fixed_record"),
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def failure_log(
    report: DataFrame, generated_at: Column | None = None, row_id: Column | None = None
) -> DataFrame:
    """Insight rows for the failed records only."""
    at = F.col("checked_at") if generated_at is None else generated_at
    failed = report.filter(~F.col("dq_passed"))
    return insight(failed, "dq_failure", failure_body(report), at, row_id)


def failure_records(
    report: DataFrame, generated_at: Column | None = None, row_id: Column | None = None
) -> DataFrame:
    """One typed row per failed record; the rows as VARIANT, so the logs of all tables fit together.

    The id defaults to a hash of the record, as that of `failure_log` does of its body.
    """
    at = F.col("checked_at") if generated_at is None else generated_at
    schema = report.schema["original_record"].dataType
    original = safe_record(F.col("original_record"), schema)
    own = F.xxhash64("dq_table", F.to_json(original), at) if row_id is None else row_id
    fixed = F.when(F.col("auto_repaired"), safe_record(F.col("fixed_record"), schema))
    return report.filter(~F.col("dq_passed")).select(
        own.cast("bigint").alias("id"),
        F.lit("dq_failure").alias("insight_type"),
        F.col("dq_table").alias("table_name"),
        "record_id",
        "failed_checks",
        "total_checks",
        "auto_repaired",
        F.to_variant_object(original).alias("original_record"),
        F.to_variant_object(fixed).alias("fixed_record"),
        "checked_at",
        at.alias("generated_at"),
    )


def failure_marks(report: DataFrame, generated_at: Column | None = None, row_id: Column | None = None) -> DataFrame:
    """(id, insight_type, generated_at) of the failed records, for what only counts them."""
    at = F.col("checked_at") if generated_at is None else generated_at
    own = F.lit(None).cast("bigint") if row_id is None else row_id
    return report.filter(~F.col("dq_passed")).select(own.alias("id"), F.lit("dq_failure").alias("insight_type"), at.alias("generated_at"))


def failures(insights: DataFrame) -> DataFrame:
    """Failures with their fields: of typed records as they are, else pulled out of the JSON body."""
    if "failed_checks" in insights.columns:
        flag = F.col("auto_repaired").cast("string").alias("auto_repaired")
        return insights.select("id", "table_name", "record_id", "failed_checks", flag, "original_record", "generated_at")
    logged = insights.filter(F.col("insight_type") == "dq_failure")
    return logged.withColumn("body", F.from_json("content", BODY_SCHEMA)).select(
        "id",
        F.col("body.table").alias("table_name"),
        "body.record_id",
        "body.failed_checks",
        "body.auto_repaired",
        "body.original_record",
        "generated_at",
    )


def failures_by_day(insights: DataFrame, zone: str) -> DataFrame:
    """Staged failures: local date, table, record, checks, repaired flag as text."""
    return failures(insights).select(
        local_date("generated_at", zone).alias("date"),
        "id", "table_name", "record_id", "failed_checks", "auto_repaired", "generated_at",
    )
