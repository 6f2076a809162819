"""Run metrics as mergeable sketches: stored per batch and day, merged over any range.

Counts are exact. Distinct values of a column are a HyperLogLog sketch of 2^LOG_REGISTERS
registers, quantiles of a number a KLL sketch of size KLL_SIZE; both merge without loss, so a
range of days has the error of a single day.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.sources import sinks

LOG_REGISTERS = 12
KLL_SIZE = 400
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)  # three standard errors
RANK_ERROR = 0.01  # of a quantile's rank, at the 99 % confidence of a KLL sketch of this size
SCHEMA = (
    "table_name STRING, column_name STRING, rows BIGINT, failures BIGINT, repaired BIGINT, present BIGINT, "
    "least DOUBLE, greatest DOUBLE, distinct_sketch BINARY, quantile_sketch BINARY, date DATE, batch_id BIGINT"
)


def measure(report: DataFrame, columns: dict[str, str | None], day: Column) -> DataFrame:
    """One row per local day and column of a checked batch: counts and sketches.

    `columns` gives the columns to describe, each with the column that holds it as a number, or
    None. A column "" carries the counts of rows, failures and repairs. One scan, folded by day.
    """
    rows = report.withColumn("date", day)
    folded = [
        F.count("*").alias("rows"), F.count_if(~F.col("dq_passed")).alias("failures"), F.count_if("auto_repaired").alias("repaired"),
        F.first("dq_table").alias("table_name"),
    ]
    for i, (name, number) in enumerate(columns.items()):
        text = F.col(name).cast("string")
        folded += [F.count(text).alias(f"present_{i}"), F.hll_sketch_agg(text, LOG_REGISTERS).alias(f"distinct_{i}")]
        if number is not None:
            value = F.col(number).cast("double")
            folded += [F.min(value).alias(f"least_{i}"), F.max(value).alias(f"greatest_{i}"), F.kll_sketch_agg_double(value, F.lit(KLL_SIZE)).alias(f"quantile_{i}")]
    by_day = rows.groupBy("date").agg(*folded)
    none = {"rows": "bigint", "failures": "bigint", "repaired": "bigint", "present": "bigint", "least": "double", "greatest": "double", "distinct_sketch": "binary", "quantile_sketch": "binary"}
    empty = lambda name: F.lit(None).cast(none[name]).alias(name)
    parts = [by_day.select("date", "table_name", F.lit("").alias("column_name"), "rows", "failures", "repaired", *(empty(n) for n in list(none)[3:]))]
    for i, (name, number) in enumerate(columns.items()):
        pick = lambda column, as_name: F.col(f"{column}_{i}").alias(as_name) if number is not None else empty(as_name)
        parts.append(
            by_day.select(
                "date", "table_name", F.lit(name).alias("column_name"), empty("rows"), empty("failures"), empty("repaired"),
                F.col(f"present_{i}").alias("present"), pick("least", "least"), pick("greatest", "greatest"),
                F.col(f"distinct_{i}").alias("distinct_sketch"), pick("quantile", "quantile_sketch"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def store(measured: DataFrame, path: str, batch_id: int) -> None:
    """Keep a batch's metrics below the folders of its days; the batch again replaces its own."""
    sinks.write_batch(measured, path, batch_id, F.col("date"))


def over(spark: SparkSession, path: str, first: date | None = None, last: date | None = None, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per table and column over the days from `first` to `last`: counts, distinct values, quantiles.

    Only the folders of these days are read. Distinct values and quantiles are estimates; see the
    errors above. A column without values has no quantiles.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        stored = stored.where(F.col("date") >= F.lit(first))
    if last is not None:
        stored = stored.where(F.col("date") <= F.lit(last))
    merged = stored.groupBy("table_name", "column_name").agg(
        F.sum("rows").alias("rows"), F.sum("failures").alias("failures"), F.sum("repaired").alias("repaired"),
        F.sum("present").alias("present"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )
    numbers = F.col("least").isNotNull()
    at = [F.when(numbers, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    values = F.when(F.col("column_name") != "", F.hll_sketch_estimate("distinct_sketch")).alias("distinct_values")
    return merged.select("table_name", "column_name", "rows", "failures", "repaired", "present", values, "least", "greatest", *at)
