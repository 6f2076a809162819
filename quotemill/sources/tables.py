"""Table readers: declared schema, never inferred; parameterised SQL over them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quotemill.sources.schemas import SOURCES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A domain table stored as parquet below `root`."""
    return spark.read.schema(SOURCES[name].schema).parquet(f"{root}/{name}")


def query(spark: SparkSession, sql: str, params: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with `:name` parameters and `{table}` references to the given DataFrames."""
    return spark.sql(sql, args=params or {}, **tables)


def describe_sources(spark: SparkSession) -> DataFrame:
    """The source registry as rows: table, column, type, constraint flags."""
    rows = [
        (s.name, s.description, f.name, f.dataType.simpleString(), f.name in s.not_null, s.max_length.get(f.name))
        for s in SOURCES.values()
        for f in s.schema.fields
    ]
    return spark.createDataFrame(
        rows, "table_name string, description string, column_name string, type string, "
        "required boolean, max_length int",
    )
