"""Join a large frame with a small derived one by its measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quotemill.session import new_work_dir


def settled(small: DataFrame) -> DataFrame:
    """The frame computed once and stored in the shared folder, for plans that use it twice.

    It is read back as a table, so the planner knows its size in bytes.
    """
    path = new_work_dir(small.sparkSession, "settled")
    small.write.parquet(path)
    return small.sparkSession.read.schema(small.schema).parquet(path)


def join_summary(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a settled, usually much smaller frame.

    A summary below the broadcast threshold is broadcast, which keeps the rows where they are.
    Beyond it both sides are shuffled, and adaptive execution splits a key that holds most rows.
    """
    return rows.join(summary, key)
