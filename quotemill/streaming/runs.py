"""Stream sources and the available-now runner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quotemill.session import new_work_dir


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A file stream; its schema is declared."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain_to_parquet(stream: DataFrame, label: str, path: str | None = None, mode: str = "append") -> str:
    """Process everything available into parquet and stop; returns the output path.

    Output and checkpoint live below the shared folder, so a run that lost its driver
    resumes from the same offsets.
    """
    root = path or new_work_dir(stream.sparkSession, label)
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/rows")
    )
    query.awaitTermination()
    return f"{root}/rows"
