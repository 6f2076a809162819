"""Write semantics: append, insert-if-absent, upsert, log, refresh, retention."""

from __future__ import annotations

from datetime import date
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.times import local_date


def stamp(df: DataFrame, batch_time: Column, column: str = "timestamp") -> DataFrame:
    """Give every row of a batch the same ingest time where it has none."""
    present = F.col(column) if column in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.withColumn(column, F.coalesce(present, batch_time))


def with_row_id(df: DataFrame, *natural_key: str) -> DataFrame:
    """Surrogate id from the natural key: the same row gets the same id on a retry."""
    return df.withColumn("id", F.xxhash64(*natural_key))


def write_batch(df: DataFrame, path: str, batch_id: int, day: Column | None = None) -> None:
    """Append one batch as its own folder, or as one below the folder of each of its days.

    A batch replayed after a failure overwrites its own folders only, so a retry never
    stores rows twice; those of days it no longer has are deleted first.
    """
    if day is None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        return
    fs, pattern = _folder(df.sparkSession, f"{path}/date=*/batch_id={batch_id}")
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), True)
    dated = df.withColumn("date", day).withColumn("batch_id", F.lit(batch_id))
    dated.write.mode("append").partitionBy("date", "batch_id").parquet(path)


def append_snapshots(df: DataFrame, path: str, batch_id: int, zone: str) -> None:
    """Cleaned price snapshots, partitioned by local date."""
    write_batch(df, path, batch_id, local_date("timestamp", zone))


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key; rows with a NULL in the key never conflict and all stay.

    One pass: a row without a key is a group of its own, and the row number is limited to 1,
    so each map task reduces a hot key to one row before the shuffle.
    """
    no_key = F.lit(False)
    for name in key:
        no_key = no_key | F.col(name).isNull()
    numbered = df.withColumn("_own", F.when(no_key, F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy(*key, "_own").orderBy(*order))
    return numbered.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place", "_own")


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: the first incoming row per key whose key the target lacks."""
    fresh = keep_first(incoming, key, order)
    return fresh.join(target.select(*key), key, "left_anti").select(*incoming.columns)


def upsert_latest(stored: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key of both frames; a change wins a tie."""
    both = stored.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_change")))
    return both.withColumn("_place", place).filter(F.col("_place") == 1).select(*stored.columns)


def load_metadata(batch: DataFrame, table: str, at: Column) -> DataFrame:
    """Ingest metadata of one batch: last success, rows written, last check."""
    return batch.agg(F.count("*").alias("rows_inserted")).select(
        F.lit(table).alias("table_name"),
        at.alias("last_successful_ts"),
        "rows_inserted",
        at.alias("last_check"),
    )


def insight(
    df: DataFrame, kind: str, content: Column, generated_at: Column, row_id: Column | None = None
) -> DataFrame:
    """Rows of the insight log with a JSON body; the id defaults to a hash of the row."""
    own = F.xxhash64(F.lit(kind), content, generated_at) if row_id is None else row_id
    return df.select(
        own.cast("bigint").alias("id"),
        F.lit(kind).alias("insight_type"),
        content.alias("content"),
        F.lit(None).cast("string").alias("data_snapshot"),
        generated_at.alias("generated_at"),
    )


def retain(df: DataFrame, column: str, days: int, now: Column) -> DataFrame:
    """Rows not older than `days`; rows without a time stay, a delete never matches them."""
    bound = now - F.make_dt_interval(F.lit(days))
    return df.filter((F.col(column) >= bound) | F.col(column).isNull())


RETENTION_DAYS = {"crypto_prices": ("timestamp", 30), "news_articles": ("fetched_at", 7), "weather_data": ("timestamp", 14)}


def drop_old_days(spark: SparkSession, path: str, oldest: date) -> int:
    """Delete whole `date=` folders before `oldest`; returns how many were removed.

    Retention on stored snapshots drops partitions instead of rewriting the kept rows. Days lie
    above batches, so only the names of the stored days are listed, however many batches there are.
    """
    fs, pattern = _folder(spark, f"{path}/date=*")
    removed = 0
    for status in fs.globStatus(pattern) or []:
        day = unquote(status.getPath().getName().removeprefix("date="))
        if day < oldest.isoformat() and not day.startswith("__"):
            fs.delete(status.getPath(), True)
            removed += 1
    return removed


def _folder(spark: SparkSession, path: str):
    """The file system and the path, whatever store it is in."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def publish_mart(df: DataFrame, path: str, version: int, keep: int = 2) -> None:
    """Write a mart version to its own folder, then record it; readers never see a part.

    The newest `keep` versions stay, so that a reader of the one before is not cut off.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    marker = spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
    marker.coalesce(1).write.mode("overwrite").parquet(f"{path}-versions/version_file={version}")
    _drop_old_folders(spark, f"{path}-versions/version_file=*", keep)
    _drop_old_folders(spark, f"{path}/version=*", keep)


def _drop_old_folders(spark: SparkSession, pattern: str, keep: int) -> None:
    """Delete all but the `keep` folders with the highest number after the equals sign."""
    fs, found = _folder(spark, pattern)
    paths = [status.getPath() for status in fs.globStatus(found) or []]
    for old in sorted(paths, key=lambda p: int(p.getName().split("=")[1]))[:-keep]:
        fs.delete(old, True)


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The newest completely written version of a mart, None before the first."""
    if not folder_exists(spark, f"{path}-versions"):
        return None
    return spark.read.schema("version BIGINT").parquet(f"{path}-versions").agg(F.max("version")).first()[0]


def read_mart(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest completely written version of a mart, or the one named."""
    return spark.read.parquet(f"{path}/version={newest_version(spark, path) if version is None else version}")


def update_embeddings(news: DataFrame, vectors: DataFrame) -> DataFrame:
    """News with newly computed vectors (id, embedding) filled in; present vectors stay."""
    fresh = vectors.select("id", F.col("embedding").alias("_new"))
    joined = news.join(fresh, "id", "left")
    return joined.withColumn("embedding", F.coalesce("embedding", "_new")).select(*news.columns)
