"""Membership filters of a store's keys, one per day, beside the data.

    filters/date=D/batch_id=B    (bucket, bitmap): which hashes of the keys of batch B occur on day D

A key sets one of `buckets` x 32,768 bits. An incoming key whose bit no day holds is new for
certain; the others meet, exactly, the rows of the days that hold their bits, and no other day is
read. A full filter only sends more days into that join.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.joins import settled
from quotemill.sources import sinks

BITS = 32_768  # of one bitmap, as Spark's bitmap functions have it
BUCKETS = 256
SCHEMA = "bucket INT, bitmap BINARY, date DATE, batch_id BIGINT"


def _hash(key: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in key])


def _places(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """`rows` with the bucket and the bit of their key; keys with a null part are left out."""
    known = rows.dropna(subset=key)
    bit = F.shiftrightunsigned(_hash(key), 40) % BITS
    return known.withColumns({"bucket": F.pmod(_hash(key), F.lit(buckets)).cast("int"), "bit": bit.cast("int")})


def write_filters(rows: DataFrame, path: str, batch_id: int, key: list[str], day: Column, buckets: int = BUCKETS) -> None:
    """Store the filters of one batch's rows; the batch again replaces its own.

    Partial bitmaps are built where the rows are, so a key or a day with most rows sends a bitmap
    a task and bucket.
    """
    placed = _places(rows.withColumn("date", day), key, buckets)
    bitmaps = placed.groupBy("date", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    sinks.write_batch(bitmaps, path, batch_id, F.col("date"))


def _holds(bitmap: Column, bit: Column) -> Column:
    """Whether a bitmap has a bit set."""
    byte = F.conv(F.hex(F.substr(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(_power(bit)) != 0


def _power(bit: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8).cast("int") + 1)


def possible_days(spark: SparkSession, path: str, rows: DataFrame, key: list[str], but_batch: int | None = None, buckets: int = BUCKETS) -> list[date | None] | None:
    """The stored days that may hold a key of `rows`, at most as many as the store has days.

    None if there are no filters yet: then every day may.
    """
    if not sinks.folder_exists(spark, path):
        return None
    stored = spark.read.schema(SCHEMA).parquet(path)
    if but_batch is not None:
        stored = stored.where(F.col("batch_id") != but_batch)
    asked = settled(_places(rows, key, buckets).select("bucket", "bit").distinct())
    hits = stored.join(asked, "bucket").where(_holds(F.col("bitmap"), F.col("bit")))
    return sorted((r["date"] for r in hits.select("date").distinct().collect()), key=lambda d: (d is None, d or date.min))


def on_days(days: list[date | None]) -> Column:
    """The rows of some days, as a filter on the `date` partitions."""
    chosen = F.col("date").isin([d for d in days if d is not None]) if any(days) else F.lit(False)
    return chosen | F.col("date").isNull() if None in days else chosen


def insert_if_absent(
    stored: DataFrame, filters: str, incoming: DataFrame, key: list[str], order: list[Column], but_batch: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """`sinks.insert_if_absent` that reads the days of `stored` (with its `date`) that may hold a key."""
    fresh = settled(sinks.keep_first(incoming, key, order))
    days = possible_days(incoming.sparkSession, filters, fresh, key, but_batch, buckets)
    if days == []:
        return fresh
    known = (stored if days is None else stored.where(on_days(days))).select(*key)
    return fresh.join(known, key, "left_anti").select(*incoming.columns)
