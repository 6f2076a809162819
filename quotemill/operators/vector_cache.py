"""Vectors by content: a text is encoded once per model, whatever articles repeat it.

    cache/model=M/bucket=B/...   (digest of the text, vector), written once, by digest bucket

An encoder call looks the digests of its distinct texts up, encodes those the cache lacks, adds
them and joins the vectors back to the ids. Texts are read once while the cache is empty or has
them all; only digests and ids are shuffled, and texts that are repeated very often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators.embed import Encoder
from quotemill.operators.joins import settled
from quotemill.session import new_work_dir
from quotemill.sources import sinks

BUCKETS = 64


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _numbered(texts: DataFrame) -> DataFrame:
    return settled(texts.withColumn("row", F.monotonically_increasing_id()))


def _one_per_digest(numbered: DataFrame) -> DataFrame:
    """One row per digest of a stored frame; rows are chosen by number, so no text is sorted or folded.

    The shorter list, of the chosen rows or of the others, meets the texts: below the broadcast
    threshold it is broadcast and no text is shuffled.
    """
    firsts = settled(numbered.groupBy("digest").agg(F.min("row").alias("row")).select("row"))
    if 2 * firsts.count() <= numbered.count():
        return numbered.join(firsts, "row", "left_semi")
    others = settled(numbered.select("row").join(firsts, "row", "left_anti"))
    return numbered.join(others, "row", "left_anti")


def cached_encoder(encode: Encoder, path: str, model: str, buckets: int = BUCKETS) -> Encoder:
    """An encoder (id, text) -> (id, embedding) that keeps vectors below `path`, by model version.

    `encode` gets (id, text) with the digest of each distinct text as its id, so it must pass text
    ids through. A null text has no vector. Two calls at once may both add a text; readers take
    one of equal digests. Vectors of a model version never change; a new version starts its own.
    """
    folder = f"{path}/model={model}"

    def stored(spark, wanted: DataFrame) -> DataFrame:
        schema = "digest STRING, embedding ARRAY<FLOAT>, bucket INT"
        if not sinks.folder_exists(spark, folder):
            return spark.createDataFrame([], schema).select("digest", "embedding")
        used = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most `buckets`
        held = spark.read.schema(schema).parquet(folder).where(F.col("bucket").isin(used))
        return held.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]).select("digest", "embedding")

    def run(texts: DataFrame) -> DataFrame:
        spark = texts.sparkSession
        rows = texts.select("id", "text").withColumn("digest", _digest(F.col("text")))
        bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")
        # The texts are stored where all are new; else the digests alone, and then the texts the cache lacks.
        empty = not sinks.folder_exists(spark, folder)
        held = _numbered(rows) if empty else settled(rows.select("id", "digest"))
        wanted = settled(held.where("digest IS NOT NULL").select("digest").distinct().withColumn("bucket", bucket))
        known = settled(stored(spark, wanted))
        fresh = settled(wanted.join(known, "digest", "left_anti").select("digest"))
        vectors = known
        if empty or not fresh.isEmpty():
            lacking = held.where("digest IS NOT NULL") if empty else _numbered(rows.join(fresh, "digest", "left_semi"))
            made = encode(_one_per_digest(lacking).select(F.col("digest").alias("id"), "text"))
            made = made.select(F.col("id").alias("digest"), F.col("embedding").cast("array<float>").alias("embedding"))
            part = new_work_dir(spark, "vectors-made")
            made.write.parquet(part)
            made = spark.read.schema("digest STRING, embedding ARRAY<FLOAT>").parquet(part)
            made.withColumn("bucket", bucket).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)
            vectors = known.unionByName(made)
        return held.join(vectors, "digest", "left").select("id", "embedding")

    return run
