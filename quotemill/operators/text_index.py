"""Keyword index that grows by segments: a batch adds one, none is ever rewritten.

    postings/name=S/bucket=B   posting lists of segment S by bucket of the term; a term has several
    counts/name=S/bucket=B     documents per term in S; negative for a list of deletions
    deleted/name=D             ids of the deletion list D
    catalog/version=V          one row per live segment and list with its documents and words

A search sums the catalogue for the number of documents and their mean length, the counts for the
documents of each term, and reads the postings of its own term buckets only. A segment or list is
seen once the next catalogue names it, so readers never meet half of one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import keyword
from quotemill.operators.joins import settled
from quotemill.sources import sinks

CATALOG = "kind STRING, name STRING, documents BIGINT, words BIGINT"
COUNTS = "term STRING, n BIGINT"


def _rows(lists: DataFrame) -> DataFrame:
    """One row per entry, as in `keyword.postings`."""
    return lists.select("term", F.inline("entries"))


@dataclass(frozen=True)
class TextIndex:
    """An index below `path`; the number of buckets stays that of its first segment."""

    path: str
    buckets: int = 64

    def add(self, docs: DataFrame, segment: str, text: Column | None = None) -> None:
        """Index one batch (id, published_at, texts). The batch again replaces its own segment.

        An id belongs to one segment; ids in other segments are not looked for.
        """
        spark = docs.sparkSession
        text = keyword.search_text() if text is None else text
        self._write_lists(keyword.posting_lists(docs, text), segment)
        self._publish(spark, "segment", segment, *self._segment_size(spark, segment))

    def delete(self, ids: DataFrame, name: str) -> None:
        """Take the documents of a list of ids out; the list again replaces itself.

        Ids that are unknown or deleted by another list have no effect.
        """
        spark = ids.sparkSession
        wanted = settled(ids.select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL").distinct())
        others = [n for n in self._names(spark, "deletes") if n != name]
        gone = self._without_deleted(self._postings(spark, self._names(spark, "segment")), others)
        gone = settled(gone.join(wanted, "id", "left_semi"))
        docs, words = self._size(gone)
        gone.where(F.col("term") == keyword.NO_TERM).select("id").write.mode("overwrite").parquet(f"{self.path}/deleted/name={name}")
        taken = gone.where(F.col("term") != keyword.NO_TERM).groupBy("term").agg((-F.count("*")).alias("n"))
        self._write_counts(taken, name)
        self._publish(spark, "deletes", name, -docs, -words)

    def merge(self, spark: SparkSession, name: str) -> None:
        """Write all live documents as one new segment that takes the place of segments and lists."""
        segments, lists = self._names(spark, "segment"), self._names(spark, "deletes")
        if name in segments:
            raise ValueError("the merged segment needs a name of its own")
        self._write(self._without_deleted(self._postings(spark, segments), lists), name)
        size = self._segment_size(spark, name)
        version = sinks.newest_version(spark, f"{self.path}/catalog") or 0
        rows = spark.createDataFrame([("segment", name, *size)], CATALOG)
        sinks.publish_mart(rows, f"{self.path}/catalog", version + 1)

    def matches(self, terms: DataFrame) -> DataFrame:
        """`keyword.matches` of (query, term) rows over the live documents."""
        spark = terms.sparkSession
        live = self._catalog(spark)
        total, words = live.agg(F.sum("documents"), F.sum("words")).first()
        # At most `buckets` numbers.
        used = sorted(r["b"] for r in terms.select(keyword._bucket(self.buckets).alias("b")).distinct().collect())
        wanted = settled(terms.select("term").distinct())
        inside = F.col("bucket").isin(used)
        names = self._names(spark, "segment"), self._names(spark, "deletes")
        counts = self._stored(spark, "counts", COUNTS, names[0] + names[1]).where(inside).join(wanted, "term", "left_semi")
        spread = settled(counts.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0"))
        held = _rows(self._lists(spark, names[0]).where(inside).join(wanted, "term", "left_semi"))
        held = settled(self._without_deleted(held, names[1]).select(*keyword.COLUMNS))
        return keyword.ranked_matches(held, terms, spread, total or 0, words or 0)

    def search(self, docs: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
        """The best live documents per query, with the columns of `docs`."""
        return keyword.best_documents(self.matches(keyword.query_terms(queries)), docs, limit)

    def _write(self, postings: DataFrame, name: str) -> None:
        self._write_lists(keyword.listed(postings), name)

    def _write_lists(self, lists: DataFrame, name: str) -> None:
        bucketed = lists.withColumn("bucket", keyword._bucket(self.buckets)).hint("rebalance", "bucket")
        sorted_rows = bucketed.sortWithinPartitions("bucket", "term")
        sorted_rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/name={name}")
        stored = self._lists(lists.sparkSession, [name]).where(F.col("term") != keyword.NO_TERM)
        self._write_counts(stored.groupBy("term").agg(F.sum("docs").alias("n")), name)

    def _write_counts(self, counts: DataFrame, name: str) -> None:
        bucketed = counts.withColumn("bucket", keyword._bucket(self.buckets)).repartition("bucket")
        bucketed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts/name={name}")

    def _size(self, postings: DataFrame) -> tuple[int, int]:
        """Documents and words, from the one row with the empty term per document."""
        row = postings.where(F.col("term") == keyword.NO_TERM).agg(F.count("*"), F.sum("length")).first()
        return row[0], row[1] or 0

    def _segment_size(self, spark: SparkSession, name: str) -> tuple[int, int]:
        """`_size` of a stored segment; only the bucket of the empty term is read."""
        bucket = F.pmod(F.xxhash64(F.lit(keyword.NO_TERM)), F.lit(self.buckets)).cast("int")
        return self._size(_rows(self._lists(spark, [name]).where((F.col("bucket") == bucket) & (F.col("term") == keyword.NO_TERM))))

    def _stored(self, spark: SparkSession, kind: str, schema: str, names: list[str]) -> DataFrame:
        """Rows of some segments; folders without any row have no schema of their own."""
        if not names:
            return spark.createDataFrame([], f"{schema}, bucket INT")
        reader = spark.read.schema(f"{schema}, bucket INT")
        # Each segment on its own, so their bucket folders are partitions and nothing else is listed.
        return reduce(DataFrame.unionByName, [reader.parquet(f"{self.path}/{kind}/name={n}") for n in names])

    def _lists(self, spark: SparkSession, names: list[str]) -> DataFrame:
        return self._stored(spark, "postings", keyword.LISTS, names)

    def _postings(self, spark: SparkSession, names: list[str]) -> DataFrame:
        return _rows(self._lists(spark, names))

    def _without_deleted(self, postings: DataFrame, lists: list[str]) -> DataFrame:
        if not lists:
            return postings
        gone = postings.sparkSession.read.schema("id BIGINT").parquet(*[f"{self.path}/deleted/name={n}" for n in lists])
        return postings.join(gone, "id", "left_anti")

    def _catalog(self, spark: SparkSession) -> DataFrame:
        if sinks.newest_version(spark, f"{self.path}/catalog") is None:
            return spark.createDataFrame([], CATALOG)
        return sinks.read_mart(spark, f"{self.path}/catalog")

    def _names(self, spark: SparkSession, kind: str) -> list[str]:
        return sorted(r["name"] for r in self._catalog(spark).where(F.col("kind") == kind).collect())

    def _publish(self, spark: SparkSession, kind: str, name: str, documents: int, words: int) -> None:
        version = sinks.newest_version(spark, f"{self.path}/catalog") or 0
        kept = self._catalog(spark).where((F.col("kind") != kind) | (F.col("name") != name))
        row = spark.createDataFrame([(kind, name, documents, words)], CATALOG)
        sinks.publish_mart(kept.unionByName(row).coalesce(1), f"{self.path}/catalog", version + 1)
