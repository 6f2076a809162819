"""Keyword search: all stemmed terms of a query must occur; documents are ranked by BM25.

Works from a postings table: one row per document and term with its count and the document's
number of words, and one row with the empty term per document. The table can be built for the
terms of a query batch, or written once, bucketed by term, and read back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions import texts
from quotemill.functions.texts import IRREGULAR_STEMS, STOP_WORDS, Stems
from quotemill.operators.joins import join_summary, settled

# The usual BM25 constants: saturation of the term count and weight of the text length.
K1, B = 1.2, 0.75
NO_TERM = ""
DOCS_AT_ONCE = 256
LISTED_AT_ONCE = 1_000_000  # so many words of a task are gathered by term before they move
SHIPPED_TERMS = 100_000  # so many wanted terms travel with the job, more meet the postings in a join
COLUMNS = ["id", "published_at", "term", "tf", "length"]
POSTINGS = "id BIGINT, published_at TIMESTAMP_NTZ, term STRING, tf INT, length INT"
LISTS = "term STRING, docs INT, entries ARRAY<STRUCT<id: BIGINT, published_at: TIMESTAMP_NTZ, tf: INT, length: INT>>"


def search_text(title: str = "title", description: str = "description") -> Column:
    return F.concat(F.col(title), F.lit(" "), F.coalesce(F.col(description), F.lit("")))


class TermCounter:
    """Counts the stems of texts without stop words; with `wanted` only those stems."""

    def __init__(self, wanted: frozenset[str] | None = None):
        self.stop, self.stems, self.wanted = frozenset(STOP_WORDS), Stems(), wanted
        if wanted is None:
            self.stems.update(dict.fromkeys(STOP_WORDS))  # all stop words are counted as None
        # A stem begins like its word, so most words need not be stemmed to see that none wants them.
        self.beginnings = None if wanted is None else {t[:2] for t in wanted}

    def count(self, text: str | None) -> tuple[Counter, int]:
        """Count of each stem, and the number of all words."""
        words = texts.lower_words(text or "")
        if self.wanted is None:
            counts = Counter(map(self.stems.__getitem__, words))
            return counts, len(words) - counts.pop(None, 0)
        counts = Counter()
        length = 0
        for word, n in Counter(words).items():
            if word in self.stop:
                continue
            length += n
            if word[:2] in self.beginnings or word in IRREGULAR_STEMS:
                stem = self.stems[word]
                if stem in self.wanted:
                    counts[stem] += n
        return counts, length


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term) of the distinct queries; a query of stop words only has no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter()
        for batch in batches:
            pairs = [(q, t) for q in batch.column(0).to_pylist() for t in counter.count(q)[0]]
            names, terms = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_pydict({"query": pa.array(names, pa.string()), "term": pa.array(terms, pa.string())})

    return settled(queries.select("query").distinct().mapInArrow(run, "query string, term string"))


def postings(docs: DataFrame, text: Column, terms: DataFrame | None = None) -> DataFrame:
    """(id, published_at, term, tf, length) of every document, and one row with the empty term.

    Texts are split, stemmed and counted where they are read: no text is shuffled, and a word
    is stemmed once per task. With `terms` only those terms are kept: up to SHIPPED_TERMS of them
    travel with the job (looking that up is a job of its own), more are joined.
    """
    wanted = None
    if terms is not None:
        few = terms.select("term").distinct().limit(SHIPPED_TERMS + 1).collect()
        if len(few) <= SHIPPED_TERMS:
            wanted = frozenset(r["term"] for r in few)

    found = _texts(docs, text).mapInArrow(lambda batches: _counted(batches, wanted), POSTINGS)
    return found if wanted is not None else _of_terms(found, terms)


def _texts(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.col("id").cast("bigint").alias("id"), F.col("published_at").cast("timestamp_ntz").alias("published_at"), text.alias("text"))


def _counted(batches: Iterator[pa.RecordBatch], wanted: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Postings of (id, published_at, text) batches."""
    counter = TermCounter(wanted)
    for batch in batches:
        for start in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(start, DOCS_AT_ONCE)
            owners, found, counts, lengths = [], [], [], []
            for owner, content in enumerate(part.column(2).to_pylist()):
                terms_of, length = counter.count(content)
                owners.extend([owner] * (len(terms_of) + 1))
                found.extend([*terms_of, NO_TERM])
                counts.extend([*terms_of.values(), 0])
                lengths.extend([length] * (len(terms_of) + 1))
            at = pa.array(owners, pa.int32())
            columns = [part.column(0).take(at), part.column(1).take(at), pa.array(found, pa.string())]
            columns += [pa.array(counts, pa.int32()), pa.array(lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, COLUMNS)


def posting_lists(docs: DataFrame, text: Column) -> DataFrame:
    """`postings` of every document as (term, docs, entries): some documents' entries of a term in one row."""
    return _texts(docs, text).mapInArrow(_gathered, LISTS)


def listed(index: DataFrame) -> DataFrame:
    """The rows of `postings` as `posting_lists`."""
    return index.select(*COLUMNS).mapInArrow(_listed, LISTS)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (id, published_at, text) batches, LISTED_AT_ONCE words at a time, sorted by term.

    Fewer and shorter rows are shuffled, and sorting them again merges sorted runs. Words are
    counted as numbers; each distinct word is stemmed once per task.
    """
    stems = TermCounter().stems
    owners, found, sizes, size = [], [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(start, DOCS_AT_ONCE)
            words = []
            for content in part.column(2).to_pylist():
                of_text = texts.lower_words(content or "")
                words += of_text
                sizes.append(len(of_text))
            owners.append(part.select([0, 1]))
            found.append(pa.array(words, pa.string()))
            size += len(words)
            if size >= LISTED_AT_ONCE or len(sizes) >= LISTED_AT_ONCE:
                yield _lists_of_words(owners, found, sizes, stems)
                owners, found, sizes, size = [], [], [], 0
    if sizes:
        yield _lists_of_words(owners, found, sizes, stems)


def _lists_of_words(owners: list[pa.RecordBatch], found: list[pa.Array], sizes: list[int], stems: dict) -> pa.RecordBatch:
    words = pa.chunked_array(found, pa.string()).combine_chunks().dictionary_encode()
    terms = pa.array([stems[w] for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    order = pc.sort_indices(terms.dictionary).to_numpy()
    # The empty term of all documents comes first, stop words have no place.
    place = np.full(len(order) + 1, -1, np.int64)
    place[order] = np.arange(1, len(order) + 1)
    of_word = place[terms.indices.fill_null(len(order)).to_numpy()]
    places, owner = of_word[words.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
    places, owner = places[places > 0], owner[places > 0]
    lengths = np.bincount(owner, minlength=len(sizes)).astype(np.int32)
    keys, counts = np.unique(places * len(sizes) + owner, return_counts=True)
    owner = np.concatenate([np.arange(len(sizes)), keys % len(sizes)])
    docs = np.concatenate([[len(sizes)], np.bincount(keys // len(sizes), minlength=len(order) + 1)[1:]])
    tf = np.concatenate([np.zeros(len(sizes), np.int32), counts.astype(np.int32)])
    whole = pa.Table.from_batches(owners).take(pa.array(owner)).combine_chunks()
    columns = [whole.column(0), whole.column(1), pa.array(tf), pa.array(lengths[owner])]
    names = pa.concat_arrays([pa.array([NO_TERM]), terms.dictionary.take(pa.array(order))])
    return _list_batch(names, docs, columns)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings gathered by term, LISTED_AT_ONCE at a time, sorted by term."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= LISTED_AT_ONCE:
            yield _lists_of_rows(held)
            held, size = [], 0
    if size:
        yield _lists_of_rows(held)


def _lists_of_rows(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    terms = rows["term"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(terms.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    places = place[terms.indices.to_numpy()]
    whole = rows.select(["id", "published_at", "tf", "length"]).take(pa.array(np.argsort(places, kind="stable")))
    return _list_batch(terms.dictionary.take(pa.array(order)), np.bincount(places, minlength=len(order)), whole.columns)


def _list_batch(names: pa.Array, docs: np.ndarray, columns: list) -> pa.RecordBatch:
    """One row per name with so many of the entries, which lie in the order of the names."""
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    entries = pa.StructArray.from_arrays(flat, ["id", "published_at", "tf", "length"])
    bounds = pa.array(np.concatenate([[0], np.cumsum(docs)]), pa.int32())
    lists = pa.ListArray.from_arrays(bounds, entries)
    return pa.RecordBatch.from_arrays([names, pa.array(docs, pa.int32()), lists], ["term", "docs", "entries"])


def _of_terms(index: DataFrame, terms: DataFrame | None) -> DataFrame:
    if terms is None:
        return index
    none = terms.sparkSession.range(1).select(F.lit(NO_TERM).alias("term"))
    wanted = settled(terms.select("term").unionByName(none).distinct())
    return index.join(wanted, "term", "left_semi").select(*COLUMNS)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write_postings(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Store postings in term buckets, sorted by term inside each file.

    Rebalancing joins small buckets in one task and splits a bucket whose term is found
    in a third of all documents over many.
    """
    bucketed = index.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
    bucketed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: DataFrame, buckets: int = 64) -> DataFrame:
    """Postings of the query terms: only their buckets are read, which are at most `buckets` numbers."""
    none = spark.range(1).select(F.lit(NO_TERM).alias("term"))
    used = terms.select("term").unionByName(none).select(_bucket(buckets).alias("b")).distinct()
    numbers = sorted(r["b"] for r in used.collect())
    index = spark.read.schema(f"{POSTINGS}, bucket INT").parquet(path).filter(F.col("bucket").isin(numbers))
    return _of_terms(index.drop("bucket"), terms)


def matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, id, published_at, relevance) of documents that hold every term of a query.

    A document meets only the queries whose rarest term it holds, and the other terms are looked
    up in its own map, so a frequent word does not pair every document with every query that
    mentions it. The postings of the queries' terms are stored once, as they are read three times;
    this call runs that job and one for the number of documents and their mean length.
    """
    index = settled(index)
    total, words = index.filter(F.col("term") == NO_TERM).agg(F.count("*"), F.sum("length")).first()
    held = index.filter(F.col("term") != NO_TERM)
    return ranked_matches(held, terms, held.groupBy("term").agg(F.count("*").alias("n")), total, words or 0)


def ranked_matches(held: DataFrame, terms: DataFrame, spread: DataFrame, total: int, words: int) -> DataFrame:
    """`matches` from the postings of the queries' terms, the documents of each term (term, n), all documents and words."""
    mean = max(1.0, words / max(1, total))
    weight = F.log(1 + (F.lit(float(total)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = terms.join(spread, "term", "left")
    asked = weighed.groupBy("query").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "term"))["term"].alias("key_term"),
        F.array_sort(F.collect_list(F.struct("term", weight.alias("weight")))).alias("terms"),
    )
    entries = F.collect_list(F.struct("term", "tf"))
    by_document = held.groupBy("id", "published_at", "length").agg(F.map_from_entries(entries).alias("held"))
    candidates = by_document.withColumn("key_term", F.explode(F.map_keys("held"))).join(asked, "key_term")
    whole = candidates.filter(F.forall("terms", lambda t: F.map_contains_key("held", t["term"])))
    length = K1 * (1 - B + B * F.col("length") / mean)

    def part(term: Column) -> Column:
        tf = F.col("held")[term["term"]]
        return term["weight"] * tf * (K1 + 1) / (tf + length)

    rank = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + part(t))
    # Rounded, so texts with equal counts rank equal whatever the order of the sum.
    return whole.select("query", "id", "published_at", F.round(rank, 9).alias("relevance"))


def search(
    docs: DataFrame,
    queries: DataFrame,
    limit: int = 5,
    text: Column | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """The best documents per `query` by relevance, then date, then id.

    `docs` needs id and published_at; its other columns are carried to the result. The found ids
    are stored first, so the planner knows whether they are few enough to be broadcast.
    """
    text = search_text() if text is None else text
    terms = query_terms(queries)
    return best_documents(matches(postings(docs, text, terms) if index is None else index, terms), docs, limit)


def best_documents(found: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """The `limit` best rows of `ranked_matches` per query, with the documents' columns."""
    best = Window.partitionBy("query").orderBy(F.desc("relevance"), F.desc_nulls_first("published_at"), "id")
    top = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
    return join_summary(docs, settled(top.select("query", "place", "id", "relevance")), "id")


def _cut(text: Column, size: int | None) -> Column:
    return text if size is None else F.left(text, F.lit(size))


def news_context(found: DataFrame, text_length: int | None = None) -> DataFrame:
    """Dated article lines per query, in rank order; a query has at most its search limit of rows.

    `text_length` cuts the descriptions for a model with a short context.
    """
    line = F.concat(
        F.lit("- ["), F.coalesce(F.left(F.col("published_at").cast("string"), F.lit(10)), F.lit("None")), F.lit("] "),
        F.col("title"), F.lit(": "), _cut(F.coalesce("description", F.lit("None")), text_length),
    )
    return _joined_lines(found, "query", line, "\n")


def source_context(found: DataFrame, key: str = "question", text_length: int | None = None) -> DataFrame:
    """Numbered source blocks per question, in rank order; see `news_context` for `text_length`."""
    block = F.concat(
        F.lit("Źródło "), F.col("place").cast("string"), F.lit(": "), F.col("title"), F.lit("\n"),
        _cut(F.coalesce("description", F.lit("")), text_length),
    )
    return _joined_lines(found, key, block, "\n\n")


def _joined_lines(found: DataFrame, key: str, line: Column, glue: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return found.groupBy(key).agg(
        F.count("*").alias("articles_found"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), glue).alias("context"),
    )
