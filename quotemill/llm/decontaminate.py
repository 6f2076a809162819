"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

A document is signed with one permutation: its shingle hashes fall into 2^p bins by their top
bits and each bin keeps its smallest hash. p is the document's size partition, the power of two
next to its number of shingles (plus `finer`), so a document of any length keeps a like share of
its shingles and a short item inside a long document is not drowned. An item is signed for every
partition at once: a hash that is the smallest of its bin stays so in finer bins, so each hash of
an item is kept with the first p from which it belongs to the signature. One bin in common makes a
candidate; candidates are verified by counting the shingles they share. All of it is DataFrame
functions.
"""

from __future__ import annotations

from math import ceil, exp

from pyspark.sql import Column, DataFrame, functions as F

from quotemill.llm.common import let, saved

WORD_GAP = r"[^\p{L}\p{N}]+"
MISS = 1e-6  # highest chance that an item at the threshold shares no bin
ALL_BITS = 62  # as many bins as hashes: nothing is lost
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def shingles(words: Column, size: int) -> Column:
    """The word shingles as strings, repeats included; one shingle if there are fewer words."""
    return let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))),
                lambda i: F.concat_ws(" ", F.slice(w, i, size)),
            )
        ),
    )


def hashes(words: Column, size: int) -> Column:
    """Sorted distinct 64-bit hashes of the shingles, each hashed from its words' hashes."""
    span = lambda w, i: F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(size)])
    each = let(
        F.transform(words, lambda x: F.xxhash64(x)),
        lambda w: F.when(F.size(w) == 0, w).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: span(w, i))
        ),
    )
    return F.sort_array(F.array_distinct(each))


def partition_of(count: Column, finer: int) -> Column:
    """Size partition: the power of two that is at least `count`, `finer` steps up."""
    return F.least(F.lit(ALL_BITS), F.ceil(F.log2(F.greatest(count, F.lit(2)))).cast("int") + finer)


def signature(sorted_hashes: Column, p: Column) -> Column:
    """The smallest hash of each of 2^p bins; the input is sorted, bins are the top p bits."""
    bin_of = lambda h, drop: F.call_function("shiftrightunsigned", h, drop)
    firsts = lambda s, drop: F.filter(
        s, lambda h, i: (i == 0) | (bin_of(h, drop) != bin_of(F.get(s, i - F.lit(1)), drop))
    )
    return let(64 - p, lambda drop: let(sorted_hashes, lambda s: firsts(s, drop)))


def first_partitions(sorted_hashes: Column) -> Column:
    """(h, since) of sorted hashes: with p >= since, h is the smallest of its bin.

    That is so once the bin is too narrow to hold the hash before it, that is, once p exceeds the
    number of leading bits the two have in common.
    """
    shared = lambda a, b: 64 - F.length(F.bin(a.bitwiseXOR(b)))
    return let(
        sorted_hashes,
        lambda s: F.transform(
            s,
            lambda h, i: F.struct(
                h.alias("h"), F.when(i == 0, 0).otherwise(shared(h, F.get(s, i - F.lit(1))) + 1).alias("since")
            ),
        ),
    )


def finer_steps(shortest: int, containment: float, miss: float = MISS) -> int:
    """How many times to double the bins so that an item of `shortest` shingles is found.

    With `load` hashes per bin a shingle survives with (1 - e^-load) / load; an item at the
    threshold is missed only if none of its shared shingles survives.
    """
    shared = max(1, ceil(containment * shortest - 1e-9))
    for steps in range(16):
        load = 0.5**steps
        if (1 - (1 - exp(-load)) / load) ** shared <= miss:
            return steps
    return ALL_BITS


def candidates(docs: DataFrame, items: DataFrame, size: int, containment: float) -> DataFrame:
    """Distinct (doc_id, item_id) pairs that share a bin, from (doc_id, text) and (item_id, words)."""
    signed_items = items.select("item_id", hashes(F.col("words"), size).alias("s")).where(F.size("s") > 0)
    shortest, count = signed_items.agg(F.min(F.size("s")), F.sum(F.size("s"))).first()
    finer = finer_steps(shortest or 1, containment)
    p = partition_of(F.size("s"), finer)
    signed = docs.select("doc_id", hashes(words_of(F.col("text")), size).alias("s"))
    bins = signed.select("doc_id", p.alias("p"), F.explode(signature(F.col("s"), p)).alias("h"))
    item_bins = signed_items.select("item_id", F.explode(first_partitions(F.col("s"))).alias("b"))
    item_bins = item_bins.select("item_id", "b.h", "b.since")
    if (count or 0) * 64 <= BROADCAST_BYTES:
        item_bins = F.broadcast(item_bins)
    return bins.join(item_bins, "h").where("p >= since").select("doc_id", "item_id").distinct()


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 5,
    containment: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): items of which a document holds enough.

    Words are runs of letters and digits in lower case. An item is found in a document that has at
    least `containment` of its distinct `size`-word shingles; a text with fewer words is one
    shingle of all its words. Null, empty and wordless texts and null ids are in no pair. Rows that
    repeat an id count as that id, with the best of them. Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), words_of(F.col(item_text)).alias("words"))
    items = saved(items.where(F.col("item_id").isNotNull() & (F.size("words") > 0)).distinct(), "benchmark")
    pairs = saved(candidates(rows, items, size, containment), "candidates")
    wanted = items.select("item_id", F.array_distinct(shingles(F.col("words"), size)).alias("wanted"))
    met = rows.join(pairs, "doc_id").join(wanted, "item_id")
    counted = met.select(
        "doc_id",
        "item_id",
        F.size(F.array_intersect("wanted", shingles(words_of(F.col("text")), size))).cast("long").alias("n_shared"),
        F.size("wanted").cast("long").alias("n_shingles"),
    ).where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(float(containment)) - 1e-9))
    best = F.max(F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared", "n_shingles")).alias("m")
    return counted.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_shared", "m.n_shingles")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 5, containment: float = 0.8) -> DataFrame:
    """`docs` without the documents that hold a benchmark item; all columns as they were."""
    found = contained_items(docs, benchmark, size, containment).select("doc_id").distinct()
    return docs.join(saved(found, "contaminated"), "doc_id", "left_anti")
