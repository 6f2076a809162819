"""Language identification with language-bitmask n-gram filters.

Training counts, per language, the documents that hold each character n-gram. The n-grams of a
language enter a bit-sliced Bloom filter: a table with ceil(languages / 64) 64-bit words a slot, in
which bit l % 64 of word l // 64 belongs to language l. One lookup ANDs the words at an n-gram's places and so returns all languages that
contain it. A text's popcount per language, corrected for that language's false positive rate,
is the share of its n-grams the language knows; the largest share decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

WORD = re.compile(r"[^\W\d_]+")
SIZE = 4  # characters of an n-gram, word ends included
PROBES = 3
WORD_BITS = 64
SPAN = 1 << 20  # characters looked up at a time
SLOTS_PER_GRAM = 16  # of the language with most n-grams
MOST_TABLE_BYTES = 1 << 27  # of the table, which travels to every task
MOST_GRAMS = 8_000_000  # of all languages together, which meet in the driver


def grams(text: str) -> np.ndarray:
    """One 64-bit hash per character n-gram of the lower-cased words, in text order."""
    spaced = f" {' '.join(WORD.findall(text.lower()))} "
    codes = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    count = len(codes) - SIZE + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(SIZE):
        out = (out + codes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def places(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(slots - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass
class LanguageFilter:
    """`languages` (most frequent first), the word table and each language's false positive rate."""

    languages: list[str]
    table: np.ndarray  # (slots,) or (slots, words)
    false_rate: np.ndarray | None = None

    def __post_init__(self):
        if self.false_rate is None:
            words = self.table.reshape(len(self.table), -1)
            fill = [float((words[:, w] >> bit & np.uint64(1)).mean()) for w, bit in self._bits()]
            self.false_rate = np.asarray(fill) ** PROBES

    def _bits(self) -> list[tuple[int, np.uint64]]:
        return [(l // WORD_BITS, np.uint64(l % WORD_BITS)) for l in range(len(self.languages))]

    @classmethod
    def build(cls, languages: list[str], members: dict[str, np.ndarray]) -> LanguageFilter:
        sizes = [len(members.get(l, ())) for l in languages]
        words = max(1, -(-len(languages) // WORD_BITS))
        # A language fills its own bits only, so the largest one decides; a table that would be too
        # large gets fewer slots and more false positives, which are corrected.
        slots = 1 << max(10, int(SLOTS_PER_GRAM * max([1, *sizes]) - 1).bit_length())
        while 8 * words * slots > MOST_TABLE_BYTES and slots > 1024:
            slots //= 2
        table = np.zeros((slots, words), np.uint64)
        for l, language in enumerate(languages):
            for at in places(members.get(language, np.zeros(0, np.uint64)), slots):
                table[at, l // WORD_BITS] |= np.uint64(1) << np.uint64(l % WORD_BITS)
        return cls(languages, table)

    def shares(self, text: str) -> np.ndarray:
        """Per language the corrected share of the text's n-grams that it contains."""
        found = grams(text)
        hits = np.zeros(len(self.languages))
        words = self.table.reshape(len(self.table), -1)
        span = max(1, SPAN // words.shape[1])
        for start in range(0, len(found), span):
            first, *rest = places(found[start : start + span], len(words))
            masks = words[first]
            for at in rest:
                masks &= words[at]
            columns = np.ascontiguousarray(masks.T)
            hits += [np.count_nonzero(columns[w] & (np.uint64(1) << bit)) for w, bit in self._bits()]
        seen = hits / max(1, len(found))
        return np.clip((seen - self.false_rate) / np.maximum(1e-9, 1 - self.false_rate), 0.0, 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); ("und", 0) if the text is null or has no letter, or none was learned."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        shares = self.shares(text)
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def learn(
    labelled: DataFrame, docs_per_language: int = 1500, grams_per_language: int = 100_000, least_docs: int = 3
) -> LanguageFilter:
    """Fit the filter on (doc_id, text, lang) rows; rows with a null text or lang are left out.

    The fit reads a bounded sample: about `docs_per_language` whole texts per language, chosen by
    the hash of doc_id, and keeps the `grams_per_language` n-grams found in most of them (at least
    `least_docs`; fewer if a language has fewer documents; an equal share of MOST_GRAMS if there
    are very many languages). Every language is learned.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(
        F.xxhash64(F.col("doc_id").cast("string")).alias("draw"), F.col("text").cast("string").alias("text"), "lang"
    )
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    sizes = {r.lang: r.n for r in counts.collect()}
    if not sizes:
        return LanguageFilter([], np.zeros(1024, np.uint64))
    scale = 1 << 20
    limits = F.broadcast(
        labelled.sparkSession.createDataFrame(
            [(l, min(scale, scale * docs_per_language // n + 1), min(least_docs, 1 + n // 10)) for l, n in sizes.items()],
            "lang string, share long, floor long",
        ).coalesce(1)
    )
    chosen = rows.join(limits, "lang").where(F.pmod("draw", F.lit(scale)) < F.col("share"))

    def count(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets: dict[str, list] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    sets.setdefault(lang, []).append(np.unique(grams(text)))
                for lang, found in sets.items():
                    gram, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())],
                        ["lang", "gram", "n"],
                    )

    totals = (
        chosen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    grams_per_language = max(1, min(grams_per_language, MOST_GRAMS // len(sizes)))
    top = (
        totals.join(limits, "lang").where(F.col("n") >= F.col("floor"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= grams_per_language)
        .select("lang", "gram")
        .toArrow()
    )
    languages, hashes = list(sizes), top["gram"].to_numpy().view(np.uint64)
    numbers = pc.index_in(top["lang"], pa.array(languages, pa.string())).to_numpy()
    order = np.argsort(numbers, kind="stable")
    parts = np.split(hashes[order], np.searchsorted(numbers[order], np.arange(1, len(languages))))
    return LanguageFilter.build(languages, dict(zip(languages, parts)))


def predict(docs: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score (0 to 1), from the text alone.

    Null texts and texts without a letter are "und" with score 0; equal shares go to the language
    with more training rows. Repeated rows and null keys are rows like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.false_rate))

    def batches(stream):
        model = LanguageFilter(*shared.value)
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [model.predict(t) for t in part.column(1).to_pylist()]
                names, scores = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of (doc_id, text, lang) that are not held out, predict all rows."""
    rows = docs.select("doc_id", "text", "lang")
    model = learn(rows.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(rows, model).withColumn("held_out", held_out())


def accepted(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """`docs` without those that are in no learned language: "und", or a share below `least_score`.

    All columns stay as they were. With nothing to learn from, only null and letterless texts go.
    """
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.false_rate))

    def keep(stream):
        model = LanguageFilter(*shared.value)
        for texts in stream:
            out = []
            for text in texts.to_pylist():
                if model.languages:
                    name, score = model.predict(text)
                    out.append(name != "und" and score >= least_score)
                else:
                    out.append(bool(text) and any(map(str.isalpha, text)))
            yield pa.array(out, pa.bool_())

    keep.__annotations__ = {"stream": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(F.arrow_udf(keep, "boolean")(F.col("text").cast("string")))
