"""Toxicity categories by a classifier chain.

One linear model per category, in a fixed order. A model sees the words of the text and the
probabilities of the categories before it. In training these probabilities are out-of-fold: each
row's come from models that have not seen the row, as they will for new texts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"[^\W\d_]+")
STEM = 5  # characters of the word beginnings that count as features of their own
FOLDS = 3
STEPS = 80
PENALTY = 0.3


def features(text: str | None) -> Counter:
    """Counts of the lower-cased words and, marked by *, of the beginnings of longer ones."""
    words = Counter(WORD.findall((text or "").lower()))
    stems: Counter = Counter()
    for word, n in words.items():
        if len(word) >= STEM:
            stems[word[:STEM] + "*"] += n
    words.update(stems)
    return words


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Sparse rows: entry k belongs to row `row[k]`, feature `column[k]`, with `value[k]`.

    The entries are kept in row order and in column order, so both products are sums of runs.
    """

    def __init__(self, count: int, width: int, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.count, self.width = count, width
        self.row, self.column, self.value = row, column, value.astype(np.float32)
        self._by_row = self._runs(row, column)
        self._by_column = self._runs(column, row)

    def _runs(self, keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys that occur, where their run starts, and the other index and value of each entry."""
        order = np.argsort(keys, kind="stable")
        found, starts = np.unique(keys[order], return_index=True)
        return found, starts, others[order], self.value[order]

    @staticmethod
    def _sums(runs: tuple[np.ndarray, ...], factors: np.ndarray, size: int) -> np.ndarray:
        found, starts, others, values = runs
        out = np.zeros(size)
        if len(found):
            out[found] = np.add.reduceat(values * factors.astype(np.float32)[others], starts)
        return out

    def times(self, weights: np.ndarray) -> np.ndarray:
        return self._sums(self._by_row, weights, self.count)

    def transposed_times(self, residuals: np.ndarray) -> np.ndarray:
        return self._sums(self._by_column, residuals, self.width)


def fit_linear(rows: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by full-batch AdaGrad: (feature weights, dense weights with a bias last).

    Features are scaled by their smoothed log ratio of frequencies in the two classes, so that the
    penalty falls on words that are no sign of either.
    """
    dense = np.column_stack([dense, np.ones(len(y))])
    used = (weight > 0).astype(np.float64)
    ratio = [
        np.log((np.bincount(rows.column, (used * side)[rows.row], rows.width) + 1) / ((used * side).sum() + 2))
        for side in (y, 1 - y)
    ]
    scale = np.abs(ratio[0] - ratio[1])
    rows = Rows(rows.count, rows.width, rows.row, rows.column, rows.value * scale[rows.column])
    sparse_w, dense_w = np.zeros(rows.width), np.zeros(dense.shape[1])
    sparse_g, dense_g = np.full(rows.width, 1e-6), np.full(dense.shape[1], 1e-6)
    for _ in range(STEPS):
        error = weight * (sigmoid(rows.times(sparse_w) + dense @ dense_w) - y)
        a, b = rows.transposed_times(error) + PENALTY * sparse_w, dense.T @ error
        sparse_g += a * a
        dense_g += b * b
        sparse_w -= 0.3 * a / np.sqrt(sparse_g)
        dense_w -= 0.3 * b / np.sqrt(dense_g)
    return sparse_w * scale, dense_w


def fit_chain(rows: Rows, labels: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """One (feature weights, dense weights) pair per column of `labels`."""
    models, earlier = [], np.zeros((rows.count, 0))
    for y in labels.T:
        models.append(fit_linear(rows, earlier, y, weight))
        unseen = np.zeros(rows.count)
        for part in range(FOLDS):
            out = fold == part
            sparse_w, dense_w = fit_linear(rows, earlier, y, np.where(out, 0.0, weight))
            score = rows.times(sparse_w) + np.column_stack([earlier, np.ones(rows.count)]) @ dense_w
            unseen[out] = sigmoid(score)[out]
        earlier = np.column_stack([earlier, unseen])
    return models


@dataclass
class Chain:
    """Categories in order, feature weights per category, dense weights per category."""

    categories: list[str]
    vocabulary: dict[str, int]
    sparse: np.ndarray  # one row per feature, one column per category
    dense: list[np.ndarray]

    def predict(self, text: str | None) -> list[float]:
        found = [(self.vocabulary[f], n) for f, n in features(text).items() if f in self.vocabulary]
        at = np.fromiter((i for i, _ in found), np.int64, len(found))
        value = 1 + np.log(np.fromiter((n for _, n in found), np.float64, len(found)))
        scores = value @ self.sparse[at] if len(found) else np.zeros(len(self.categories))
        out: list[float] = []
        for score, dense in zip(scores, self.dense):
            out.append(float(sigmoid(score + np.dot(dense, [*out, 1.0]))))
        return out


def learn(
    docs: DataFrame, labels: DataFrame, categories: list[str], rows_per_stratum: int = 2000, least_docs: int = 4
) -> Chain:
    """Fit a chain on the texts of (doc_id, text) whose labels (doc_id, one 0/1 column per category) are known.

    The fit reads a bounded sample: about `rows_per_stratum` whole texts, chosen by the hash of
    doc_id, of each combination of labels; weights restore their shares. Rows with a null label
    are left out, words of fewer than `least_docs` sampled texts are no features. One task fits
    the models of the whole chain.
    """
    stratum = F.concat_ws(",", *[F.col(c).cast("int").cast("string") for c in categories])
    known = labels.dropna(subset=["doc_id", *categories]).select("doc_id", stratum.alias("stratum"))
    sizes = {r.stratum: r["count"] for r in known.groupBy("stratum").count().collect()}
    if not sizes:
        never = [np.array([0.0] * i + [-30.0]) for i in range(len(categories))]
        return Chain(categories, {}, np.zeros((0, len(categories))), never)
    scale = 1 << 20
    share = {s: min(1.0, rows_per_stratum / n) for s, n in sizes.items()}
    limits = F.create_map(*[F.lit(x) for s in share for x in (s, int(scale * share[s]) + 1)])
    known = known.withColumn("draw", F.xxhash64(F.col("doc_id").cast("string")))
    drawn = known.where(F.pmod("draw", F.lit(scale)) < limits[F.col("stratum")])
    # Bounded by the sample: about rows_per_stratum rows for each of 2 ** len(categories) strata.
    chosen = docs.join(F.broadcast(drawn), "doc_id").select("draw", F.col("text").cast("string").alias("text"), "stratum")

    def count(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [features(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([list(f) for f in found], pa.list_(pa.string())),
                        pa.array([list(f.values()) for f in found], pa.list_(pa.int32())),
                    ],
                    ["draw", "stratum", "words", "counts"],
                )

    def fit(stream):
        draws, strata, words, counts = [], [], [], []
        for batch in stream:
            for target, column in zip((draws, strata, words, counts), batch.columns):
                target.extend(column.to_pylist())
        order = sorted(range(len(draws)), key=lambda i: (draws[i], strata[i], words[i]))
        spread = Counter(w for found in words for w in found)
        vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in spread.items() if n >= least_docs))}
        row, column, value = [], [], []
        for place, i in enumerate(order):
            for word, n in zip(words[i], counts[i]):
                if word in vocabulary:
                    row.append(place)
                    column.append(vocabulary[word])
                    value.append(n)
        rows = Rows(
            len(order), len(vocabulary), np.asarray(row, np.int64), np.asarray(column, np.int64), 1 + np.log(np.asarray(value, np.float64))
        )
        labels = np.asarray([[float(x) for x in strata[i].split(",")] for i in order]).reshape(len(order), len(categories))
        weight = np.asarray([1 / share[strata[i]] for i in order])
        weight *= len(weight) / max(1e-9, weight.sum())
        models = fit_chain(rows, labels, weight, np.asarray([draws[i] // scale % FOLDS for i in order], np.int64))
        sparse = np.column_stack([m[0] for m in models])
        payload = [json.dumps(list(vocabulary)), sparse.astype("<f8").tobytes().hex(), json.dumps([m[1].tolist() for m in models])]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.string()) for p in payload], ["words", "sparse", "dense"])

    if len(categories) > 6:
        raise ValueError("more than 6 categories make too many strata")
    counted = chosen.mapInArrow(count, "draw long, stratum string, words array<string>, counts array<int>")
    # A shuffle, not a coalesce: the scan stays spread, only the sample meets in one task.
    row = counted.repartition(1).mapInArrow(fit, "words string, sparse string, dense string").first()
    vocabulary = {w: i for i, w in enumerate(json.loads(row.words))}
    sparse = np.frombuffer(bytes.fromhex(row.sparse), "<f8").reshape(len(vocabulary), len(categories))
    return Chain(categories, vocabulary, sparse, [np.asarray(d) for d in json.loads(row.dense)])


def predict(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and p_<category> for each category, in chain order.

    A null, empty or wordless text gets the probabilities of a text without known words. Repeated
    rows and null keys are rows like any other; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((chain.categories, chain.vocabulary, chain.sparse, chain.dense))
    names = ["doc_id", *[f"p_{c}" for c in chain.categories]]

    def batches(stream):
        model = Chain(*shared.value)
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = np.asarray([model.predict(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in found.T]], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches, ", ".join(["doc_id long", *[f"{n} double" for n in names[1:]]]))


def categories_of(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, toxic_prose, toxic_junk) from (doc_id, quality, toxic) labels.

    The label table knows one toxicity flag; with the quality flag it gives three categories:
    toxic at all, toxic in readable prose, toxic within junk. Rows with a null flag have null
    categories. Of several rows of a doc_id the largest flags count.
    """
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    return flags.select(
        "doc_id",
        (F.col("toxic") == 1).cast("int").alias("toxic"),
        ((F.col("toxic") == 1) & (F.col("quality") == 1)).cast("int").alias("toxic_prose"),
        ((F.col("toxic") == 1) & (F.col("quality") == 0)).cast("int").alias("toxic_junk"),
    )


CATEGORIES = ["toxic", "toxic_prose", "toxic_junk"]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`predict` for all of `docs` by a chain learned from `labels`, and `toxic`: p_toxic >= threshold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    chain = learn(rows, categories_of(labels), CATEGORIES)
    return predict(rows, chain).withColumn("toxic", F.col("p_toxic") >= threshold)
