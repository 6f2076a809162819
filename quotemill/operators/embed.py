"""Text embeddings: a built-in encoder on Spark ML and a hook for any other model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.texts import words
from quotemill.sources.sinks import update_embeddings

DIMENSIONS = 384

Encoder = Callable[[DataFrame], DataFrame]


def embedding_text(title: str = "title", description: str = "description", max_chars: int | None = None) -> Column:
    """Title and description as one text; whole by default, cut where a model has a length limit."""
    text = F.concat(F.col(title), F.lit(" "), F.coalesce(F.col(description), F.lit("")))
    return text if max_chars is None else F.left(text, F.lit(max_chars))


def _with_buckets(texts: DataFrame, dimensions: int) -> DataFrame:
    """The words of each text as numbers of their dimension, from the first digits of their MD5."""

    def bucket(word: Column) -> Column:
        return (F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("int") % dimensions).cast("string")

    tokens = F.filter(words(F.col("text")), lambda w: w != "")
    return texts.withColumn("_buckets", F.transform(tokens, bucket))


def fit_encoder(texts: DataFrame, dimensions: int = DIMENSIONS) -> Encoder:
    """Hashed word counts weighted by inverse document frequency, scaled to length 1.

    Fitting is one aggregation of a vector of `dimensions` counts.
    """
    numbers = [str(i) for i in range(dimensions)]
    stages = Pipeline(
        stages=[
            CountVectorizerModel.from_vocabulary(numbers, inputCol="_buckets", outputCol="_tf"),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]
    )
    return encoder_from(stages.fit(_with_buckets(texts, dimensions)), dimensions)


def encoder_from(model: PipelineModel, dimensions: int = DIMENSIONS) -> Encoder:
    """An encoder (id, text) -> (id, embedding) from a fitted pipeline."""

    def encode(texts: DataFrame) -> DataFrame:
        return model.transform(_with_buckets(texts, dimensions)).select(
            "id", vector_to_array("_unit", "float32").alias("embedding")
        )

    return encode


def model_encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]], id_type: str = "bigint") -> Encoder:
    """An encoder from any batch model; it is loaded once per task, texts arrive as Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "embedding": model(pdf["text"].tolist())})

    return lambda texts: texts.select("id", "text").mapInPandas(run, f"id {id_type}, embedding array<float>")


def missing_embeddings(news: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles without a vector; with `limit` so many, lowest ids first, for one backfill call."""
    waiting = news.filter(F.col("embedding").isNull())
    return waiting if limit is None else waiting.orderBy("id").limit(limit)


def backfill(news: DataFrame, encode: Encoder, limit: int | None = None, max_chars: int | None = None) -> DataFrame:
    """News with the vectors of one backfill call filled in."""
    texts = missing_embeddings(news, limit).select("id", embedding_text(max_chars=max_chars).alias("text"))
    return update_embeddings(news, encode(texts))


def coverage(news: DataFrame) -> DataFrame:
    return news.agg(F.count("*").alias("total"), F.count("embedding").alias("with_embedding"))
