from datetime import date

import numpy as np
from pyspark.sql import functions as F

from quotemill.operators import backtest, embed, forecast, vector_cache
from quotemill.operators.quality import metrics
from registry.tables import CLOCK


def test_sketches_merge_within_their_error(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = rng.lognormal(size=30_000)
    rows = [(int(i % 9000), float(v), date(2024, 1, 1 + i % 5), i % 7 == 0) for i, v in enumerate(values)]
    report = spark.createDataFrame(rows, "k long, v double, day date, bad boolean").select(
        "k", "v", "day", (~F.col("bad")).alias("dq_passed"), F.lit(False).alias("auto_repaired"), F.lit("t").alias("dq_table"))
    for batch in (0, 1, 1):
        part = report.where(F.col("k") % 2 == batch)
        metrics.store(metrics.measure(part, {"k": None, "v": "v"}, F.col("day")), f"{tmp_path}/m", batch)

    def check(found, chosen):
        by = {r["column_name"]: r for r in found.collect()}
        assert by[""]["rows"] == len(chosen) and by[""]["failures"] == sum(r[3] for r in chosen)
        distinct = len({r[0] for r in chosen})
        assert abs(by["k"]["distinct_values"] - distinct) <= metrics.DISTINCT_ERROR * distinct
        mine = np.sort([r[1] for r in chosen])
        assert by["v"]["least"] == mine[0] and by["v"]["greatest"] == mine[-1] and by["v"]["present"] == len(mine)
        for name, q in (("q50", 0.5), ("q95", 0.95)):
            assert abs(np.searchsorted(mine, by["v"][name]) / len(mine) - q) <= metrics.RANK_ERROR

    check(metrics.over(spark, f"{tmp_path}/m"), rows)
    check(metrics.over(spark, f"{tmp_path}/m", date(2024, 1, 2), date(2024, 1, 3)), [r for r in rows if r[2].day in (2, 3)])


def test_columns_without_values(spark, tmp_path):
    report = spark.createDataFrame([(None, None)], "k string, v double").withColumns(
        {"dq_passed": F.lit(True), "auto_repaired": F.lit(False), "dq_table": F.lit("t"), "day": F.lit(date(2024, 1, 1))})
    metrics.store(metrics.measure(report, {"k": None, "v": "v"}, F.col("day")), f"{tmp_path}/m", 0)
    by = {r["column_name"]: r for r in metrics.over(spark, f"{tmp_path}/m").collect()}
    assert by["k"]["distinct_values"] == 0 and by["v"]["q50"] is None and by["v"]["present"] == 0


def test_each_distinct_text_is_encoded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            calls.add(len(texts))
            return [[float(len(t)), 0.5] for t in texts]
        return encode

    model = embed.model_encoder(load, "string")
    cached = vector_cache.cached_encoder(model, f"{tmp_path}/cache", "v1")
    texts = spark.createDataFrame([(i, ["one", "three", "", None, "seven77"][i % 5]) for i in range(50)], "id long, text string")
    want = {(i, None if t is None else (float(len(t)), 0.5)) for i, t in ((r["id"], r["text"]) for r in texts.collect())}
    got = lambda encode, rows: {(r["id"], None if r["embedding"] is None else tuple(r["embedding"])) for r in encode(rows).collect()}
    assert got(cached, texts) == want and calls.value == 4
    assert got(cached, texts) == want and calls.value == 4
    more = texts.unionByName(spark.createDataFrame([(90, "one"), (91, "new")], "id long, text string"))
    assert got(cached, more) == want | {(90, (3.0, 0.5)), (91, (3.0, 0.5))} and calls.value == 5
    assert got(vector_cache.cached_encoder(model, f"{tmp_path}/cache", "v2"), texts) == want and calls.value == 9
    assert got(cached, texts.where("false")) == set()


def test_cached_texts_are_read_once(spark, tmp_path):
    """The input is evaluated once a call, and once more only for texts that the cache lacks."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    def counted(rows):
        return spark.createDataFrame(rows, "id long, text string").mapInPandas(read, "id long, text string")

    model = embed.model_encoder(lambda: lambda batch: [[float(len(t))] for t in batch], "string")
    cached = vector_cache.cached_encoder(model, f"{tmp_path}/cache", "v1")
    # Few repeats, a null id, a null text: the other side of the choice than many repeats.
    rows = [(i, "x" * i) for i in range(1, 30)] + [(30, "x"), (None, "xx"), (31, None)]
    want = sorted((i or -1, None if t is None else float(len(t))) for i, t in rows)
    got = lambda found: sorted((r["id"] or -1, None if r["embedding"] is None else r["embedding"][0]) for r in found.collect())
    assert got(cached(counted(rows))) == want and seen.value == len(rows)
    assert got(cached(counted(rows))) == want and seen.value == 2 * len(rows)
    more = [*rows, (40, "y"), (41, "y"), (42, "yyy")]
    assert got(cached(counted(more))) == sorted([*want, (40, 1.0), (41, 1.0), (42, 3.0)])
    assert seen.value == 2 * len(rows) + 2 * len(more)
    stored = spark.read.parquet(f"{tmp_path}/cache/model=v1")
    assert stored.count() == stored.select("digest").distinct().count() == 31


def test_rolling_models_equal_single_fits(tables):
    """The window's sums give the model that a fit of the same rows gives."""
    rows = forecast._centred(forecast.features(tables.prices.where("price_usd > 0").select(
        "symbol", F.col("price_usd").cast("double").alias("price"), "timestamp", "id"), CLOCK.zone), CLOCK)
    hour = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 3600).cast("bigint")
    rows = rows.withColumn("hour", hour)
    origin = 473_352  # 2024-01-01 00:00 UTC in hours
    models = backtest.rolling_models(backtest.hourly_moments(rows), 24, 7, origin + 24 * 10, origin + 24 * 20).collect()
    assert len({(r["symbol"], r["hour"]) for r in models}) == len(models) > 30
    some = [r for r in models if r["hour"] == origin + 24 * 15]
    single = {r["symbol"]: r for r in forecast.fit(rows.where((F.col("hour") >= origin + 24 * 8) & (F.col("hour") < origin + 24 * 15))).collect()}
    for r in some:
        mine = single[r["symbol"]]
        assert r["training_points"] == mine["training_points"]
        for name in ("intercept", *forecast.COEFFICIENTS):
            assert abs(r[name] - mine[name]) <= 1e-5 * max(1.0, abs(mine[name]))
