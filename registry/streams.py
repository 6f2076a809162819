"""Streaming jobs run over the test tables as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.weather import SHORT_CODES
from quotemill.plans.marts import daily_crypto_stats
from quotemill.session import new_work_dir
from quotemill.sources import sinks
from quotemill.streaming import freshness, ingest, jobs
from quotemill.streaming.runs import drain_to_parquet, stream_parquet
from registry.ingest import _NEWS_ITEMS, _TICKERS, USABLE, _weather_sql, _with_unreadable, news_polls, ticker_polls, weather_polls
from registry.tables import CLOCK, Tables, local_day, mean, prices_from, register


def _price_stream(t: Tables) -> DataFrame:
    # A pattern instead of a plain path: a stream also accepts a table that is one file then.
    return prices_from(stream_parquet(t.spark, f"{t.folder}/{{events.parquet}}", t.raw("events").schema))


def _read(t: Tables, path: str) -> DataFrame:
    return t.spark.read.parquet(path)


_CLOSED = "(SELECT max(timestamp) - INTERVAL 15 MINUTE FROM crypto_prices WHERE abs(price_change_24h) > 5)"


@register(
    "stream_anomalies",
    f"""
SELECT window_end, symbol, count(*) AS rows_seen, arg_min(id, place) AS id, CAST(arg_min(price_usd, place) AS DOUBLE) AS price_usd,
  CAST(arg_min(price_change_24h, place) AS DOUBLE) AS price_change_24h, arg_min(timestamp, place) AS timestamp
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, timestamp) + INTERVAL 15 MINUTE AS window_end,
        row_number() OVER (ORDER BY abs(price_change_24h) DESC, timestamp, id) AS place
      FROM crypto_prices WHERE abs(price_change_24h) > 5)
WHERE window_end <= {_CLOSED} GROUP BY window_end, symbol
""",
    ("crypto_prices",),
)
def stream_anomalies(t: Tables):
    path = drain_to_parquet(jobs.anomaly_stream(_price_stream(t)), "stream-anomalies")
    return _read(t, path).drop("window_start")


@register("stream_new_articles", "SELECT url, count(*) AS articles FROM (SELECT DISTINCT url, CASE WHEN url IS NULL THEN id END FROM news_articles) GROUP BY url", ("news_articles",))
def stream_new_articles(t: Tables):
    landing = new_work_dir(t.spark, "news-landing")
    t.news.write.parquet(landing)
    stream = stream_parquet(t.spark, landing, t.news.schema)
    path = drain_to_parquet(jobs.new_articles_stream(stream, keep="60 days"), "stream-news")
    return _read(t, path).groupBy("url").agg(F.count("*").alias("articles"))


@register(
    "stream_hourly_summary",
    """
SELECT 'daily_summary' AS insight_type, hour_end AS generated_at, '{"rows_seen":' || count(*) || ',"change_sum":'
  || coalesce(CAST(CAST(sum(price_change_24h) AS DECIMAL(20,2)) AS VARCHAR), 'null') || ',"change_count":' || count(price_change_24h) || ',"anomalies":'
  || count(*) FILTER (WHERE abs(price_change_24h) > 5) || '}' AS content
FROM (SELECT *, date_trunc('hour', timestamp) + INTERVAL 1 HOUR AS hour_end FROM crypto_prices)
WHERE hour_end <= (SELECT max(timestamp) - INTERVAL 15 MINUTE FROM crypto_prices) GROUP BY hour_end
""",
    ("crypto_prices",),
)
def stream_hourly_summary(t: Tables):
    return _read(t, drain_to_parquet(jobs.hourly_summary_stream(_price_stream(t)), "stream-summary"))


@register(
    "stream_two_pollers",
    "SELECT id, symbol, CAST(price_usd AS DOUBLE) AS price_usd, timestamp, CAST(2 AS BIGINT) AS copies FROM crypto_prices",
    ("crypto_prices",),
)
def stream_two_pollers(t: Tables):
    both = jobs.merged_pollers_stream(_price_stream(t), _price_stream(t))
    stored = _read(t, drain_to_parquet(both, "stream-pollers"))
    return stored.groupBy("id", "symbol", "price_usd", "timestamp").agg(F.count("*").alias("copies"))


@register(
    "stream_two_pollers_deduplicated",
    "SELECT DISTINCT symbol, timestamp FROM crypto_prices",
    ("crypto_prices",),
)
def stream_two_pollers_deduplicated(t: Tables):
    both = jobs.merged_pollers_stream(_price_stream(t), _price_stream(t), deduplicate=True)
    return _read(t, drain_to_parquet(both, "stream-pollers")).select("symbol", "timestamp")


def _ingested(t: Tables, refresh=None) -> str:
    landing, root = new_work_dir(t.spark, "landing"), new_work_dir(t.spark, "store")
    ticker_polls(t).select("polled_at", "payload").write.parquet(landing)
    job = ingest.TickerIngest(root, clock=lambda: CLOCK, refresh=refresh)
    ingest.run_ingest(t.spark, landing, job)
    return root


_PRICE = "CASE WHEN price IS NULL OR price = '' THEN 0 ELSE CAST(price AS DECIMAL(18,8)) END"
_STORED = f"""
SELECT t.symbol, p.polled_at AS timestamp, {_PRICE} AS price_usd, k * 1000 AS volume_24h, k + 0.86 AS price_change_24h FROM tickers t
JOIN (SELECT event_id // 20 AS poll, max(ts) AS polled_at FROM events GROUP BY 1) p ON p.poll = t.poll
WHERE {USABLE}
"""


@register(
    "stream_ingest",
    f"""
SELECT {local_day('timestamp')} AS date, symbol, count(*) AS row_count, CAST(sum(price_usd) AS DOUBLE) AS price_sum,
  CAST(sum(volume_24h) AS BIGINT) AS volume_sum FROM stored GROUP BY ALL
""",
    tickers=_TICKERS,
    stored=_STORED,
)
def stream_ingest(t: Tables):
    stored = ingest.stored_prices(t.spark, _ingested(t))
    return stored.groupBy("date", "symbol").agg(
        F.count("*").alias("row_count"), F.sum("price_usd").alias("price_sum"), F.sum("volume_24h").alias("volume_sum")
    )


@register(
    "stream_ingest_failures",
    "SELECT symbol, 'RangeCheck:price_usd[0.0,None]' AS failed_checks, count(*) AS failures FROM stored WHERE price_usd <= 0 GROUP BY symbol",
    tickers=_TICKERS,
    stored=_STORED,
)
def stream_ingest_failures(t: Tables):
    log = ingest.stored_failures(t.spark, _ingested(t))
    body = F.col("content")
    checks = F.from_json(F.get_json_object(body, "$.failed_checks"), "array<string>")
    return log.groupBy(
        F.get_json_object(body, "$.record_id").alias("symbol"), F.array_join(checks, ",").alias("failed_checks")
    ).agg(F.count("*").alias("failures"))


@register(
    "stream_ingest_mart",
    f"""
SELECT symbol, {local_day('timestamp')} AS date, round({mean('sum(price_usd)', 'count(price_usd)', 8, 8)}, 6) AS avg_price,
  CAST(max(price_usd) AS DOUBLE) AS max_price, CAST(min(price_usd) AS DOUBLE) AS min_price
FROM stored WHERE timestamp >= (TIMESTAMP '2024-01-24 00:00:00' AT TIME ZONE 'Europe/Warsaw' AT TIME ZONE 'UTC') GROUP BY ALL
""",
    tickers=_TICKERS,
    stored=_STORED,
)
def stream_ingest_mart(t: Tables):
    root = _ingested(t, refresh=daily_crypto_stats)
    stats = sinks.read_mart(t.spark, f"{root}/mart")
    return stats.withColumn("avg_price", F.round(F.round("avg_price", 8).cast("double"), 6))


@register(
    "stream_ingest_metadata",
    "SELECT 'crypto_prices' AS table_name, TIMESTAMP '2024-01-31 00:00:00' AS last_successful_ts, count(*) AS rows_inserted FROM stored",
    tickers=_TICKERS,
    stored=_STORED,
)
def stream_ingest_metadata(t: Tables):
    return ingest.current_metadata(t.spark, _ingested(t)).select("table_name", "last_successful_ts", "rows_inserted")


def _landed(t: Tables, polls: DataFrame) -> str:
    landing = new_work_dir(t.spark, "landing")
    polls.select(F.lit(None).cast("timestamp_ntz").alias("polled_at"), "payload").write.parquet(landing)
    return landing


@register(
    "stream_news_ingest",
    "SELECT url, CASE WHEN url IS NULL THEN count(*) ELSE 1 END AS articles FROM items GROUP BY url",
    ("news_articles",),
    items=_NEWS_ITEMS,
)
def stream_news_ingest(t: Tables):
    root = new_work_dir(t.spark, "store")
    ingest.run_ingest(t.spark, _landed(t, news_polls(t)), ingest.NewsIngest(root, clock=lambda: CLOCK))
    stored = t.spark.read.parquet(f"{root}/news_articles")
    return stored.groupBy("url").agg(F.count("*").alias("articles"))


@register(
    "stream_weather_ingest",
    "SELECT weather_condition, count(*) AS readings, CAST(sum(temperature) AS DOUBLE) AS degrees, CAST(sum(humidity) AS BIGINT) AS humidity "
    "FROM readings GROUP BY weather_condition",
    readings=_weather_sql(SHORT_CODES),
)
def stream_weather_ingest(t: Tables):
    root = new_work_dir(t.spark, "store")
    ingest.run_ingest(t.spark, _landed(t, weather_polls(t)), ingest.WeatherIngest(root, clock=lambda: CLOCK))
    stored = t.spark.read.parquet(f"{root}/weather_data")
    return stored.groupBy("weather_condition").agg(
        F.count("*").alias("readings"), F.sum("temperature").alias("degrees"), F.sum("humidity").alias("humidity")
    )


@register(
    "stream_freshness",
    """
SELECT symbol AS table_name, timestamp AS last_seen, timestamp + INTERVAL 15 MINUTE AS alert_at
FROM (SELECT symbol, timestamp, lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS following,
             (SELECT max(timestamp) FROM crypto_prices) - INTERVAL 15 MINUTE AS watermark FROM (SELECT DISTINCT symbol, timestamp FROM crypto_prices))
WHERE timestamp + INTERVAL 15 MINUTE < watermark AND (following IS NULL OR following > timestamp + INTERVAL 15 MINUTE)
""",
    ("crypto_prices",),
)
def stream_freshness(t: Tables):
    """Silences of more than 15 minutes per symbol, sent because the watermark passed them."""
    rows = _price_stream(t).select(F.col("symbol").alias("table_name"), "timestamp")
    with freshness.rocks_state(t.spark):
        return _read(t, drain_to_parquet(freshness.freshness_stream(rows), "stream-freshness"))


@register(
    "stream_poller_gaps",
    """
SELECT symbol, timestamp, coalesce(a.poller, b.poller) AS seen_by
FROM (SELECT DISTINCT symbol, timestamp, 'first' AS poller FROM crypto_prices WHERE id % 7 <> 0) a
FULL JOIN (SELECT DISTINCT symbol, timestamp, 'second' AS poller FROM crypto_prices WHERE id % 11 <> 0) b USING (symbol, timestamp)
WHERE (a.poller IS NULL OR b.poller IS NULL) AND timestamp < (
  SELECT least(max(timestamp) FILTER (WHERE id % 7 <> 0), max(timestamp) FILTER (WHERE id % 11 <> 0)) FROM crypto_prices) - INTERVAL 15 MINUTE
""",
    ("crypto_prices",),
)
def stream_poller_gaps(t: Tables):
    """Two pollers that miss different polls of the same feed."""
    gaps = jobs.poller_gaps_stream(_price_stream(t).where("id % 7 <> 0"), _price_stream(t).where("id % 11 <> 0"))
    return _read(t, drain_to_parquet(gaps, "stream-poller-gaps"))
