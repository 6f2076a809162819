"""KPIs, latest rows, dashboard cards, panels, alerts, bundles."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions import texts, weather
from quotemill.operators import alerts, latest, trend
from quotemill.plans import bundles, cards, marts
from quotemill.session import new_work_dir
from quotemill.sources.tables import query, read_table
from registry.marts import DAILY, DAILY_VIEWS, WEEKLY_SQL, change_sql, daily
from registry.quality import ISSUES_SQL, NEWEST_ISSUES, TREND_SQL
from registry.tables import CLOCK, Tables, day_start, local_day, mean, register

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
LATEST = "SELECT * FROM crypto_prices WHERE timestamp IN (SELECT max(timestamp) FROM crypto_prices GROUP BY symbol)"
PRICE_COLUMNS = (
    "id, symbol, CAST(price_usd AS DOUBLE) AS price_usd, market_cap, volume_24h, "
    "CAST(price_change_24h AS DOUBLE) AS price_change_24h, timestamp"
)


# --- scans and latest rows ---------------------------------------------------------------

@register(
    "scan_with_parameters",
    f"SELECT {PRICE_COLUMNS} FROM crypto_prices WHERE symbol = 'ETH' AND price_usd > 100",
    ("crypto_prices",),
)
def scan_with_parameters(t: Tables):
    sql = "SELECT * FROM {prices} WHERE symbol = :symbol AND price_usd > :lowest"
    return query(t.spark, sql, {"symbol": "ETH", "lowest": 100}, prices=t.prices)


@register("scan_declared_schema", f"SELECT {PRICE_COLUMNS} FROM crypto_prices WHERE timestamp >= {AS_OF} - INTERVAL 7 DAY", ("crypto_prices",))
def scan_declared_schema(t: Tables):
    """A stored domain table read through its declared schema."""
    root = new_work_dir(t.spark, "tables")
    t.prices.write.parquet(f"{root}/crypto_prices")
    stored = read_table(t.spark, root, "crypto_prices")
    return stored.filter(F.col("timestamp") >= CLOCK.ago(days=7))


@register("latest_prices_semijoin", f"SELECT {PRICE_COLUMNS} FROM newest", ("crypto_prices",), newest=LATEST)
def latest_prices_semijoin(t: Tables):
    return latest.latest_prices(t.prices)


@register(
    "market_sentiment",
    """
SELECT CASE WHEN sum(coalesce(price_change_24h, 0)) > count(*) THEN 'Bullish'
            WHEN sum(coalesce(price_change_24h, 0)) < -count(*) THEN 'Bearish' ELSE 'Neutral' END AS market_sentiment FROM newest
""",
    ("crypto_prices",),
    newest=LATEST,
)
def market_sentiment(t: Tables):
    return latest.market_sentiment(latest.latest_prices(t.prices))


@register("symbol_lookup", f"SELECT {PRICE_COLUMNS} FROM newest WHERE symbol = 'BTC'", ("crypto_prices",), newest=LATEST)
def symbol_lookup(t: Tables):
    return latest.symbol_row(latest.latest_prices(t.prices), "BTC")


@register(
    "top_volume",
    "SELECT symbol, CAST(price_usd AS DOUBLE) AS price_usd, CAST(price_change_24h AS DOUBLE) AS price_change_24h, volume_24h "
    "FROM newest ORDER BY volume_24h DESC NULLS FIRST, symbol, id LIMIT 10",
    ("crypto_prices",),
    newest=LATEST,
)
def top_volume(t: Tables):
    return latest.top_volume(latest.latest_prices(t.prices))


@register(
    "newest_articles",
    "SELECT id, title, description, source, published_at, url FROM news_articles ORDER BY published_at DESC NULLS FIRST, id LIMIT 10",
    ("news_articles",),
)
def newest_articles(t: Tables):
    return latest.newest_articles(t.news)


@register(
    "newest_weather",
    "SELECT city, CAST(temperature AS DOUBLE) AS temperature, humidity, weather_condition FROM weather_data "
    "ORDER BY timestamp DESC NULLS FIRST, id LIMIT 1",
    ("weather_data",),
)
def newest_weather(t: Tables):
    return latest.newest_weather(t.weather)


@register(
    "newest_prices",
    "SELECT symbol, CAST(price_usd AS DOUBLE) AS price_usd, volume_24h, CAST(price_change_24h AS DOUBLE) AS price_change_24h, "
    "timestamp FROM crypto_prices ORDER BY timestamp DESC NULLS FIRST, id LIMIT 5",
    ("crypto_prices",),
)
def newest_prices(t: Tables):
    return latest.newest_prices(t.prices, 5)


STOCK_TOP = (
    "SELECT symbol, CAST(close_price AS DOUBLE) AS close_price, trading_date FROM stock_prices "
    "ORDER BY trading_date DESC, symbol LIMIT 20"
)


@register("stock_changes", STOCK_TOP, ("stock_prices",))
def stock_changes(t: Tables):
    return latest.stock_changes(t.stocks)


@register(
    "sector_label",
    "SELECT CASE WHEN count(*) > 0 THEN 'Technology: Active' ELSE 'Market Stable' END AS sector_performance FROM stock_prices",
    ("stock_prices",),
)
def sector_label(t: Tables):
    return latest.sector_label(t.stocks)


@register(
    "newest_daily_stats",
    f"""
SELECT symbol, {local_day('timestamp')} AS date, round({mean('sum(price_usd)', 'count(price_usd)', 8, 8)}, 6) AS avg_price,
  CAST(max(price_usd) AS DOUBLE) AS max_price, CAST(min(price_usd) AS DOUBLE) AS min_price
FROM crypto_prices WHERE timestamp >= {day_start(7)} GROUP BY ALL ORDER BY date DESC, symbol LIMIT 10
""",
    ("crypto_prices",),
)
def newest_daily_stats(t: Tables):
    stats = latest.newest_daily_stats(marts.daily_crypto_stats(t.prices, CLOCK))
    return stats.withColumn("avg_price", F.round(F.round("avg_price", 8).cast("double"), 6))


@register(
    "price_series",
    f"SELECT CAST(price_usd AS DOUBLE) AS value, timestamp FROM crypto_prices WHERE symbol = 'BTC' AND timestamp >= {AS_OF} - INTERVAL 7 DAY",
    ("crypto_prices",),
)
def price_series(t: Tables):
    return latest.price_series(t.prices, CLOCK, "btc", 7)


@register(
    "series_direction",
    """
SELECT symbol, count(*) AS points, CASE WHEN count(*) < 2 THEN 'neutral'
  WHEN arg_max(price_usd, (timestamp, id)) >= arg_min(price_usd, (timestamp, id)) THEN 'up' ELSE 'down' END AS direction
FROM crypto_prices GROUP BY symbol
""",
    ("crypto_prices",),
)
def series_direction(t: Tables):
    return latest.series_direction(t.prices)


@register(
    "price_direction",
    "SELECT id, CASE WHEN price_change_24h > 0 THEN 'up' WHEN price_change_24h < 0 THEN 'down' ELSE 'flat' END AS direction FROM crypto_prices",
    ("crypto_prices",),
)
def price_direction(t: Tables):
    return t.prices.select("id", latest.direction_of(F.col("price_change_24h")).alias("direction"))


@register(
    "weather_panel",
    """
SELECT id, CASE WHEN temperature < 5 THEN 'cold' WHEN temperature < 20 THEN 'mild' ELSE 'hot' END AS band,
  round(least(100.0, greatest(0.0, (CAST(temperature AS DOUBLE) + 20) / 60 * 100)), 6) AS temperature_percent,
  CAST(least(100, greatest(0, humidity)) AS DOUBLE) AS humidity_percent, CAST(temperature - 2 AS DOUBLE) AS feels_like,
  split_part(weather_condition, ' ', 1) AS condition
FROM weather_data
""",
    ("weather_data",),
)
def weather_panel(t: Tables):
    degrees = F.col("temperature")
    return t.weather.select(
        "id",
        weather.temperature_band(degrees).alias("band"),
        F.round(weather.temperature_gauge(degrees), 6).alias("temperature_percent"),
        weather.humidity_gauge(F.col("humidity")).alias("humidity_percent"),
        weather.feels_like(degrees).alias("feels_like"),
        weather.first_word(F.col("weather_condition")).alias("condition"),
    )


@register(
    "headline_sentiment",
    f"""
SELECT id, CASE WHEN regexp_matches(lower(title), '{"|".join(texts.POSITIVE_WORDS)}') THEN 'POS'
  WHEN regexp_matches(lower(title), '{"|".join(texts.NEGATIVE_WORDS)}') THEN 'NEG' ELSE 'NEU' END AS tone FROM news_articles
""",
    ("news_articles",),
)
def headline_sentiment(t: Tables):
    return t.news.select("id", texts.headline_tone(F.col("title")).alias("tone"))


# --- cards -------------------------------------------------------------------------------

@register("card_last_update", "SELECT max(timestamp) AS last_update FROM crypto_prices", ("crypto_prices",))
def card_last_update(t: Tables):
    return cards.last_update(t.prices)


_LAST_DAY = f"FROM crypto_prices WHERE timestamp > {AS_OF} - INTERVAL 1 DAY"


@register(
    "card_average_change",
    f"SELECT {mean('sum(price_change_24h)', 'count(price_change_24h)', 2, 2)} AS avg_change_percent {_LAST_DAY}",
    ("crypto_prices",),
)
def card_average_change(t: Tables):
    return cards.average_change(t.prices, CLOCK)


@register(
    "card_sentiment",
    f"""
SELECT CASE WHEN avg(price_change_24h) > 1 THEN 'BULLISH 🐂' WHEN avg(price_change_24h) < -1 THEN 'BEARISH 🐻'
  ELSE 'NEUTRAL ⚖️' END AS sentiment {_LAST_DAY}
""",
    ("crypto_prices",),
)
def card_sentiment(t: Tables):
    return cards.sentiment_label(t.prices, CLOCK)


@register(
    "card_anomaly_count",
    f"SELECT count(*) AS anomaly_count FROM alerts WHERE window_end > {AS_OF} - INTERVAL 1 DAY",
    ("alerts",),
)
def card_anomaly_count(t: Tables):
    return cards.anomaly_count(t.insights, CLOCK)


@register(
    "card_btc_eth",
    f"""
SELECT {local_day('timestamp')} AS date, CAST(max(price_usd) FILTER (WHERE symbol = 'BTC') AS DOUBLE) AS "BTC",
  CAST(max(price_usd) FILTER (WHERE symbol = 'ETH') AS DOUBLE) AS "ETH"
FROM crypto_prices WHERE timestamp > {AS_OF} - INTERVAL 7 DAY GROUP BY 1
""",
    ("crypto_prices",),
)
def card_btc_eth(t: Tables):
    return cards.btc_eth_by_day(t.prices, CLOCK)


@register(
    "card_recent_alerts",
    """
SELECT window_end AS detected_at, '["' || replace(symbols, ',', '","') || '"]' AS symbols, left(message, 150) AS message
FROM alerts ORDER BY window_end DESC LIMIT 5
""",
    ("alerts",),
)
def card_recent_alerts(t: Tables):
    return cards.recent_alerts(t.insights)


@register(
    "card_current_btc",
    'SELECT CAST(price_usd AS DOUBLE) AS "BTC Price ($)" FROM crypto_prices WHERE symbol = \'BTC\' ORDER BY timestamp DESC LIMIT 1',
    ("crypto_prices",),
)
def card_current_btc(t: Tables):
    return cards.current_price(t.prices)


@register(
    "card_weekly",
    'SELECT week, avg_btc_price AS "BTC ($)", avg_eth_price AS "ETH ($)", avg_market_change AS "Avg Change (%)", '
    'total_news AS "News", avg_temperature AS "Temp (°C)" FROM weekly',
    DAILY_VIEWS,
    **DAILY,
    weekly=WEEKLY_SQL,
)
def card_weekly(t: Tables):
    return cards.weekly_card(marts.weekly_summary(daily(t, 90), CLOCK))


@register(
    "card_news_price",
    'SELECT date, news_count AS "News Count", btc_avg_price AS "BTC Price ($)", btc_daily_pct_change AS "BTC Daily Change (%)" '
    "FROM change ORDER BY date DESC LIMIT 30",
    DAILY_VIEWS,
    **DAILY,
    change=change_sql("news_count"),
)
def card_news_price(t: Tables):
    return cards.news_price_card(marts.news_correlation(daily(t, 30), CLOCK))


@register(
    "card_weather_price",
    'SELECT date, avg_temperature AS "Temperature (°C)", btc_avg_price AS "BTC Price ($)", '
    'btc_daily_pct_change AS "BTC Daily Change (%)" FROM change ORDER BY date DESC LIMIT 30',
    DAILY_VIEWS,
    **DAILY,
    change=change_sql("avg_temperature"),
)
def card_weather_price(t: Tables):
    return cards.weather_price_card(marts.weather_correlation(daily(t, 30), CLOCK))


@register(
    "card_dq_trend",
    'SELECT date, table_name AS "Table", failures_count AS "Failures", auto_repaired_count AS "Auto Repaired" '
    "FROM trend ORDER BY date DESC, table_name LIMIT 30",
    ("failures",),
    trend=TREND_SQL,
)
def card_dq_trend(t: Tables):
    return cards.dq_trend_card(marts.dq_trend(t.insights, CLOCK))


@register(
    "newest_mart_days",
    "SELECT date, btc_avg_price, news_count FROM daily ORDER BY date DESC LIMIT 5",
    DAILY_VIEWS,
    **DAILY,
)
def newest_mart_days(t: Tables):
    return cards.newest_mart_days(daily(t))


# --- bundles -----------------------------------------------------------------------------

@register(
    "articles_today",
    f"SELECT count(*) AS news_count FROM news_articles WHERE {local_day('published_at')} = DATE '2024-01-30'",
    ("news_articles",),
)
def articles_today(t: Tables):
    return bundles.articles_today(t.news, Clock(datetime(2024, 1, 30, 12)))


@register(
    "daily_metrics",
    f"""
SELECT 'crypto_price' AS metric, symbol AS item, CAST(price_usd AS VARCHAR) AS value FROM newest
UNION ALL SELECT 'stock_price', symbol || ' ' || trading_date, CAST(CAST(close_price AS DECIMAL(10,2)) AS VARCHAR) FROM stocks
UNION ALL SELECT 'news_count', 'today', CAST(count(*) AS VARCHAR) FROM news_articles WHERE {local_day('published_at')} = DATE '2024-01-31'
UNION ALL SELECT 'weather', 'temperature', CAST(temperature AS VARCHAR) FROM reading
UNION ALL SELECT 'weather', 'humidity', CAST(humidity AS VARCHAR) FROM reading
""",
    ("crypto_prices", "stock_prices", "news_articles", "weather_data"),
    newest=LATEST,
    stocks=STOCK_TOP,
    reading="SELECT * FROM weather_data ORDER BY timestamp DESC, id LIMIT 1",
)
def daily_metrics(t: Tables):
    return bundles.daily_metrics(t.prices, t.stocks, t.news, t.weather, CLOCK)


@register(
    "overview_parts",
    f"""
SELECT 'prices' AS part, symbol AS item, CAST(price_usd AS VARCHAR) AS value FROM newest
UNION ALL SELECT * FROM (SELECT 'daily_stats', symbol || ' ' || {local_day('timestamp')}, CAST(max(price_usd) AS VARCHAR)
  FROM crypto_prices WHERE timestamp >= {day_start(7)} GROUP BY symbol, {local_day('timestamp')}
  ORDER BY {local_day('timestamp')} DESC, symbol LIMIT 10)
UNION ALL SELECT 'market_sentiment', 'all', CASE WHEN sum(coalesce(price_change_24h, 0)) > count(*) THEN 'Bullish'
  WHEN sum(coalesce(price_change_24h, 0)) < -count(*) THEN 'Bearish' ELSE 'Neutral' END FROM newest
UNION ALL SELECT 'stocks', symbol || ' ' || trading_date, CAST(CAST(close_price AS DECIMAL(10,2)) AS VARCHAR) FROM stocks
UNION ALL SELECT 'sector_performance', 'all', CASE WHEN count(*) > 0 THEN 'Technology: Active' ELSE 'Market Stable' END FROM stock_prices
UNION ALL SELECT * FROM (SELECT 'news', CAST(id AS VARCHAR), title FROM news_articles ORDER BY published_at DESC NULLS FIRST, id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'weather', city, CAST(temperature AS VARCHAR) FROM weather_data ORDER BY timestamp DESC NULLS FIRST, id LIMIT 1)
UNION ALL SELECT 'data_quality_issues', table_name || ' ' || coalesce(record_id, ''), check_name FROM ({ISSUES_SQL})
""",
    ("failures", "stock_prices"),
    newest=LATEST,
    stocks=STOCK_TOP,
    issues=NEWEST_ISSUES,
)
def overview_parts(t: Tables):
    parts = bundles.overview(t.prices, t.stocks, t.news, t.weather, CLOCK)
    every = F.lit("all")
    shown = {
        "prices": (F.col("symbol"), F.col("price_usd")),
        "daily_stats": (F.concat_ws(" ", "symbol", "date"), F.col("max_price")),
        "market_sentiment": (every, F.col("market_sentiment")),
        "stocks": (F.concat_ws(" ", "symbol", "trading_date"), F.col("close_price")),
        "sector_performance": (every, F.col("sector_performance")),
        "news": (F.col("id"), F.col("title")),
        "weather": (F.col("city"), F.col("temperature")),
        "data_quality_issues": (F.concat(F.col("table_name"), F.lit(" "), F.coalesce("record_id", F.lit(""))), F.col("check_name")),
    }
    rows = [
        df.select(F.lit(name).alias("part"), shown[name][0].cast("string").alias("item"), shown[name][1].cast("string").alias("value"))
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


# --- trend and alerts --------------------------------------------------------------------

@register(
    "trend_facts",
    f"""
SELECT s.symbol, s.points, first_value, last_value, round((last_value - first_value) / nullif(first_value, 0) * 100, 2) AS pct_change,
  round(slope, 6) AS slope_per_hour,
  (SELECT count(*) FROM w WHERE w.symbol = s.symbol AND abs(value - mean_value) > 3 * deviation) AS spikes,
  CASE WHEN last_value > first_value THEN 'up' WHEN last_value < first_value THEN 'down' ELSE 'stable' END AS trend
FROM (SELECT symbol, count(*) AS points, arg_min(value, (timestamp, id)) AS first_value, arg_max(value, (timestamp, id)) AS last_value,
        avg(value) AS mean_value, stddev_pop(value) AS deviation, regr_slope(value, hours) AS slope FROM w GROUP BY symbol) s
""",
    ("crypto_prices",),
    w=f"SELECT symbol, CAST(price_usd AS DOUBLE) AS value, timestamp, id, "
      f"(epoch_us(timestamp) - epoch_us({AS_OF} - INTERVAL 7 DAY)) / 3600000000.0 AS hours "
      f"FROM crypto_prices WHERE timestamp >= {AS_OF} - INTERVAL 7 DAY",
)
def trend_facts(t: Tables):
    return trend.trend_facts(t.prices, CLOCK)


_ANOMALY = "id, symbol, CAST(price_usd AS DOUBLE) AS price_usd, CAST(price_change_24h AS DOUBLE) AS price_change_24h, timestamp"


@register(
    "recent_anomalies",
    f"SELECT {_ANOMALY} FROM crypto_prices WHERE timestamp >= {AS_OF} - INTERVAL 1440 MINUTE AND abs(price_change_24h) > 5 "
    "ORDER BY abs(price_change_24h) DESC, crypto_prices.timestamp, id LIMIT 10",
    ("crypto_prices",),
)
def recent_anomalies(t: Tables):
    return alerts.recent_anomalies(t.prices, CLOCK, minutes=1440)


@register(
    "anomalies_last_15_minutes",
    f"SELECT {_ANOMALY} FROM crypto_prices WHERE timestamp >= TIMESTAMP '2024-01-29 06:00:00' - INTERVAL 15 MINUTE AND abs(price_change_24h) > 5 "
    "ORDER BY abs(price_change_24h) DESC, crypto_prices.timestamp, id LIMIT 10",
    ("crypto_prices",),
)
def anomalies_last_15_minutes(t: Tables):
    return alerts.recent_anomalies(t.prices, Clock(datetime(2024, 1, 29, 6)))


@register("anomaly_windows", f"SELECT window_end, {_ANOMALY} FROM anomaly_rows", ("anomaly_rows",))
def anomaly_windows(t: Tables):
    return alerts.anomaly_windows(t.prices).drop("window_start")


@register("anomalies_dedup", f"SELECT window_end, {_ANOMALY} FROM alert_rows", ("alert_rows",))
def anomalies_dedup(t: Tables):
    return alerts.strongest_per_symbol(alerts.anomaly_windows(t.prices), "window_start").drop("window_start")


@register(
    "anomalies_dedup_day",
    f"""
SELECT {_ANOMALY} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(price_change_24h) DESC, timestamp, id) AS n
  FROM crypto_prices WHERE timestamp >= {AS_OF} - INTERVAL 1440 MINUTE AND abs(price_change_24h) > 5) WHERE n = 1
""",
    ("crypto_prices",),
)
def anomalies_dedup_day(t: Tables):
    return alerts.strongest_per_symbol(alerts.recent_anomalies(t.prices, CLOCK, minutes=1440, limit=None))


@register(
    "alertable_rows",
    "SELECT id FROM crypto_prices WHERE symbol IS NOT NULL AND symbol <> '' AND price_usd IS NOT NULL AND price_usd <> 0",
    ("crypto_prices",),
)
def alertable_rows(t: Tables):
    return alerts.alertable(t.prices).select("id")


@register(
    "anomaly_facts",
    "SELECT id, CASE WHEN price_change_24h > 0 THEN 'wzrost' ELSE 'spadek' END AS direction, "
    "CAST(abs(price_change_24h) AS DOUBLE) AS abs_change, explanation AS facts FROM alert_rows",
    ("alert_rows",),
)
def anomaly_facts(t: Tables):
    rows = alerts.strongest_per_symbol(alerts.anomaly_windows(t.prices), "window_start")
    return alerts.anomaly_facts(rows).select("id", "direction", "abs_change", "facts")


@register(
    "anomalies_with_explanations",
    """
SELECT a.id, a.symbol, e.explanation FROM alert_rows a
LEFT JOIN (SELECT symbol, 'strongest change: ' || CAST(max(abs(price_change_24h)) AS VARCHAR) AS explanation
           FROM crypto_prices WHERE symbol <> 'ADA' GROUP BY symbol) e ON e.symbol = a.symbol
""",
    ("alert_rows",),
)
def anomalies_with_explanations(t: Tables):
    text = F.concat(F.lit("strongest change: "), F.max(F.abs("price_change_24h")).cast("string"))
    explanations = t.prices.filter(F.col("symbol") != "ADA").groupBy("symbol").agg(text.alias("explanation"))
    rows = alerts.strongest_per_symbol(alerts.anomaly_windows(t.prices), "window_start")
    return alerts.with_explanations(rows, explanations).select("id", "symbol", "explanation")


@register(
    "alert_documents",
    """SELECT window_end, CAST(anomaly_count AS INT) AS anomaly_count, symbols AS affected_symbols, message FROM alerts""",
    ("alerts",),
)
def alert_documents(t: Tables):
    return t.alert_documents.select("window_end", "anomaly_count", "affected_symbols", "message")


@register(
    "alert_log",
    "SELECT 'price_anomaly' AS insight_type, window_end AS generated_at, '[\"' || replace(symbols, ',', '\",\"') || '\"]' AS symbols, "
    "message FROM alerts",
    ("alerts",),
)
def alert_log(t: Tables):
    log = t.insights.filter(F.col("insight_type") == "price_anomaly")
    return log.select(
        "insight_type", "generated_at",
        F.get_json_object("content", "$.affected_symbols").alias("symbols"),
        F.get_json_object("content", "$.message").alias("message"),
    )


_METADATA = """
SELECT 'crypto_prices' AS table_name, max(timestamp) AS last_successful_ts FROM crypto_prices
UNION ALL SELECT 'weather_data', max(timestamp) FROM weather_data
UNION ALL SELECT 'news_articles', max(fetched_at) FROM news_articles
"""
_METADATA_VIEWS = ("crypto_prices", "weather_data", "news_articles")


@register(
    "freshness",
    f"SELECT table_name, last_successful_ts, (epoch_us({AS_OF}) - epoch_us(last_successful_ts)) / 60000000.0 AS minutes_ago "
    f"FROM metadata WHERE last_successful_ts < {AS_OF} - INTERVAL 15 MINUTE",
    _METADATA_VIEWS,
    metadata=_METADATA,
)
def freshness(t: Tables):
    return alerts.stale_tables(t.metadata, CLOCK)


@register(
    "freshness_message",
    f"""
SELECT table_name, '⚠️ <b>DATA FRESHNESS ALERT</b> ⚠️' || chr(10) || chr(10) || '<b>Table:</b> ' || table_name || chr(10)
  || '<b>Last successful update:</b> ' || CAST(last_successful_ts AS VARCHAR) || chr(10) || '<b>Delay:</b> '
  || CAST((epoch_us({AS_OF}) - epoch_us(last_successful_ts)) // 60000000 AS VARCHAR) || ' minutes' || chr(10) || chr(10)
  || 'Please check the data pipeline!' AS message
FROM metadata WHERE last_successful_ts < {AS_OF} - INTERVAL 15 MINUTE
""",
    _METADATA_VIEWS,
    metadata=_METADATA,
)
def freshness_message(t: Tables):
    return alerts.freshness_message(alerts.stale_tables(t.metadata, CLOCK)).select("table_name", "message")
