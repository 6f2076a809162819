"""Dashboard cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.numbers import exact_avg, market_mood
from quotemill.functions.times import local_date

CARD_ROWS = 30


def last_update(prices: DataFrame) -> DataFrame:
    return prices.agg(F.max("timestamp").alias("last_update"))


def _last_day_change(prices: DataFrame, clock: Clock):
    recent = prices.filter(F.col("timestamp") > clock.ago(days=1))
    return recent, exact_avg(F.sum("price_change_24h"), F.count("price_change_24h"))


def average_change(prices: DataFrame, clock: Clock) -> DataFrame:
    recent, mean = _last_day_change(prices, clock)
    return recent.agg(F.round(mean, 2).alias("avg_change_percent"))


def sentiment_label(prices: DataFrame, clock: Clock) -> DataFrame:
    recent, mean = _last_day_change(prices, clock)
    mood = market_mood(mean)
    icon = F.when(mood == "Bullish", " 🐂").when(mood == "Bearish", " 🐻").otherwise(" ⚖️")
    return recent.agg(F.concat(F.upper(mood), icon).alias("sentiment"))


def anomaly_count(insights: DataFrame, clock: Clock) -> DataFrame:
    wanted = (F.col("insight_type") == "price_anomaly") & (F.col("generated_at") > clock.ago(days=1))
    return insights.filter(wanted).agg(F.count("*").alias("anomaly_count"))


def btc_eth_by_day(prices: DataFrame, clock: Clock, days: int = 7) -> DataFrame:
    """Daily highest BTC and ETH price; days without either symbol keep a row."""
    recent = prices.filter(F.col("timestamp") > clock.ago(days=days))
    return (
        recent.groupBy(local_date("timestamp", clock.zone).alias("date"))
        .pivot("symbol", ["BTC", "ETH"])
        .agg(F.max("price_usd"))
    )


def recent_alerts(insights: DataFrame, limit: int = 5) -> DataFrame:
    """Newest anomaly alerts, the message cut to 150 characters for the card."""
    alerts = insights.filter(F.col("insight_type") == "price_anomaly")
    return alerts.orderBy(F.desc("generated_at"), "id").limit(limit).select(
        F.col("generated_at").alias("detected_at"),
        F.get_json_object("content", "$.affected_symbols").alias("symbols"),
        F.left(F.get_json_object("content", "$.message"), F.lit(150)).alias("message"),
    )


def current_price(prices: DataFrame, symbol: str = "BTC") -> DataFrame:
    mine = prices.filter(F.col("symbol") == symbol)
    return mine.agg(F.max_by("price_usd", F.struct("timestamp", "id")).alias(f"{symbol} Price ($)"))


def weekly_card(weekly: DataFrame) -> DataFrame:
    return weekly.select(
        "week",
        F.col("avg_btc_price").alias("BTC ($)"),
        F.col("avg_eth_price").alias("ETH ($)"),
        F.col("avg_market_change").alias("Avg Change (%)"),
        F.col("total_news").alias("News"),
        F.col("avg_temperature").alias("Temp (°C)"),
    ).orderBy(F.desc("week"))


def news_price_card(news_correlation: DataFrame) -> DataFrame:
    return news_correlation.orderBy(F.desc("date")).limit(CARD_ROWS).select(
        "date",
        F.col("news_count").alias("News Count"),
        F.col("btc_avg_price").alias("BTC Price ($)"),
        F.col("btc_daily_pct_change").alias("BTC Daily Change (%)"),
    )


def dq_trend_card(trend: DataFrame) -> DataFrame:
    return trend.orderBy(F.desc("date"), "table_name").limit(CARD_ROWS).select(
        "date",
        F.col("table_name").alias("Table"),
        F.col("failures_count").alias("Failures"),
        F.col("auto_repaired_count").alias("Auto Repaired"),
    )


def weather_price_card(weather_correlation: DataFrame) -> DataFrame:
    return weather_correlation.orderBy(F.desc("date")).limit(CARD_ROWS).select(
        "date",
        F.col("avg_temperature").alias("Temperature (°C)"),
        F.col("btc_avg_price").alias("BTC Price ($)"),
        F.col("btc_daily_pct_change").alias("BTC Daily Change (%)"),
    )


def newest_mart_days(daily: DataFrame, limit: int = 5) -> DataFrame:
    return daily.orderBy(F.desc("date")).limit(limit).select("date", "btc_avg_price", "news_count")
