"""Staging projections: row filters plus local time and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.times import local_date, local_time


def stage_prices(prices: DataFrame, clock: Clock) -> DataFrame:
    """Positive prices that are not in the future."""
    return prices.filter((F.col("price_usd") > 0) & (F.col("timestamp") <= clock.now_column())).select(
        "symbol", "price_usd", "volume_24h", "price_change_24h",
        local_time("timestamp", clock.zone).alias("timestamp_local"),
        local_date("timestamp", clock.zone).alias("date"),
    )


def stage_news(news: DataFrame, clock: Clock) -> DataFrame:
    """Articles with a title."""
    return news.filter(F.col("title").isNotNull() & (F.col("title") != "")).select(
        "id", "title", "description", "source", "url",
        local_time("published_at", clock.zone).alias("published_at_local"),
        local_date("published_at", clock.zone).alias("date"),
    )


def stage_weather(readings: DataFrame, clock: Clock, city: str = "Warsaw") -> DataFrame:
    """Readings of one city."""
    return readings.filter(F.col("city") == city).select(
        "city", "temperature", "humidity", "weather_condition",
        local_time("timestamp", clock.zone).alias("timestamp_local"),
        local_date("timestamp", clock.zone).alias("date"),
    )
