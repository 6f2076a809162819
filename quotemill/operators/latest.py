"""Latest rows, top-k lists and price series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.clock import Clock, instant
from quotemill.functions.numbers import market_mood
from quotemill.functions.times import time_then_id
from quotemill.operators.joins import settled


def latest_prices(prices: DataFrame) -> DataFrame:
    """Rows whose time is the newest time of some symbol.

    The membership test is not tied to the row's own symbol. The newest times, one row per
    symbol, are computed and stored at once (this call runs a job); rows older than the oldest
    of them cannot match, so that bound is pushed into the second and last scan.
    """
    newest = settled(prices.groupBy("symbol").agg(F.max("timestamp").alias("timestamp")).select("timestamp").distinct())
    oldest = newest.agg(F.min("timestamp")).first()[0]
    tail = prices if oldest is None else prices.filter(F.col("timestamp") >= instant(oldest))
    return tail.join(newest, "timestamp", "left_semi")


def market_sentiment(latest: DataFrame) -> DataFrame:
    """Mood from the mean change of the latest set; a missing change counts as 0."""
    change = F.coalesce(F.col("price_change_24h"), F.lit(0)).cast("decimal(10,2)")
    mean = F.sum(change).cast("decimal(38,18)") / F.nullif(F.count("*"), F.lit(0)).cast("decimal(20,0)")
    return latest.agg(market_mood(mean).alias("market_sentiment"))


def newest(df: DataFrame, column: str, limit: int = 1, tie: str = "id", nulls_first: bool = True) -> DataFrame:
    """The `limit` newest rows; NULL times come first on a descending sort by default."""
    order = F.desc_nulls_first(column) if nulls_first else F.desc_nulls_last(column)
    return df.orderBy(order, tie).limit(limit)


def newest_articles(news: DataFrame, limit: int = 10) -> DataFrame:
    return newest(news, "published_at", limit).select("id", "title", "description", "source", "published_at", "url")


def newest_weather(readings: DataFrame, limit: int = 1) -> DataFrame:
    return newest(readings, "timestamp", limit).select("city", "temperature", "humidity", "weather_condition")


def newest_prices(prices: DataFrame, limit: int = 1) -> DataFrame:
    return newest(prices, "timestamp", limit).select("symbol", "price_usd", "volume_24h", "price_change_24h", "timestamp")


def stock_changes(stocks: DataFrame, limit: int = 20) -> DataFrame:
    """Newest closing prices by trading date, then symbol."""
    return stocks.orderBy(F.desc("trading_date"), "symbol").limit(limit).select("symbol", "close_price", "trading_date")


def sector_label(stocks: DataFrame) -> DataFrame:
    any_row = F.count("*") > 0
    return stocks.agg(
        F.when(any_row, "Technology: Active").otherwise("Market Stable").alias("sector_performance")
    )


def newest_daily_stats(stats: DataFrame, limit: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("date"), "symbol").limit(limit)


def top_volume(latest: DataFrame, limit: int = 10) -> DataFrame:
    """Largest 24h volumes of the latest set; NULL volumes come first, as on any descending sort there."""
    ranked = latest.orderBy(F.desc_nulls_first("volume_24h"), "symbol", "id").limit(limit)
    return ranked.select("symbol", "price_usd", "price_change_24h", "volume_24h")


def symbol_row(latest: DataFrame, symbol: str) -> DataFrame:
    return latest.filter(F.col("symbol") == symbol)


def price_series(prices: DataFrame, clock: Clock, symbol: str = "BTC", days: int = 7) -> DataFrame:
    """Prices of one symbol over the last days, in time order."""
    wanted = (F.col("symbol") == symbol.upper()) & (F.col("timestamp") >= clock.ago(days=days))
    return prices.filter(wanted).select(F.col("price_usd").alias("value"), "timestamp").orderBy("timestamp")


def direction_of(change: Column) -> Column:
    return F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")


def series_direction(prices: DataFrame) -> DataFrame:
    """Per symbol: up if the last value is at least the first, neutral with one point.

    Rows of the same time are ordered by id.
    """
    order = time_then_id(F.col("timestamp"), F.col("id"))
    first, last = F.min_by("price_usd", order), F.max_by("price_usd", order)
    return prices.groupBy("symbol").agg(
        F.count("*").alias("points"),
        F.when(F.count("*") < 2, "neutral").when(last >= first, "up").otherwise("down").alias("direction"),
    )
