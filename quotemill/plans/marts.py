"""Daily and weekly marts, correlation tables and quality views.

The three date joins of the daily mart run on one row per date: every join key is the
date alone and every aggregate is grouped by it, so aggregating each source first gives
the same result as joining raw rows, without the prices x news x weather fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.numbers import exact_avg, market_mood, pct_change
from quotemill.functions.times import local_date
from quotemill.operators.quality.log import failures_by_day
from quotemill.operators.staging import stage_news, stage_prices, stage_weather


def daily_crypto_stats(prices: DataFrame, clock: Clock, days: int = 7) -> DataFrame:
    """Average, highest and lowest price per symbol and local date."""
    recent = prices.filter(F.col("timestamp") >= clock.day_start(days))
    return (
        recent.groupBy("symbol", local_date("timestamp", clock.zone).alias("date"))
        .agg(
            exact_avg(F.sum("price_usd"), F.count("price_usd")).alias("avg_price"),
            F.max("price_usd").alias("max_price"),
            F.min("price_usd").alias("min_price"),
        )
    )


def _prices_by_date(prices: DataFrame) -> DataFrame:
    """Per date: distinct symbols, BTC and ETH price mean, change mean and extreme.

    Sums per (date, symbol) first, so the distinct count costs no extra shuffle of rows
    and a symbol holding most rows is folded inside each map task.
    """
    per_symbol = prices.groupBy("date", "symbol").agg(
        F.sum("price_usd").alias("price_sum"),
        F.count("price_usd").alias("price_n"),
        F.sum("price_change_24h").alias("change_sum"),
        F.count("price_change_24h").alias("change_n"),
        F.max(F.abs("price_change_24h")).alias("change_max"),
    )

    def symbol_avg(symbol: str) -> Column:
        mine = F.col("symbol") == symbol
        return exact_avg(F.max(F.when(mine, F.col("price_sum"))), F.max(F.when(mine, F.col("price_n"))))

    return per_symbol.groupBy("date").agg(
        F.count("symbol").alias("active_coins"),
        symbol_avg("BTC").alias("btc_mean"),
        symbol_avg("ETH").alias("eth_mean"),
        exact_avg(F.sum("change_sum"), F.sum("change_n")).alias("change_mean"),
        F.max("change_max").alias("max_abs_change"),
    )


def _weather_by_date(readings: DataFrame) -> DataFrame:
    """Mean temperature and most common condition, the first in sort order on ties."""
    per_condition = readings.groupBy("date", "weather_condition").agg(
        F.sum("temperature").alias("t_sum"), F.count("temperature").alias("t_n"), F.count("*").alias("n")
    )
    known = F.col("weather_condition").isNotNull()
    return per_condition.groupBy("date").agg(
        exact_avg(F.sum("t_sum"), F.sum("t_n")).alias("temperature_mean"),
        F.min(F.when(known, F.struct(-F.col("n"), "weather_condition")))["weather_condition"].alias("top_condition"),
    )


def _count_by_date(rows: DataFrame, name: str) -> DataFrame:
    """Rows per date; ids are primary keys, so counting rows counts distinct ids."""
    return rows.groupBy("date").agg(F.count("*").alias(name))


def _joined(prices: DataFrame, news: DataFrame, readings: DataFrame, failed: DataFrame) -> DataFrame:
    return (
        _prices_by_date(prices)
        .join(_count_by_date(news, "news_count"), "date", "left")
        .join(_weather_by_date(readings), "date", "left")
        .join(_count_by_date(failed, "dq_failures_count"), "date", "left")
        .withColumns(
            {
                "news_count": F.coalesce("news_count", F.lit(0).cast("bigint")),
                "dq_failures_count": F.coalesce("dq_failures_count", F.lit(0).cast("bigint")),
            }
        )
    )


def _failure_dates(insights: DataFrame, clock: Clock) -> DataFrame:
    return insights.filter(F.col("insight_type") == "dq_failure").select(
        local_date("generated_at", clock.zone).alias("date")
    )


def _since(
    prices: DataFrame, news: DataFrame, readings: DataFrame, insights: DataFrame, clock: Clock, days: int | None
) -> tuple[DataFrame, ...]:
    """The four inputs from a local midnight on; the bounds are on raw columns and reach the scans."""
    if days is None:
        return prices, news, readings, insights
    start = clock.day_start(days)
    return (
        prices.filter(F.col("timestamp") >= start),
        news.filter(F.col("published_at") >= start),
        readings.filter(F.col("timestamp") >= start),
        insights.filter(F.col("generated_at") >= start),
    )


def market_daily_view(
    prices: DataFrame, news: DataFrame, readings: DataFrame, insights: DataFrame, clock: Clock, days: int = 90
) -> DataFrame:
    """Daily mart over the raw tables: no price, title or city filter."""
    prices, news, readings, insights = _since(prices, news, readings, insights, clock, days)
    joined = _joined(
        prices.withColumn("date", local_date("timestamp", clock.zone)),
        news.select(local_date("published_at", clock.zone).alias("date")),
        readings.select(local_date("timestamp", clock.zone).alias("date"), "temperature", "weather_condition"),
        _failure_dates(insights, clock),
    )
    return joined.select(
        "date",
        "active_coins",
        F.round("btc_mean", 2).alias("btc_avg_price"),
        F.round("eth_mean", 2).alias("eth_avg_price"),
        F.round("change_mean", 4).alias("market_avg_change"),
        F.round("max_abs_change", 4).alias("max_abs_price_change"),
        market_mood(F.col("change_mean")).alias("market_sentiment"),
        "news_count",
        F.lit(None).cast("decimal(10,4)").alias("avg_news_sentiment"),
        F.lit(0).alias("positive_news"),
        F.lit(0).alias("negative_news"),
        F.round("temperature_mean", 1).alias("warsaw_avg_temp"),
        F.col("top_condition").alias("dominant_weather"),
        "dq_failures_count",
    )


def market_daily(
    prices: DataFrame,
    news: DataFrame,
    readings: DataFrame,
    insights: DataFrame,
    clock: Clock,
    city: str = "Warsaw",
    days: int | None = None,
) -> DataFrame:
    """Daily mart over the staged tables; with `days` only the days a window of that length needs."""
    prices, news, readings, insights = _since(prices, news, readings, insights, clock, days)
    joined = _joined(
        stage_prices(prices, clock),
        stage_news(news, clock),
        stage_weather(readings, clock, city),
        _failure_dates(insights, clock),
    )
    return daily_columns(joined)


def daily_columns(joined: DataFrame) -> DataFrame:
    """The published columns of the daily mart from one row per date."""
    return joined.select(
        "date",
        F.round("btc_mean", 2).alias("btc_avg_price"),
        F.round("eth_mean", 2).alias("eth_avg_price"),
        F.round("change_mean", 2).alias("avg_price_change"),
        "active_coins",
        "news_count",
        F.round("temperature_mean", 1).alias("avg_temperature"),
        "dq_failures_count",
    )


def weekly_summary(daily: DataFrame, clock: Clock, days: int = 90) -> DataFrame:
    """Means of the daily values and total news per week starting on Monday.

    `daily` may be the published mart or a `market_daily` of the same `days`.
    """

    def mean(name: str) -> Column:
        return exact_avg(F.sum(name), F.count(name))

    return (
        daily.filter(F.col("date") >= clock.day(days))
        .groupBy(F.date_trunc("week", "date").cast("date").alias("week"))
        .agg(
            F.round(mean("btc_avg_price"), 2).alias("avg_btc_price"),
            F.round(mean("eth_avg_price"), 2).alias("avg_eth_price"),
            F.round(mean("avg_price_change"), 2).alias("avg_market_change"),
            F.sum("news_count").alias("total_news"),
            F.round(mean("avg_temperature"), 1).alias("avg_temperature"),
        )
    )


def _with_btc_change(daily: DataFrame, measure: str, clock: Clock, days: int) -> DataFrame:
    """A daily measure next to the BTC price, its previous present value and the change.

    The window has no partition key: its input is one row per day of a window of `days`
    days, so it never holds more than days + 1 rows.
    """
    by_date = Window.orderBy("date")
    return (
        daily.filter(F.col("date") >= clock.day(days))
        .filter(F.col("date") <= clock.day())
        .select("date", measure, "btc_avg_price", F.lag("btc_avg_price", 1).over(by_date).alias("prev_btc_price"))
        .withColumn("btc_daily_pct_change", pct_change(F.col("btc_avg_price"), F.col("prev_btc_price")))
    )


def news_correlation(daily: DataFrame, clock: Clock, days: int = 30) -> DataFrame:
    return _with_btc_change(daily, "news_count", clock, days)


def weather_correlation(daily: DataFrame, clock: Clock, days: int = 30) -> DataFrame:
    return _with_btc_change(daily, "avg_temperature", clock, days)


def news_daily(news: DataFrame, clock: Clock, days: int = 30) -> DataFrame:
    """Articles per local date with the placeholder tone columns."""
    recent = news.filter(F.col("published_at") >= clock.day_start(days))
    empty = F.lit(None).cast("decimal(10,4)")
    return recent.groupBy(local_date("published_at", clock.zone).alias("date")).agg(
        F.count("*").alias("article_count")
    ).select(
        "date",
        "article_count",
        empty.alias("avg_sentiment"),
        empty.alias("min_sentiment"),
        empty.alias("max_sentiment"),
        F.lit(0).alias("positive_count"),
        F.lit(0).alias("negative_count"),
        F.col("article_count").alias("no_sentiment_count"),
    )


# --- quality views -----------------------------------------------------------------------

def dq_trend(insights: DataFrame, clock: Clock, days: int = 30) -> DataFrame:
    """Failures and repairs per local date and table."""
    recent = insights.filter(F.col("generated_at") >= clock.day_start(days))
    return failures_by_day(recent, clock.zone).groupBy("date", "table_name").agg(
        F.count("*").alias("failures_count"),
        F.count_if(F.col("auto_repaired") == "true").alias("auto_repaired_count"),
    )


def dq_summary(insights: DataFrame, clock: Clock) -> DataFrame:
    """Failures per local date, table and first failed check."""
    staged = failures_by_day(insights, clock.zone)
    return staged.groupBy(
        "date", "table_name", F.get("failed_checks", F.lit(0)).alias("primary_failure_type")
    ).agg(
        F.count("*").alias("failure_count"),
        F.count_if(F.col("auto_repaired").cast("boolean")).alias("auto_repaired_count"),
        F.max("generated_at").alias("last_seen"),
    )
