"""Mergeable states of days: what the daily mart needs of each source, as sums and maxima.

A state row holds one (date, source, key): the symbol of prices, the condition of weather
readings, no key for articles and failures. States of any parts of the rows add up to the state
of all rows, so a mart is built from the states of its parts without their rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.numbers import exact_avg
from quotemill.functions.times import local_date
from quotemill.operators.staging import stage_news, stage_prices, stage_weather
from quotemill.plans.marts import daily_columns

STATE = (
    "date DATE, source STRING, key STRING, n BIGINT, value_sum DECIMAL(38,8), value_n BIGINT, "
    "change_sum DECIMAL(38,8), change_n BIGINT, change_max DECIMAL(18,8)"
)
SUMS = ["n", "value_sum", "value_n", "change_sum", "change_n"]


def _state(rows: DataFrame, source: str, key: Column | None = None, value: str | None = None, change: str | None = None) -> DataFrame:
    named = F.lit(None).cast("string") if key is None else key
    measure = lambda c: F.col(c).cast("decimal(18,8)") if c else F.lit(None).cast("decimal(18,8)")
    found = rows.groupBy("date", named.alias("key")).agg(
        F.count("*").alias("n"),
        F.sum(measure(value)).alias("value_sum"), F.count(measure(value)).alias("value_n"),
        F.sum(measure(change)).alias("change_sum"), F.count(measure(change)).alias("change_n"),
        F.max(F.abs(measure(change))).alias("change_max"),
    )
    return as_states(found.withColumn("source", F.lit(source)))


def as_states(df: DataFrame) -> DataFrame:
    """Columns and types of a state table."""
    parts = [field.strip().split(" ") for field in STATE.replace(",8)", ";8)").split(",")]
    return df.select(*[F.col(name).cast(kind.replace(";", ",")).alias(name) for name, kind in parts])


def states_of(
    clock: Clock,
    prices: DataFrame | None = None,
    news: DataFrame | None = None,
    readings: DataFrame | None = None,
    insights: DataFrame | None = None,
    city: str = "Warsaw",
) -> DataFrame:
    """States of any of the four sources, with the row filters of the daily mart.

    Each source is folded where it is read; a symbol that holds most rows sends one row a task.
    """
    parts = []
    if prices is not None:
        parts.append(_state(stage_prices(prices, clock), "price", F.col("symbol"), "price_usd", "price_change_24h"))
    if news is not None:
        parts.append(_state(stage_news(news, clock), "news"))
    if readings is not None:
        parts.append(_state(stage_weather(readings, clock, city), "weather", F.col("weather_condition"), "temperature"))
    if insights is not None:
        failed = insights.filter(F.col("insight_type") == "dq_failure")
        parts.append(_state(failed.select(local_date("generated_at", clock.zone).alias("date")), "failure"))
    return reduce(DataFrame.unionByName, parts)


def merged(states: DataFrame) -> DataFrame:
    """One state per (date, source, key)."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    return as_states(states.groupBy("date", "source", "key").agg(*sums, F.max("change_max").alias("change_max")))


def daily_from_states(states: DataFrame) -> DataFrame:
    """The daily mart of the days that have prices. All sources fold into one row per date: no join."""
    of = lambda source, value: F.when(F.col("source") == source, value)
    total = lambda source, name: F.sum(of(source, F.col(name)))

    def symbol_avg(symbol: str) -> Column:
        mine = (F.col("source") == "price") & (F.col("key") == symbol)
        return exact_avg(F.max(F.when(mine, F.col("value_sum"))), F.max(F.when(mine, F.col("value_n"))))

    by_date = merged(states).groupBy("date").agg(
        F.count(of("price", F.col("key"))).alias("active_coins"),
        symbol_avg("BTC").alias("btc_mean"),
        symbol_avg("ETH").alias("eth_mean"),
        exact_avg(total("price", "change_sum"), total("price", "change_n")).alias("change_mean"),
        F.max(of("price", F.col("change_max"))).alias("max_abs_change"),
        F.coalesce(total("news", "n"), F.lit(0).cast("bigint")).alias("news_count"),
        exact_avg(total("weather", "value_sum"), total("weather", "value_n")).alias("temperature_mean"),
        F.min(F.when((F.col("source") == "weather") & F.col("key").isNotNull(), F.struct(-F.col("n"), "key")))["key"].alias("top_condition"),
        F.coalesce(total("failure", "n"), F.lit(0).cast("bigint")).alias("dq_failures_count"),
        F.count(of("price", F.lit(1))).alias("_prices"),
    )
    return daily_columns(by_date.where("_prices > 0"))
