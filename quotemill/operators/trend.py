"""Trend facts per symbol over a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.times import epoch_micros, time_then_id
from quotemill.operators.joins import join_summary, settled

TOO_SHORT = "Insufficient data for trend analysis"


def trend_facts(prices: DataFrame, clock: Clock, days: int = 7, spike_sigmas: float = 3.0) -> DataFrame:
    """Direction, percent change, hourly slope and spike count of every symbol.

    A spike is a value more than `spike_sigmas` population deviations from the mean of
    its symbol. The statistics, one row per symbol, are computed at once; the second pass
    joins them back to the window (this call runs the first pass). Rows of the same time are
    ordered by id.
    """
    window = prices.filter(F.col("timestamp") >= clock.ago(days=days)).select(
        "symbol",
        F.col("price_usd").cast("double").alias("value"),
        time_then_id(F.col("timestamp"), F.col("id")).alias("order"),
        ((epoch_micros(F.col("timestamp")) - epoch_micros(clock.ago(days=days))) / 3_600_000_000.0).alias("hours"),
    )
    stats = settled(window.groupBy("symbol").agg(
        F.count("value").alias("points"),
        F.min_by("value", "order").alias("first_value"),
        F.max_by("value", "order").alias("last_value"),
        F.avg("value").alias("mean_value"),
        F.stddev_pop("value").alias("deviation"),
        F.regr_slope("value", "hours").alias("slope_per_hour"),
    ))
    spikes = (
        join_summary(window, stats.select("symbol", "mean_value", "deviation"), "symbol")
        .filter(F.abs(F.col("value") - F.col("mean_value")) > spike_sigmas * F.col("deviation"))
        .groupBy("symbol")
        .agg(F.count("*").alias("spikes"))
    )
    change = (F.col("last_value") - F.col("first_value")) / F.nullif(F.col("first_value"), F.lit(0.0)) * 100
    enough = F.col("points") >= 2
    return stats.join(spikes, "symbol", "left").select(
        "symbol",
        "points",
        F.when(enough, F.col("first_value")).alias("first_value"),
        F.when(enough, F.col("last_value")).alias("last_value"),
        F.when(enough, F.round(change, 2)).alias("pct_change"),
        F.when(enough, F.round("slope_per_hour", 6)).alias("slope_per_hour"),
        F.when(enough, F.coalesce("spikes", F.lit(0).cast("bigint"))).alias("spikes"),
        F.when(~enough, TOO_SHORT)
        .when(F.col("last_value") > F.col("first_value"), "up")
        .when(F.col("last_value") < F.col("first_value"), "down")
        .otherwise("stable")
        .alias("trend"),
    )
