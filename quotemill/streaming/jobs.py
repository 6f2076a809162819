"""The polling jobs as streams: anomalies, deduplication, hourly summary, merged pollers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.times import instant_to_utc, utc_to_instant
from quotemill.operators.alerts import ANOMALY_MINUTES, is_anomaly

EVENT_TIME = "event_time"


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Append the zoned event time a watermark needs."""
    return stream.withColumn(EVENT_TIME, utc_to_instant(F.col(column))).withWatermark(EVENT_TIME, delay)


def _window_bounds() -> list[Column]:
    return [
        instant_to_utc(F.col("window.start")).alias("window_start"),
        instant_to_utc(F.col("window.end")).alias("window_end"),
    ]


def anomaly_stream(prices: DataFrame, minutes: int = ANOMALY_MINUTES, delay: str = "15 minutes") -> DataFrame:
    """Per tumbling window and symbol the strongest anomaly, emitted once the window is closed.

    State is one row per open window and symbol: the maximum is kept, not the rows.
    """
    hits = with_event_time(prices.filter(is_anomaly()), "timestamp", delay)
    strongest = F.max_by(
        F.struct("id", "price_usd", "price_change_24h", "timestamp"),
        F.struct(F.abs("price_change_24h"), -F.unix_micros(EVENT_TIME), -F.col("id")),
    ).alias("row")
    return (
        hits.groupBy(F.window(EVENT_TIME, f"{minutes} minutes"), "symbol")
        .agg(strongest, F.count("*").alias("rows_seen"))
        .select(*_window_bounds(), "symbol", "rows_seen", "row.*")
    )


def new_articles_stream(news: DataFrame, keep: str = "7 days") -> DataFrame:
    """Articles whose URL was not seen within the retention; articles without URL all pass."""
    keyed = news.withColumn("_key", F.coalesce("url", F.concat(F.lit("id:"), F.col("id").cast("string"))))
    timed = with_event_time(keyed, "fetched_at", keep)
    return timed.dropDuplicatesWithinWatermark(["_key"]).drop("_key", EVENT_TIME)


def hourly_summary_stream(prices: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """One summary row of the log per closed hour."""
    hourly = (
        with_event_time(prices, "timestamp", delay)
        .groupBy(F.window(EVENT_TIME, "1 hour"))
        .agg(
            F.count("*").alias("rows_seen"),
            F.sum("price_change_24h").alias("change_sum"),
            F.count("price_change_24h").alias("change_count"),
            F.count_if(is_anomaly()).alias("anomalies"),
        )
        .select(*_window_bounds(), "rows_seen", "change_sum", "change_count", "anomalies")
    )
    body = F.to_json(
        F.struct("rows_seen", "change_sum", "change_count", "anomalies"), {"ignoreNullFields": "false"}
    )
    return hourly.select(
        F.lit("daily_summary").alias("insight_type"), body.alias("content"), F.col("window_end").alias("generated_at")
    )


def merged_pollers_stream(first: DataFrame, second: DataFrame, delay: str = "15 minutes", deduplicate: bool = False) -> DataFrame:
    """Two pollers of one feed; both rows are kept unless deduplication is asked for."""
    both = first.unionByName(second)
    if not deduplicate:
        return both
    timed = with_event_time(both, "timestamp", delay)
    return timed.dropDuplicatesWithinWatermark(["symbol", "timestamp"]).drop(EVENT_TIME)


def poller_gaps_stream(first: DataFrame, second: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """(symbol, timestamp, seen_by) of the polls that only one of two pollers saw.

    A full outer join on symbol and poll time. A row waits in the state for its counterpart until
    the slower poller's watermark has passed its time; then it is known to be missing there. Rows
    repeated within the delay count once. A poll without symbol or time has no counterpart and no
    part in the comparison.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        known = rows.where("symbol IS NOT NULL AND timestamp IS NOT NULL").select("symbol", "timestamp")
        timed = with_event_time(known, "timestamp", delay).dropDuplicatesWithinWatermark(["symbol", "timestamp"])
        return timed.select("symbol", EVENT_TIME, F.lit(name).alias(name))

    a, b = side(first, "first").alias("a"), side(second, "second").alias("b")
    same = (F.col("a.symbol") == F.col("b.symbol")) & (F.col(f"a.{EVENT_TIME}") == F.col(f"b.{EVENT_TIME}"))
    alone = a.join(b, same, "full_outer").where("first IS NULL OR second IS NULL")
    return alone.select(
        F.coalesce("a.symbol", "b.symbol").alias("symbol"),
        instant_to_utc(F.coalesce(f"a.{EVENT_TIME}", f"b.{EVENT_TIME}")).alias("timestamp"),
        F.coalesce("first", "second").alias("seen_by"),
    )
