"""Report bundles: overview, daily metrics, quality report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.times import epoch_micros
from quotemill.operators import latest
from quotemill.operators.joins import settled
from quotemill.operators.quality import run_checks
from quotemill.operators.quality.log import failures
from quotemill.plans.marts import daily_crypto_stats

SHOWN_FAILURES, SHOWN_ANOMALIES = 10, 5


def newest_row_issues(
    clock: Clock,
    prices: DataFrame | None = None,
    readings: DataFrame | None = None,
    news: DataFrame | None = None,
    symbol: str | None = None,
) -> DataFrame:
    """Failed checks of the newest row of each given table, in one list; absent tables are skipped."""
    parts = []
    if prices is not None:
        mine = prices if symbol is None else prices.filter(F.col("symbol") == symbol.upper())
        row = latest.newest(mine, "timestamp").select("symbol", "price_usd", "volume_24h", "price_change_24h")
        parts.append(run_checks(row, "crypto_prices", clock, F.col("symbol")))
    if readings is not None:
        row = latest.newest(readings, "timestamp").select("city", "temperature", "humidity", "weather_condition")
        parts.append(run_checks(row, "weather_data", clock, F.col("city")))
    if news is not None:
        row = latest.newest(news, "published_at").select("title", "description", "source", "url", "published_at")
        parts.append(run_checks(row, "news_articles", clock, F.left("title", F.lit(50))))
    lists = [
        p.select(F.col("dq_table").alias("table_name"), "record_id", F.posexplode("failed_checks").alias("at", "check_name"))
        for p in parts
    ]
    return reduce(DataFrame.unionByName, lists)


def articles_today(news: DataFrame, clock: Clock) -> DataFrame:
    """Articles published on the current local date; a range on the raw column, so it is pushed down."""
    wanted = (F.col("published_at") >= clock.day_start()) & (F.col("published_at") < clock.day_start(-1))
    return news.filter(wanted).agg(F.count("*").alias("news_count"))


def overview(prices: DataFrame, stocks: DataFrame, news: DataFrame, readings: DataFrame, clock: Clock) -> dict[str, DataFrame]:
    """The parts of the dashboard overview."""
    current = latest.latest_prices(prices)
    changes = latest.stock_changes(stocks)
    return {
        "prices": current.select("symbol", "price_usd", "price_change_24h", "market_cap"),
        "daily_stats": latest.newest_daily_stats(daily_crypto_stats(prices, clock)),
        "market_sentiment": latest.market_sentiment(current),
        "stocks": changes,
        "sector_performance": latest.sector_label(stocks),
        "news": latest.newest_articles(news),
        "weather": latest.newest_weather(readings),
        "data_quality_issues": newest_row_issues(clock, prices, readings, news),
    }


def daily_metrics(prices: DataFrame, stocks: DataFrame, news: DataFrame, readings: DataFrame, clock: Clock) -> DataFrame:
    """(metric, item, value) rows of the daily summary input.

    The latest set grows with the number of symbols, so it stays rows instead of
    becoming one list in one row.
    """
    def rows(metric: str, item, value) -> list:
        return [F.lit(metric).alias("metric"), item.cast("string").alias("item"), value.cast("string").alias("value")]

    weather = latest.newest_weather(readings)
    parts = [
        latest.latest_prices(prices).select(*rows("crypto_price", F.col("symbol"), F.col("price_usd"))),
        latest.stock_changes(stocks).select(
            *rows("stock_price", F.concat_ws(" ", "symbol", "trading_date"), F.col("close_price"))
        ),
        articles_today(news, clock).select(*rows("news_count", F.lit("today"), F.col("news_count"))),
        weather.select(*rows("weather", F.lit("temperature"), F.col("temperature"))),
        weather.select(*rows("weather", F.lit("humidity"), F.col("humidity"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _recent(insights: DataFrame, kind: str, clock: Clock, hours: int, newest: int | None) -> DataFrame:
    wanted = (F.col("insight_type") == kind) & (F.col("generated_at") >= clock.ago(hours=hours))
    rows = insights.filter(wanted)
    return rows if newest is None else rows.orderBy(F.desc("generated_at"), "id").limit(newest)


def dq_report(
    insights: DataFrame,
    clock: Clock,
    hours: int = 24,
    newest_failures: int | None = None,
    newest_anomalies: int | None = None,
    shown_failures: int = SHOWN_FAILURES,
    shown_anomalies: int = SHOWN_ANOMALIES,
) -> dict[str, DataFrame]:
    """Quality report of the last hours: totals over the whole window, lists of the newest rows.

    `newest_failures` and `newest_anomalies` restrict the whole report to so many rows before
    counting, as the service does with 100 and 20. The rows of the window are stored once for
    all parts (this call runs that job).
    """
    failed = settled(failures(_recent(insights, "dq_failure", clock, hours, newest_failures)))
    alerts = _recent(insights, "price_anomaly", clock, hours, newest_anomalies)
    anomalies = settled(
        alerts.select(
            "id",
            F.get_json_object("content", "$.message").alias("message"),
            F.get_json_object("content", "$.affected_symbols").alias("symbols"),
            "generated_at",
        )
    )
    # The newest failure comes first; within a time the lowest id.
    place = F.struct(-epoch_micros(F.col("generated_at")), F.col("id"))
    by_table = failed.groupBy(F.coalesce("table_name", F.lit("unknown")).alias("table_name")).agg(
        F.count("*").alias("failures"), F.min(place).alias("first_place")
    )
    named = F.array_sort(F.collect_list(F.struct("first_place", "table_name")))
    totals = by_table.agg(
        F.sum("failures").alias("total_dq_events"),
        F.array_join(F.transform(named, lambda t: t["table_name"]), ",").alias("tables_with_issues"),
    )
    common = (
        failed.select(place.alias("place"), F.posexplode("failed_checks").alias("at", "check_name"))
        .groupBy("check_name")
        .agg(F.count("*").alias("n"), F.min(F.struct("place", "at")).alias("first_seen"))
        .agg(F.min_by("check_name", F.struct(-F.col("n"), "first_seen")).alias("most_common_failure"))
    )
    counted = anomalies.agg(F.count("*").alias("total_anomalies"))
    parts = totals.unionByName(common, allowMissingColumns=True).unionByName(counted, allowMissingColumns=True)
    summary = parts.agg(
        F.coalesce(F.max("total_dq_events"), F.lit(0).cast("bigint")).alias("total_dq_events"),
        F.max("tables_with_issues").alias("tables_with_issues"),
        F.max("most_common_failure").alias("most_common_failure"),
        F.max("total_anomalies").alias("total_anomalies"),
    ).withColumn("period_hours", F.lit(hours))
    newest = [F.desc("generated_at"), F.asc("id")]
    return {
        "summary": summary,
        "by_table": by_table.select("table_name", "failures"),
        "recent_failures": failed.orderBy(*newest).limit(shown_failures),
        "recent_anomalies": anomalies.orderBy(*newest).limit(shown_anomalies),
    }
