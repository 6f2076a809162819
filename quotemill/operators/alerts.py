"""Price anomalies, alert documents and freshness alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.times import minutes_between
from quotemill.sources.sinks import insight

# Alert rule and message texts.
ANOMALY_PERCENT = 5
ANOMALY_MINUTES = 15
ANOMALY_ROWS = 10
FRESHNESS_MINUTES = 15
ALERT_TITLE = "⚠️ *ANOMALIE CENOWE (%d)*\n\n"
ALERT_NOTES = "\n\n---\n🤖 *WYJAŚNIENIA:*\n\n"
ALERT_NOTE_BREAK = "\n\n---\n\n"


def _strength() -> Column:
    return F.abs("price_change_24h")


def is_anomaly(threshold: float = ANOMALY_PERCENT) -> Column:
    return _strength() > threshold


def recent_anomalies(
    prices: DataFrame, clock: Clock, minutes: int = ANOMALY_MINUTES, limit: int | None = ANOMALY_ROWS
) -> DataFrame:
    """The strongest rows of the last minutes, or all without a limit; a symbol can take several places."""
    recent = prices.filter((F.col("timestamp") >= clock.ago(minutes=minutes)) & is_anomaly())
    if limit is not None:
        recent = recent.orderBy(_strength().desc(), "timestamp", "id").limit(limit)
    return recent.select(
        "id", "symbol", "price_usd", "price_change_24h", "timestamp"
    )


def anomaly_windows(prices: DataFrame, minutes: int = ANOMALY_MINUTES) -> DataFrame:
    """All anomalies with the tumbling window they fall into."""
    span = F.window("timestamp", f"{minutes} minutes")
    return prices.filter(is_anomaly()).select(
        span["start"].alias("window_start"), span["end"].alias("window_end"),
        "id", "symbol", "price_usd", "price_change_24h", "timestamp",
    )


def strongest_per_symbol(anomalies: DataFrame, *by: str) -> DataFrame:
    """One row per symbol (and `by` columns): the largest absolute change, the first on ties.

    The row number is limited to 1, so each map task forwards one row per key however many
    rows a symbol or a window holds.
    """
    strongest = Window.partitionBy(*by, "symbol").orderBy(_strength().desc(), "timestamp", "id")
    return anomalies.withColumn("_place", F.row_number().over(strongest)).filter(F.col("_place") == 1).drop("_place")


def alertable(rows: DataFrame) -> DataFrame:
    """Rows with a symbol and a numeric price other than 0."""
    price = F.col("price_usd").try_cast("double")
    return rows.filter((F.col("symbol") != "") & price.isNotNull() & ~F.isnan(price) & (price != 0))


def anomaly_facts(anomalies: DataFrame) -> DataFrame:
    """Direction, absolute change and the sentence handed to the text model."""
    change = F.col("price_change_24h")
    direction = F.when(change > 0, "wzrost").otherwise("spadek")
    return anomalies.withColumns(
        {
            "direction": direction,
            "abs_change": F.abs(change),
            "facts": F.concat(
                F.lit("Kryptowaluta: "), F.col("symbol"),
                F.lit(", cena: $"), _two_places(F.col("price_usd")),
                F.lit(" USD, zmiana 24h: "), _two_places(change), F.lit("% ("), direction,
                F.lit(" o "), _two_places(F.abs(change)), F.lit("%)"),
            ),
        }
    )


def _two_places(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(20,2)").cast("string")


def with_explanations(anomalies: DataFrame, explanations: DataFrame) -> DataFrame:
    """Anomalies with the explanation of their symbol; without one the text is NULL."""
    return anomalies.join(explanations.select("symbol", "explanation"), "symbol", "left")


def alert_documents(rows: DataFrame, detected_at: Column, *by: str) -> DataFrame:
    """One alert per group of `by`: count, symbols, message and JSON body.

    Input is already reduced to one row per symbol and pass, so a message lists each symbol
    once; a group is one alert message.
    """
    entry = F.struct(
        (-_strength()).alias("rank"), "timestamp", "id", "symbol",
        F.concat(
            F.col("symbol"), F.lit(": USD "), _two_places(F.col("price_usd")),
            F.lit(" | change 24h: "), _two_places(F.col("price_change_24h")), F.lit("%"),
        ).alias("line"),
        "explanation",
    )
    grouped = alertable(rows).groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    entries = F.col("entries")
    notes = F.array_compact(F.transform(entries, lambda e: e["explanation"]))
    numbered = F.transform(notes, lambda note, i: F.concat((i + 1).cast("string"), F.lit(". "), note))
    listed = grouped.select(
        *by,
        F.size(entries).alias("anomaly_count"),
        F.transform(entries, lambda e: e["symbol"]).alias("affected_symbols"),
        F.concat(
            F.format_string(ALERT_TITLE, F.size(entries)),
            F.array_join(F.transform(entries, lambda e: e["line"]), "\n"),
            F.lit(ALERT_NOTES),
            F.array_join(numbered, ALERT_NOTE_BREAK),
        ).alias("message"),
        F.array_join(notes, "\n---\n").alias("detailed_explanations"),
        detected_at.alias("detected_at"),
    ).filter(F.col("anomaly_count") > 0)
    body = F.struct(
        F.lit("price_anomaly").alias("alert_type"), "affected_symbols", "message", "detailed_explanations",
        F.col("detected_at").cast("string").alias("detected_at"),
    )
    return listed.withColumn("content", F.to_json(body))


def alert_log(documents: DataFrame, row_id: Column | None = None) -> DataFrame:
    return insight(documents, "price_anomaly", F.col("content"), F.col("detected_at"), row_id)


def stale_tables(metadata: DataFrame, clock: Clock, minutes: int = FRESHNESS_MINUTES) -> DataFrame:
    """Tables whose last success is older than the limit, with the delay in minutes."""
    late = metadata.filter(F.col("last_successful_ts") < clock.ago(minutes=minutes))
    return late.select(
        "table_name",
        "last_successful_ts",
        minutes_between(clock.now_column(), F.col("last_successful_ts")).alias("minutes_ago"),
    )


def freshness_message(stale: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("⚠️ <b>DATA FRESHNESS ALERT</b> ⚠️\n\n<b>Table:</b> "), F.col("table_name"),
        F.lit("\n<b>Last successful update:</b> "), F.col("last_successful_ts").cast("string"),
        F.lit("\n<b>Delay:</b> "), F.floor("minutes_ago").cast("string"),
        F.lit(" minutes\n\nPlease check the data pipeline!"),
    )
    return stale.withColumn("message", text)
