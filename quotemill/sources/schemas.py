"""Declared schemas and constraints of the six domain tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, INT, TEXT, DAY, TIME = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType()

CRYPTO_PRICES = _struct(
    id=LONG, symbol=TEXT, price_usd=T.DecimalType(18, 8), market_cap=LONG, volume_24h=LONG,
    price_change_24h=T.DecimalType(10, 2), timestamp=TIME,
)
WEATHER_DATA = _struct(
    id=LONG, city=TEXT, temperature=T.DecimalType(5, 2), humidity=INT, weather_condition=TEXT, timestamp=TIME
)
NEWS_ARTICLES = _struct(
    id=LONG, title=TEXT, description=TEXT, source=TEXT, url=TEXT, published_at=TIME, fetched_at=TIME,
    embedding=T.ArrayType(T.FloatType()),
)
STOCK_PRICES = _struct(
    id=LONG, symbol=TEXT, close_price=T.DecimalType(10, 2), volume=LONG, trading_date=DAY, timestamp=TIME
)
AI_INSIGHTS = _struct(id=LONG, insight_type=TEXT, content=TEXT, data_snapshot=TEXT, generated_at=TIME)
DQ_METADATA = _struct(id=LONG, table_name=TEXT, last_successful_ts=TIME, rows_inserted=LONG, last_check=TIME)


@dataclass(frozen=True)
class Source:
    """A named raw table: schema, description and the constraints its DDL states."""

    name: str
    schema: T.StructType
    description: str
    loaded_at: str | None = None
    not_null: tuple[str, ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()


SOURCES: dict[str, Source] = {
    s.name: s
    for s in (
        Source(
            "crypto_prices", CRYPTO_PRICES, "price snapshots, one row per symbol and poll",
            loaded_at="timestamp", not_null=("symbol", "price_usd"), max_length={"symbol": 10},
        ),
        Source(
            "weather_data", WEATHER_DATA, "city weather readings",
            loaded_at="timestamp", not_null=("city",),
            max_length={"city": 100, "weather_condition": 50},
        ),
        Source(
            "news_articles", NEWS_ARTICLES, "news items with an optional embedding",
            loaded_at="fetched_at", not_null=("title",), max_length={"source": 100}, unique=(("url",),),
        ),
        Source(
            "stock_prices", STOCK_PRICES, "daily closing prices",
            loaded_at="timestamp", not_null=("symbol", "trading_date"), max_length={"symbol": 10},
            unique=(("symbol", "trading_date"),),
        ),
        Source(
            "ai_insights", AI_INSIGHTS, "event log: daily_summary, price_anomaly, dq_failure",
            loaded_at="generated_at", not_null=("insight_type", "content"), max_length={"insight_type": 50},
        ),
        Source(
            "dq_metadata", DQ_METADATA, "one row per table: last load, rows, last check",
            loaded_at="last_check", not_null=("table_name",), max_length={"table_name": 50},
            unique=(("table_name",),),
        ),
    )
}
