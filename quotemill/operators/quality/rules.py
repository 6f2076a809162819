"""Rule lists per table. Add a table by adding a key."""

from __future__ import annotations

from quotemill.operators.quality.checks import (
    Check,
    FutureTimestampCheck,
    NotNullCheck,
    RangeCheck,
    UrlFormatCheck,
)

# The checks and bounds of each table, in the order they run.
RULES: dict[str, list[Check]] = {
    "crypto_prices": [
        NotNullCheck("symbol"),
        RangeCheck("price_usd", min_val=0.0, exclusive_min=True),
        RangeCheck("volume_24h", min_val=0.0),
        RangeCheck("price_change_24h", min_val=-100.0, max_val=100.0),
        FutureTimestampCheck("timestamp", max_future_minutes=5),
    ],
    "weather_data": [
        NotNullCheck("city"),
        RangeCheck("temperature", min_val=-50.0, max_val=50.0),
        RangeCheck("humidity", min_val=0.0, max_val=100.0),
        NotNullCheck("weather_condition"),
    ],
    "news_articles": [
        NotNullCheck("title"),
        NotNullCheck("source"),
        UrlFormatCheck("url"),
        NotNullCheck("published_at"),
    ],
}
