"""Feed parsers: ticker JSON, news XML and weather JSON to typed rows.

Each feed can be read from landed files or from a payload column, and each has the two
normalisations of the platform: the service and the workflow variant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import numbers, times, weather

# Coins requested by the service (20) and by the workflow (10).
SERVICE_SYMBOLS = (
    "BTC ETH BNB SOL XRP ADA DOGE AVAX TRX DOT LINK MATIC LTC UNI ATOM NEAR XLM ETC FIL APT".split()
)
WORKFLOW_SYMBOLS = "BTC ETH BNB SOL XRP ADA DOGE AVAX TRX DOT".split()

TICKER_SCHEMA = "symbol STRING, lastPrice STRING, quoteVolume STRING, priceChangePercent STRING"
NEWS_ITEM_SCHEMA = (
    "title STRING, description STRING, content STRING, summary STRING, link STRING, "
    "pubDate STRING, isoDate STRING"
)
RSS_SCHEMA = f"channel STRUCT<item: ARRAY<STRUCT<{NEWS_ITEM_SCHEMA.replace(' STRING', ': STRING')}>>>"
WEATHER_SCHEMA = "current STRUCT<temperature_2m: DOUBLE, relative_humidity_2m: DOUBLE, weather_code: INT>"
# Doubles from here on are whole numbers, adding a half changes nothing.
WHOLE_DOUBLES = float(2**52)
XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


# --- tickers ---------------------------------------------------------------------------

def read_ticker_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed polls, each file one JSON array of 24h tickers; an unreadable file is its `payload`."""
    reader = spark.read.schema(f"{TICKER_SCHEMA}, payload STRING").option("columnNameOfCorruptRecord", "payload")
    return reader.option("multiLine", True).json(path)


def tickers_from_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per ticker of a JSON array column, with its place in the list; other columns stay.

    A payload that is no list of tickers (an error page, an error object, nothing at all) becomes
    one row without a ticker that carries the `payload`, so it ends up among the rejects.
    """
    kind = f"ARRAY<STRUCT<{TICKER_SCHEMA.replace(' STRING', ': STRING')}>>"
    keep = [c for c in df.columns if c != payload]
    parsed = df.withColumn("_items", F.from_json(F.col(payload), kind))
    no_list = F.col("_items").isNull() | (
        (F.size("_items") > 0) & ~F.exists("_items", lambda item: item["symbol"].isNotNull())
    )
    nothing = F.array(F.lit(None).cast(kind[6:-1]))
    items = parsed.select(
        *keep,
        F.when(no_list, F.col(payload)).alias("payload"),
        F.posexplode(F.when(no_list, nothing).otherwise(F.col("_items"))).alias("item_pos", "_item"),
    )
    return items.select(*keep, "payload", "item_pos", "_item.*")


def _number(text: Column, tolerant: bool) -> Column:
    """0 for absent or empty text; the workflow variant reads a leading number and gives 0 for junk."""
    if tolerant:
        return F.coalesce(numbers.leading_number(text), F.lit(0.0))
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).otherwise(text.try_cast("double"))


@dataclass(frozen=True)
class Parsed:
    """Typed rows plus the raw rows that could not be read."""

    rows: DataFrame
    rejects: DataFrame


def normalise_tickers(raw: DataFrame, volume_mode: str = "truncate") -> Parsed:
    """Price rows from tickers.

    `truncate` (service) cuts the volume to an integer and rejects text that is no number;
    `round` (workflow) rounds half up and reads junk as 0. NaN, infinity and numbers beyond the
    column types are rejected in both.
    """
    if volume_mode not in ("truncate", "round"):
        raise ValueError("volume_mode is 'truncate' or 'round'")
    tolerant = volume_mode == "round"
    read = raw.withColumns(
        {
            "_price": _number(F.col("lastPrice"), tolerant),
            "_volume": _number(F.col("quoteVolume"), tolerant),
            "_change": _number(F.col("priceChangePercent"), tolerant),
        }
    )
    volume = F.col("_volume")
    if tolerant:
        volume = F.when(F.abs(volume) < WHOLE_DOUBLES, F.floor(volume + 0.5)).otherwise(volume.try_cast("bigint"))
    typed = read.withColumns(
        {
            "_price": F.col("_price").try_cast("decimal(18,8)"),
            "_volume": volume.try_cast("bigint"),
            "_change": F.col("_change").try_cast("decimal(18,4)").try_cast("decimal(10,2)"),
        }
    )
    readable = (
        F.col("symbol").isNotNull()
        & F.col("_price").isNotNull()
        & F.col("_volume").isNotNull()
        & F.col("_change").isNotNull()
    )
    extra = [c for c in raw.columns if c not in ("symbol", "lastPrice", "quoteVolume", "priceChangePercent", "payload")]
    rows = typed.filter(readable).select(
        *extra,
        F.replace(F.col("symbol"), F.lit("USDT"), F.lit("")).alias("symbol"),
        F.col("_price").alias("price_usd"),
        F.lit(0).cast("bigint").alias("market_cap"),
        F.col("_volume").alias("volume_24h"),
        F.col("_change").alias("price_change_24h"),
    )
    return Parsed(rows, typed.filter(~readable).select(*raw.columns))


# --- news ------------------------------------------------------------------------------

def read_news_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed RSS files, one row per item."""
    reader = spark.read.format("xml").option("rowTag", "item").schema(NEWS_ITEM_SCHEMA)
    return reader.options(**XML_OPTIONS).load(path)


def _feed(payload: str) -> Column:
    return F.from_xml(F.col(payload), RSS_SCHEMA, XML_OPTIONS)


def unreadable_news(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The polls that hold no feed: error pages, broken XML, nothing at all."""
    return df.filter(F.col(payload).isNull() | _feed(payload)["channel"].isNull())


def news_from_payload(df: DataFrame, payload: str = "payload", first: int | None = None) -> DataFrame:
    """Items of an RSS text column; with `first` only so many of each poll, as the pollers keep them."""
    parsed = _feed(payload)
    keep = [c for c in df.columns if c != payload]
    items = df.select(*keep, F.posexplode(parsed["channel"]["item"]).alias("item_pos", "item"))
    if first is not None:
        items = items.filter(F.col("item_pos") < first)
    return items.select(*keep, "item_pos", "item.*")


def normalise_news(
    items: DataFrame,
    batch_time: Column,
    zone: str,
    variant: str = "service",
    source: str = "BBC News",
    clip: int | None = None,
) -> DataFrame:
    """News rows; `clip` cuts descriptions (and workflow titles) to a length. A blank link is NULL."""
    blank = F.lit("")

    def first_filled(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), blank) for n in names], blank)

    def clipped(col: Column, size: int | None) -> Column:
        return col if size is None else F.left(col, F.lit(size))

    url = F.nullif(F.col("link"), blank)
    if variant == "service":
        title = first_filled("title")
        description = clipped(first_filled("description"), clip)
        when = F.col("pubDate")
    elif variant == "workflow":
        title = clipped(first_filled("title"), clip)
        description = clipped(first_filled("content", "summary", "description"), clip)
        when = F.coalesce(F.nullif(F.col("pubDate"), blank), F.nullif(F.col("isoDate"), blank))
    else:
        raise ValueError("variant is 'service' or 'workflow'")
    names = [f.split()[0] for f in NEWS_ITEM_SCHEMA.split(", ")]
    extra = [c for c in items.columns if c not in names]
    published = F.when(when.isNull(), batch_time).otherwise(times.parse_feed_time(when, zone))
    return items.select(
        *extra,
        title.alias("title"),
        description.alias("description"),
        F.lit(source).alias("source"),
        url.alias("url"),
        published.alias("published_at"),
        batch_time.alias("fetched_at"),
    )


# --- weather ---------------------------------------------------------------------------

def read_weather_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses; an unreadable file is its `payload`."""
    reader = spark.read.schema(f"{WEATHER_SCHEMA}, payload STRING").option("columnNameOfCorruptRecord", "payload")
    return reader.option("multiLine", True).json(path)


def weather_from_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The `current` block of each response; the payload stays for the rejects."""
    keep = [c for c in df.columns if c != payload]
    return df.select(*keep, F.col(payload).alias("payload"), F.from_json(F.col(payload), WEATHER_SCHEMA)["current"].alias("current"))


def normalise_weather(raw: DataFrame, city: str = "Warsaw", codes: dict[int, str] = weather.SHORT_CODES) -> Parsed:
    """Weather rows; values absent from a response become 0, as in both pollers.

    A response without a `current` block, or with a number beyond the column types, is rejected.
    """
    now = F.col("current")
    typed = raw.withColumns(
        {
            "_degrees": F.coalesce(now["temperature_2m"], F.lit(0.0)).try_cast("decimal(5,2)"),
            "_humidity": F.round(F.coalesce(now["relative_humidity_2m"], F.lit(0.0))).try_cast("int"),
        }
    )
    readable = now.isNotNull() & F.col("_degrees").isNotNull() & F.col("_humidity").isNotNull()
    extra = [c for c in raw.columns if c not in ("current", "payload")]
    rows = typed.filter(readable).select(
        *extra,
        F.lit(city).alias("city"),
        F.col("_degrees").alias("temperature"),
        F.col("_humidity").alias("humidity"),
        weather.condition_text(F.coalesce(now["weather_code"], F.lit(0)), codes).alias("weather_condition"),
    )
    return Parsed(rows, typed.filter(~readable).select(*[c for c in raw.columns if c != "current"]))
