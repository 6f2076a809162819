"""Feed parsers, write semantics, model replies."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.clock import instant
from quotemill.functions import weather
from quotemill.operators import replies
from quotemill.plans import marts
from quotemill.session import new_work_dir
from quotemill.sources import feeds, key_filters, sinks
from quotemill.sources.schemas import SOURCES
from registry.marts import DAILY, DAILY_VIEWS, daily
from registry.tables import CLOCK, SQL, Tables, local_day, register

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def batch_time():
    return instant(CLOCK.now)


SYMBOLS = {"click": "BTC", "view": "ETH", "signup": "SOL", "purchase": "XRP"}
TICKERS_PER_POLL, ITEMS_PER_POLL = 20, 12

def _with_unreadable(polls: DataFrame) -> DataFrame:
    """The polls, and after every tenth an error page, a broken answer and an empty one."""
    bad = polls.filter(F.col("poll") % 10 == 0).select(
        (-F.col("poll") - 1).alias("poll"),
        F.explode(F.array(*[F.lit(x) for x in UNREADABLE], F.lit(None).cast("string"))).alias("payload"),
    )
    return polls.select("poll", "payload").unionByName(bad)


UNREADABLE = ["<html><body>502 Bad Gateway</body></html>", '{"code":-1003,"msg":"Too many requests."}', "not even", ""]
# An own poll number per unreadable answer, counted as above.
_REJECTED = " UNION ALL ".join(
    [f"SELECT -poll - 1 AS poll, '{x}' AS payload FROM polls WHERE poll % 10 = 0" for x in UNREADABLE]
    + ["SELECT -poll - 1, NULL FROM polls WHERE poll % 10 = 0"]
)


# --- ticker feed: each poll is one JSON array text -----------------------------------------

_TICKERS = """
SELECT event_id, event_id // 20 AS poll,
  CAST(row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) - 1 AS INT) AS item_pos, CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH' WHEN 'signup' THEN 'SOL'
    WHEN 'purchase' THEN 'XRP' ELSE 'ADA' END AS symbol,
  CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '' WHEN event_id % 41 = 0 THEN 'n/a'
       WHEN event_id % 43 = 0 THEN '1e12' WHEN event_id % 47 = 0 THEN 'NaN' WHEN event_id % 53 = 0 THEN '-Infinity'
       ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS price,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events
"""


def ticker_polls(t: Tables) -> DataFrame:
    """(poll, polled_at, payload): the events as polls of twenty tickers, some of them faulty."""
    key = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    price = (
        F.when(key % 31 == 0, F.lit(None).cast("string")).when(key % 37 == 0, "").when(key % 41 == 0, "n/a")
        .when(key % 43 == 0, "1e12").when(key % 47 == 0, "NaN").when(key % 53 == 0, "-Infinity")
        .otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    )
    ticker = F.struct(
        "event_id",
        F.concat("symbol", F.lit("USDT")).alias("symbol"),
        price.alias("lastPrice"),
        F.concat(k, F.lit("000.75")).alias("quoteVolume"),
        F.concat(k, F.lit(".8554")).alias("priceChangePercent"),
    )
    named = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    events = t.raw("events").withColumn("symbol", F.coalesce(F.try_element_at(named, F.col("event_type")), F.lit("ADA")))
    polls = events.groupBy(F.floor(key / TICKERS_PER_POLL).alias("poll")).agg(
        F.max("ts").alias("polled_at"), F.array_sort(F.collect_list(ticker)).alias("tickers")
    )
    return polls.select("poll", "polled_at", F.to_json("tickers").alias("payload"))


def _ticker_sql(price: str, volume: str, where: str) -> str:
    return f"""
SELECT poll, item_pos, symbol, {price} AS price_usd, CAST(0 AS BIGINT) AS market_cap, {volume} AS volume_24h,
  k + 0.86 AS price_change_24h FROM tickers WHERE {where}
"""


_PRICE = "CASE WHEN price IS NULL OR price IN ('', 'n/a') THEN 0.0 ELSE CAST(price AS DOUBLE) END"
UNUSABLE = "('n/a', '1e12', 'NaN', '-Infinity')"
USABLE = f"(price IS NULL OR price NOT IN {UNUSABLE})"


_WORKFLOW_PRICE = "CASE WHEN price IS NULL OR price IN ('', 'n/a', 'NaN', '-Infinity') THEN 0.0 ELSE CAST(price AS DOUBLE) END"


def _plain_tickers(t: Tables, mode: str) -> feeds.Parsed:
    return feeds.normalise_tickers(feeds.tickers_from_payload(ticker_polls(t).drop("polled_at")), mode)


@register(
    "ticker_feed",
    _ticker_sql(_PRICE, "k * 1000", USABLE).replace("k + 0.86", "CAST(k + 0.86 AS DOUBLE)"),
    tickers=_TICKERS,
)
def ticker_feed(t: Tables):
    return _plain_tickers(t, "truncate").rows


@register(
    "ticker_feed_rejects",
    f"""SELECT poll, symbol || 'USDT' AS symbol, price AS "lastPrice", NULL AS payload FROM tickers WHERE NOT {USABLE}
    UNION ALL SELECT poll, NULL, NULL, payload FROM rejected""",
    tickers=_TICKERS,
    polls="SELECT DISTINCT poll FROM tickers",
    rejected=_REJECTED,
)
def ticker_feed_rejects(t: Tables):
    polls = _with_unreadable(ticker_polls(t))
    return feeds.normalise_tickers(feeds.tickers_from_payload(polls)).rejects.select("poll", "symbol", "lastPrice", "payload")


@register(
    "ticker_feed_workflow",
    # The workflow reads junk as 0, as it does NaN and infinity; only 1e12 is too large to store.
    _ticker_sql(_WORKFLOW_PRICE, "k * 1000 + 1", "price IS NULL OR price <> '1e12'").replace("k + 0.86", "CAST(k + 0.86 AS DOUBLE)"),
    tickers=_TICKERS,
)
def ticker_feed_workflow(t: Tables):
    return _plain_tickers(t, "round").rows


# --- news feed: each poll is one RSS text ----------------------------------------------------

def _xml(col) -> object:
    text = F.coalesce(col, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def news_polls(t: Tables) -> DataFrame:
    """(poll, payload): the articles as feeds of twelve items."""
    published = F.col("published_at").cast("timestamp")
    stamped = F.concat(F.date_format(published, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    iso = F.concat(F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    use_iso = F.col("id") % 7 == 0
    item = F.concat(
        F.lit("<item><title>"), _xml(F.col("title")), F.lit("</title><description>"), _xml(F.col("description")),
        F.lit("</description><link>"), _xml(F.col("url")), F.lit("</link>"),
        F.when(F.col("published_at").isNull(), "").when(use_iso, F.concat(F.lit("<isoDate>"), iso, F.lit("</isoDate>")))
        .otherwise(F.concat(F.lit("<pubDate>"), stamped, F.lit("</pubDate>"))),
        F.lit("</item>"),
    )
    polls = t.news.groupBy(F.floor(F.col("id") / ITEMS_PER_POLL).alias("poll")).agg(
        F.array_sort(F.collect_list(F.struct("id", item.alias("xml")))).alias("items")
    )
    body = F.array_join(F.transform("items", lambda i: i["xml"]), "")
    return polls.select("poll", F.concat(F.lit("<rss><channel>"), body, F.lit("</channel></rss>")).alias("payload"))


_NEWS_ITEMS = """
SELECT *, id // 12 AS poll, CAST(row_number() OVER (PARTITION BY id // 12 ORDER BY id) - 1 AS INT) AS item_pos FROM news_articles
"""


def _news_sql(title: str, source: str, published: str, description: str = "coalesce(description, '')", first: int = 10**9) -> str:
    return f"""
SELECT poll, item_pos, {title} AS title, {description} AS description, '{source}' AS source, url, {published} AS published_at,
  {AS_OF} AS fetched_at
FROM items WHERE item_pos < {first}
"""


@register(
    "news_feed",
    _news_sql("title", "BBC News", f"CASE WHEN published_at IS NULL OR id % 7 = 0 THEN {AS_OF} ELSE published_at END"),
    ("news_articles",),
    items=_NEWS_ITEMS,
)
def news_feed(t: Tables):
    return feeds.normalise_news(feeds.news_from_payload(news_polls(t)), batch_time(), CLOCK.zone)


@register(
    "news_feed_workflow",
    _news_sql("title", "BBC Business", f"coalesce(published_at, {AS_OF})"),
    ("news_articles",),
    items=_NEWS_ITEMS,
)
def news_feed_workflow(t: Tables):
    items = feeds.news_from_payload(news_polls(t))
    return feeds.normalise_news(items, batch_time(), CLOCK.zone, "workflow", "BBC Business")


@register(
    "news_feed_first_items",
    _news_sql("left(title, 500)", "BBC Business", f"coalesce(published_at, {AS_OF})", "left(coalesce(description, ''), 500)", 10),
    ("news_articles",),
    items=_NEWS_ITEMS,
)
def news_feed_first_items(t: Tables):
    """The first ten items of each poll with short texts, as the workflow stores them."""
    items = feeds.news_from_payload(news_polls(t), first=10)
    return feeds.normalise_news(items, batch_time(), CLOCK.zone, "workflow", "BBC Business", clip=500)


@register("news_feed_rejects", _REJECTED, ("news_articles",), polls="SELECT DISTINCT id // 12 AS poll FROM news_articles")
def news_feed_rejects(t: Tables):
    return feeds.unreadable_news(_with_unreadable(news_polls(t)))


# --- weather feed ----------------------------------------------------------------------------

_CODE = "CAST(o_orderkey % 101 AS INT)"


def weather_polls(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    now = F.struct(
        F.when(key % 43 != 0, (key % 70) - 15.5).alias("temperature_2m"),
        F.when(key % 47 != 0, (key % 101).cast("int")).alias("relative_humidity_2m"),
        F.when(key % 59 != 0, (key % 101).cast("int")).alias("weather_code"),
    )
    return t.raw("orders").select("o_orderkey", F.to_json(F.struct(now.alias("current"))).alias("payload"))


def _weather_sql(codes: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {code} THEN '{text}'" for code, text in codes.items())
    return f"""
SELECT o_orderkey, 'Warsaw' AS city, CASE WHEN o_orderkey % 43 = 0 THEN 0.0 ELSE CAST((o_orderkey % 70) - 15.5 AS DOUBLE) END AS temperature,
  CASE WHEN o_orderkey % 47 = 0 THEN 0 ELSE {_CODE} END AS humidity,
  CASE CASE WHEN o_orderkey % 59 = 0 THEN 0 ELSE {_CODE} END {cases} ELSE 'unknown' END AS weather_condition
FROM orders
"""


@register("weather_feed", _weather_sql(weather.SHORT_CODES))
def weather_feed(t: Tables):
    return feeds.normalise_weather(feeds.weather_from_payload(weather_polls(t))).rows


@register("weather_feed_rejects", _REJECTED, polls="SELECT o_orderkey AS poll FROM orders")
def weather_feed_rejects(t: Tables):
    polls = _with_unreadable(weather_polls(t).withColumnRenamed("o_orderkey", "poll"))
    return feeds.normalise_weather(feeds.weather_from_payload(polls)).rejects


@register("weather_feed_workflow", _weather_sql(weather.FULL_CODES))
def weather_feed_workflow(t: Tables):
    return feeds.normalise_weather(feeds.weather_from_payload(weather_polls(t)), codes=weather.FULL_CODES).rows


_CASES = " ".join(f"WHEN {code} THEN '{text}'" for code, text in weather.FULL_CODES.items())


@register("weather_decode", f"SELECT l_orderkey, l_linenumber, CASE CAST(l_quantity AS INT) {_CASES} ELSE 'unknown' END AS condition FROM lineitem")
def weather_decode(t: Tables):
    text = weather.condition_text(F.col("l_quantity"), weather.FULL_CODES)
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", text.alias("condition"))


# --- write semantics -------------------------------------------------------------------------

_HALF = "TIMESTAMP '2024-01-15 12:00:00'"
_KEPT = "row_number() OVER (PARTITION BY url ORDER BY fetched_at, id) = 1 OR url IS NULL"


@register(
    "insert_if_absent",
    f"""
SELECT id, url, fetched_at, title FROM incoming
WHERE (n = 1 OR url IS NULL) AND (url IS NULL OR url NOT IN (SELECT url FROM news_articles WHERE fetched_at < {_HALF} AND url IS NOT NULL))
""",
    ("news_articles",),
    incoming="SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at, id) AS n FROM news_articles",
)
def insert_if_absent(t: Tables):
    order = [F.col("fetched_at"), F.col("id")]
    stored = sinks.keep_first(t.news.filter(F.col("fetched_at") < instant(datetime(2024, 1, 15, 12))), ["url"], order)
    return sinks.insert_if_absent(stored, t.news, ["url"], order).select("id", "url", "fetched_at", "title")


@register("insert_if_absent_by_day", SQL["insert_if_absent"])
def insert_if_absent_by_day(t: Tables):
    """The same, reading only the stored days whose key filter knows a URL of the batch."""
    order, root = [F.col("fetched_at"), F.col("id")], new_work_dir(t.spark, "keyed")
    stored = sinks.keep_first(t.news.filter(F.col("fetched_at") < instant(datetime(2024, 1, 15, 12))), ["url"], order)
    day = F.to_date("fetched_at")
    sinks.write_batch(stored, f"{root}/news", 0, day)
    key_filters.write_filters(stored, f"{root}/keys", 0, ["url"], day)
    fresh = key_filters.insert_if_absent(t.spark.read.parquet(f"{root}/news"), f"{root}/keys", t.news, ["url"], order)
    return fresh.select("id", "url", "fetched_at", "title")


@register(
    "keep_first_by_url",
    "SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at, id) AS n FROM news_articles) WHERE n = 1 OR url IS NULL",
    ("news_articles",),
)
def keep_first_by_url(t: Tables):
    return sinks.keep_first(t.news, ["url"], [F.col("fetched_at"), F.col("id")]).select("id", "url")


@register(
    "keep_first_by_symbol_date",
    """
SELECT o_orderkey, o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS trading_date, o_totalprice AS close_price FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1
""",
)
def keep_first_by_symbol_date(t: Tables):
    rows = t.raw("orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("trading_date"),
        F.col("o_totalprice").alias("close_price"),
    )
    return sinks.keep_first(rows, ["symbol", "trading_date"], [F.col("o_orderkey")])


@register(
    "metadata_upsert",
    f"""
SELECT table_name, last_successful_ts, rows_inserted FROM (
  SELECT 'crypto_prices' AS table_name, max(timestamp) AS last_successful_ts, count(*) AS rows_inserted FROM crypto_prices
  UNION ALL SELECT 'weather_data', max(timestamp), count(*) FROM weather_data WHERE timestamp < {_HALF}
  UNION ALL SELECT 'news_articles', max(fetched_at), count(*) FROM news_articles WHERE fetched_at < {_HALF})
""",
    ("crypto_prices", "weather_data", "news_articles"),
)
def metadata_upsert(t: Tables):
    cut = instant(datetime(2024, 1, 15, 12))

    def state(rows: DataFrame, name: str, at: str) -> DataFrame:
        return rows.agg(F.max(at).alias("last_successful_ts"), F.count("*").alias("rows_inserted")).select(
            F.lit(name).alias("table_name"), "last_successful_ts", "rows_inserted", F.col("last_successful_ts").alias("last_check")
        )

    early = [
        state(df.filter(F.col(at) < cut), name, at)
        for df, name, at in (
            (t.prices, "crypto_prices", "timestamp"), (t.weather, "weather_data", "timestamp"), (t.news, "news_articles", "fetched_at")
        )
    ]
    stored = early[0].unionByName(early[1]).unionByName(early[2])
    changes = state(t.prices, "crypto_prices", "timestamp")
    return sinks.upsert_latest(stored, changes, "table_name", "last_check").drop("last_check")


@register(
    "retention",
    f"""
SELECT 'crypto_prices' AS table_name, count(*) AS kept, CAST(sum(id) AS BIGINT) AS ids, min(timestamp) AS oldest FROM crypto_prices WHERE timestamp >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY
UNION ALL SELECT 'news_articles', count(*), CAST(sum(id) AS BIGINT), min(fetched_at) FROM news_articles WHERE fetched_at >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 7 DAY
UNION ALL SELECT 'weather_data', count(*), CAST(sum(id) AS BIGINT), min(timestamp) FROM weather_data WHERE timestamp >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 14 DAY
""",
    ("crypto_prices", "weather_data", "news_articles"),
)
def retention(t: Tables):
    now = instant(datetime(2024, 2, 10))
    tables = {"crypto_prices": t.prices, "news_articles": t.news, "weather_data": t.weather}
    parts = []
    for name, (column, days) in sinks.RETENTION_DAYS.items():
        kept = sinks.retain(tables[name], column, days, now)
        totals = kept.agg(F.count("*").alias("kept"), F.sum("id").alias("ids"), F.min(column).alias("oldest"))
        parts.append(totals.select(F.lit(name).alias("table_name"), "kept", "ids", "oldest"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "write_defaults",
    f"SELECT symbol, count(*) AS row_count, count(*) AS distinct_ids, {AS_OF} AS first_stamp, {AS_OF} AS last_stamp FROM tickers "
    f"WHERE {USABLE} GROUP BY symbol",
    tickers=_TICKERS,
)
def write_defaults(t: Tables):
    rows = feeds.normalise_tickers(feeds.tickers_from_payload(ticker_polls(t).drop("polled_at"))).rows
    stamped = sinks.with_row_id(sinks.stamp(rows, batch_time()), "poll", "item_pos", "symbol")
    return stamped.groupBy("symbol").agg(
        F.count("*").alias("row_count"), F.countDistinct("id").alias("distinct_ids"),
        F.min("timestamp").alias("first_stamp"), F.max("timestamp").alias("last_stamp"),
    )


@register(
    "stored_snapshots",
    f"SELECT {local_day('timestamp')} AS date, symbol, count(*) AS row_count, CAST(sum(price_usd) AS DOUBLE) AS price_sum FROM crypto_prices GROUP BY ALL",
    ("crypto_prices",),
)
def stored_snapshots(t: Tables):
    path = new_work_dir(t.spark, "snapshots")
    sinks.append_snapshots(t.prices, path, 0, CLOCK.zone)
    stored = t.spark.read.parquet(path)
    return stored.groupBy("date", "symbol").agg(F.count("*").alias("row_count"), F.sum("price_usd").alias("price_sum"))


@register(
    "dropped_old_days",
    f"SELECT {local_day('timestamp')} AS date, count(*) AS row_count FROM crypto_prices WHERE {local_day('timestamp')} >= DATE '2024-01-11' GROUP BY 1",
    ("crypto_prices",),
)
def dropped_old_days(t: Tables):
    path = new_work_dir(t.spark, "retained")
    sinks.append_snapshots(t.prices, path, 0, CLOCK.zone)
    sinks.drop_old_days(t.spark, path, datetime(2024, 1, 11).date())
    return t.spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("row_count"))


@register("published_mart", "SELECT * FROM daily", DAILY_VIEWS, **DAILY)
def published_mart(t: Tables):
    path = new_work_dir(t.spark, "mart")
    sinks.publish_mart(marts.daily_crypto_stats(t.prices, CLOCK), path, 1)
    sinks.publish_mart(daily(t), path, 2)
    return sinks.read_mart(t.spark, path)


@register(
    "summary_insight",
    """
SELECT 'daily_summary' AS insight_type, '{"news_count":' || count(*) || ',"published":' || count(published_at) || '}' AS content,
  TIMESTAMP '2024-01-31 00:00:00' AS generated_at FROM news_articles
""",
    ("news_articles",),
)
def summary_insight(t: Tables):
    counts = t.news.agg(F.count("*").alias("news_count"), F.count("published_at").alias("published"))
    body = F.to_json(F.struct("news_count", "published"))
    return sinks.insight(counts, "daily_summary", body, batch_time()).select("insight_type", "content", "generated_at")


_SOURCES_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{SOURCES[name].description}' AS description, count(*) AS row_count FROM {name}"
    for name in ("crypto_prices", "weather_data", "news_articles", "stock_prices")
)


@register("source_row_counts", _SOURCES_SQL, ("crypto_prices", "weather_data", "news_articles", "stock_prices"))
def source_row_counts(t: Tables):
    tables = {"crypto_prices": t.prices, "weather_data": t.weather, "news_articles": t.news, "stock_prices": t.stocks}
    parts = [
        rows.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(SOURCES[name].description).alias("description"), "row_count"
        )
        for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# --- model replies ---------------------------------------------------------------------------

def model_replies(t: Tables) -> DataFrame:
    """The conversation turns as replies: fenced JSON, bare JSON, plain text."""
    body = F.to_json(
        F.struct(
            F.col("text").alias("summary"),
            F.array(F.col("role"), F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("insights"),
            F.array(F.lit("hold")).alias("recommendations"),
        )
    )
    kind = F.col("conv_id") % 3
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("  "), body, F.lit("\n")))
        .otherwise(F.col("text"))
    )
    return t.raw("conversations").select("conv_id", "turn", reply.alias("reply"))


_READABLE = "conv_id % 3 <> 2 AND NOT (conv_id % 3 = 0 AND contains(text, '```'))"
_NONE = replies.NO_SUMMARY
_PARSED = f"""
SELECT conv_id, turn, {_READABLE} AS readable, CASE WHEN {_READABLE} THEN text ELSE '{_NONE}' END AS summary,
  CASE WHEN {_READABLE} THEN role || ',turn ' || turn ELSE '' END AS insights,
  CASE WHEN {_READABLE} THEN 'hold' ELSE '' END AS recommendations, role FROM conversations
"""


@register("model_replies", "SELECT * EXCLUDE (role) FROM parsed", parsed=_PARSED)
def parsed_replies(t: Tables):
    return replies.parse_replies(model_replies(t)).drop("reply")


@register(
    "summary_messages",
    """
SELECT conv_id, turn, '📊 *PODSUMOWANIE GODZINOWE* 📊' || chr(10) || chr(10) || '*' || CASE WHEN summary = '' THEN 'Brak podsumowania' ELSE summary END
  || '*' || chr(10) || chr(10) || '🔍 *Najważniejsze spostrzeżenia:*' || chr(10)
  || CASE WHEN readable THEN '1. ' || role || chr(10) || '2. turn ' || turn || chr(10) ELSE '' END
  || chr(10) || '💡 *Rekomendacje:*' || chr(10) || CASE WHEN readable THEN '1. hold' || chr(10) ELSE '' END
  || chr(10) || '⏱️ *Wygenerowano:* 2024-01-31 00:00:00' AS message
FROM parsed
""",
    parsed=_PARSED,
)
def summary_messages(t: Tables):
    messages = replies.summary_message(replies.parse_replies(model_replies(t)), batch_time())
    return messages.select("conv_id", "turn", "message")
