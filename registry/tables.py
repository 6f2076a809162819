"""The domain tables derived from the test tables, in Spark and as SQL for the comparison.

Dirty values are put in by key so that every quality rule has rows to find. Titles are
the first line of a document and descriptions all the rest, so whole texts are used.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.times import epoch_micros
from quotemill.operators import alerts
from quotemill.operators.quality import run_checks
from quotemill.operators.quality.log import failure_log, failure_marks, failure_records

CLOCK = Clock(datetime(2024, 1, 31))
DQ_CLOCK = Clock(datetime(2024, 1, 25))

# Number ranges that keep the ids of the insight log unique across its sources.
LOG_RANGE = 10**12
LOG_OFFSETS = {"crypto_prices": 1, "weather_data": 2, "news_articles": 3, "price_anomaly": 4}

_PRICES = """
SELECT event_id AS id,
  CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH' WHEN 'signup' THEN 'SOL'
                  WHEN 'purchase' THEN 'XRP' ELSE 'ADA' END AS symbol,
  CAST(CASE WHEN event_id % 97 = 0 THEN -value ELSE value END AS DECIMAL(18,8)) AS price_usd,
  CAST(0 AS BIGINT) AS market_cap,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST({K} AS BIGINT) * 1000 END AS volume_24h,
  CAST(CASE WHEN event_id % 89 = 0 THEN 150 WHEN event_id % 83 = 0 THEN NULL
            ELSE (CAST({K} AS BIGINT) - 50) / CAST(8 AS DOUBLE) END AS DECIMAL(10,2)) AS price_change_24h,
  ts AS timestamp
FROM {events}
"""
_WEATHER = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Krakow' ELSE 'Warsaw' END AS city,
  CAST(CASE WHEN o_orderkey % 211 = 0 THEN -60 ELSE (o_orderkey % 70) - 15.5 END AS DECIMAL(5,2)) AS temperature,
  CAST((o_orderkey * 7) % 131 AS INT) AS humidity,
  CASE WHEN o_orderkey % 53 = 0 THEN ' ' WHEN o_orderstatus = 'F' THEN 'clear sky'
       WHEN o_orderstatus = 'O' THEN 'light rain' ELSE 'overcast' END AS weather_condition,
  {TIME} AS timestamp
FROM {orders}
"""
_NEWS = """
SELECT d.doc_id AS id,
  CASE WHEN d.doc_id % 19 = 0 THEN '' ELSE split_part(d.text, {NL}, 1) END AS title,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL
       ELSE substring(d.text, CAST(length(split_part(d.text, {NL}, 1)) + 2 AS INT), CAST(length(d.text) AS INT)) END AS description,
  CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE d.source END AS source,
  CASE WHEN d.doc_id % 13 = 0 THEN 'not-a-url'
       WHEN d.doc_id % 29 = 0 THEN NULL
       ELSE concat('https://example.org/', d.source, '/', CAST(d.doc_id % 400 AS VARCHAR(20))) END AS url,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE {TIME} END AS published_at,
  {FETCHED} AS fetched_at{VECTOR}
FROM {documents} d{JOIN}
"""
_STOCKS = """
SELECT CAST({ROWID} AS BIGINT) AS id, o_orderpriority AS symbol,
  CAST(max(o_totalprice) AS DECIMAL(10,2)) AS close_price,
  count(*) AS volume, CAST(o_orderdate AS DATE) AS trading_date
FROM {orders} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)
"""


def _spark_time(days: str, hours: str) -> str:
    return f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST({days} AS INT), CAST({hours} AS INT))"


def _duck_time(days: str, hours: str) -> str:
    return f"TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST({days} AS INT)) + to_hours(CAST({hours} AS BIGINT))"


def _fill(sql: str, **values: str) -> str:
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", value)
    return sql


class Tables:
    """Lazy domain tables over one test folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def prices(self) -> DataFrame:
        return prices_from(self.raw("events"))

    @cached_property
    def weather(self) -> DataFrame:
        sql = _fill(_WEATHER, TIME=_spark_time("o_orderkey % 30", "o_orderkey % 24"))
        return self.spark.sql(sql, orders=self.raw("orders"))

    @cached_property
    def news(self) -> DataFrame:
        return self._news("", "")

    @cached_property
    def news_with_vectors(self) -> DataFrame:
        return self._news(", e.embedding", " LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id")

    def _news(self, vector: str, join: str) -> DataFrame:
        sql = _fill(
            _NEWS, NL="'\\n'", TIME=_spark_time("d.doc_id % 30", "d.doc_id % 24"),
            FETCHED=_spark_time("d.doc_id % 30", "23"), VECTOR=vector, JOIN=join,
        )
        frames = {"documents": self.raw("documents")}
        if join:
            frames["embeddings"] = self.raw("embeddings")
        return self.spark.sql(sql, **frames)

    @cached_property
    def stocks(self) -> DataFrame:
        sql = _fill(_STOCKS, ROWID="min(o_orderkey)")
        return self.spark.sql(sql, orders=self.raw("orders"))

    def report(self, table: str) -> DataFrame:
        rows, key = {
            "crypto_prices": (self.prices, F.col("symbol")),
            "weather_data": (self.weather, F.col("city")),
            "news_articles": (self.news, F.left("title", F.lit(50))),
        }[table]
        return run_checks(rows, table, DQ_CLOCK, record_id=key)

    def logged(self, table: str, log: Callable = failure_log) -> DataFrame:
        """Failure log of a table, logged at the time of each record."""
        at = "fetched_at" if table == "news_articles" else "timestamp"
        row_id = F.lit(LOG_OFFSETS[table] * LOG_RANGE) + F.col("original_record.id")
        return log(self.report(table), F.col(at), row_id)

    @cached_property
    def failures(self) -> DataFrame:
        """Failure log of the three tables with JSON bodies."""
        return reduce(DataFrame.unionByName, [self.logged(t) for t in CHECKS])

    @cached_property
    def failure_records(self) -> DataFrame:
        """The same as typed records."""
        return reduce(DataFrame.unionByName, [self.logged(t, failure_records) for t in CHECKS])

    @cached_property
    def failure_marks(self) -> DataFrame:
        """The times of the failures, for the marts that count them."""
        return reduce(DataFrame.unionByName, [self.logged(t, failure_marks) for t in CHECKS])

    @cached_property
    def alert_rows(self) -> DataFrame:
        """Deduplicated anomalies of every 15-minute window, with their explanation."""
        strongest = alerts.strongest_per_symbol(alerts.anomaly_windows(self.prices), "window_start")
        return alerts.anomaly_facts(strongest).withColumnRenamed("facts", "explanation")

    @cached_property
    def alert_documents(self) -> DataFrame:
        return alerts.alert_documents(self.alert_rows, F.col("window_end"), "window_start", "window_end")

    @cached_property
    def insights(self) -> DataFrame:
        row_id = F.lit(LOG_OFFSETS["price_anomaly"] * LOG_RANGE) + F.floor(epoch_micros(F.col("window_end")) / 1_000_000)
        return self.failures.unionByName(alerts.alert_log(self.alert_documents, row_id))

    @cached_property
    def metadata(self) -> DataFrame:
        """Newest row and row count per table."""
        parts = [
            rows.agg(F.max(at).alias("last_successful_ts"), F.count("*").alias("rows_inserted")).select(
                F.lit(name).alias("table_name"), "last_successful_ts", "rows_inserted",
                F.col("last_successful_ts").alias("last_check"),
            )
            for name, rows, at in (
                ("crypto_prices", self.prices, "timestamp"),
                ("weather_data", self.weather, "timestamp"),
                ("news_articles", self.news, "fetched_at"),
            )
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])


def prices_from(events: DataFrame) -> DataFrame:
    """Price rows of an events frame, batch or streaming."""
    sql = _fill(_PRICES, K="get_json_object(props,'$.k')")
    return events.sparkSession.sql(sql, events=events)


# --- the same tables for the comparison ---------------------------------------------------

def _wrong(parts: list[tuple[str, str]]) -> str:
    """Failed check names of a row, comma separated, '' if all pass."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in parts) + ")"


CHECKS = {
    "crypto_prices": [
        ("NotNullCheck:symbol", "trim(symbol) <> ''"),
        ("RangeCheck:price_usd[0.0,None]", "price_usd > 0"),
        ("RangeCheck:volume_24h[0.0,None]", "volume_24h >= 0"),
        ("RangeCheck:price_change_24h[-100.0,100.0]", "price_change_24h BETWEEN -100 AND 100"),
        ("FutureTimestampCheck:timestamp", "timestamp IS NULL OR timestamp <= TIMESTAMP '2024-01-25 00:05:00'"),
    ],
    "weather_data": [
        ("NotNullCheck:city", "trim(city) <> ''"),
        ("RangeCheck:temperature[-50.0,50.0]", "temperature BETWEEN -50 AND 50"),
        ("RangeCheck:humidity[0.0,100.0]", "humidity BETWEEN 0 AND 100"),
        ("NotNullCheck:weather_condition", "trim(weather_condition) <> ''"),
    ],
    "news_articles": [
        ("NotNullCheck:title", r"regexp_replace(title, '^\s+|\s+$', '', 'g') <> ''"),
        ("NotNullCheck:source", "trim(source) <> ''"),
        ("UrlFormatCheck:url", r"regexp_matches(url, '^\s*https?://')"),
        ("NotNullCheck:published_at", "published_at IS NOT NULL"),
    ],
}

_TWO = "CAST(CAST(round({0}, 2) AS DECIMAL(20,2)) AS VARCHAR)"


def _two(expr: str) -> str:
    return _TWO.replace("{0}", expr)


_WINDOW_END = "time_bucket(INTERVAL 15 MINUTE, timestamp) + INTERVAL 15 MINUTE"

VIEWS = {
    "crypto_prices": _fill(_PRICES, K="json_extract_string(props,'$.k')", events="events"),
    "weather_data": _fill(_WEATHER, TIME=_duck_time("o_orderkey % 30", "o_orderkey % 24"), orders="orders"),
    "news_articles": _fill(
        _NEWS, NL="chr(10)", TIME=_duck_time("d.doc_id % 30", "d.doc_id % 24"),
        FETCHED=_duck_time("d.doc_id % 30", "23"), VECTOR=", e.embedding",
        JOIN=" LEFT JOIN embeddings e ON e.vec_id = d.doc_id", documents="documents",
    ),
    "stock_prices": _fill(_STOCKS, ROWID="min(o_orderkey)", orders="orders"),
    "price_checks": f"SELECT *, {_wrong(CHECKS['crypto_prices'])} AS failed FROM crypto_prices",
    "weather_checks": f"SELECT *, {_wrong(CHECKS['weather_data'])} AS failed, (humidity > 100) AS repaired FROM weather_data",
    "news_checks": f"SELECT *, {_wrong(CHECKS['news_articles'])} AS failed FROM news_articles",
    "failures": """
SELECT 1000000000000 + id AS id, 'crypto_prices' AS table_name, symbol AS record_id, failed, false AS repaired,
       timestamp AS generated_at FROM price_checks WHERE failed <> ''
UNION ALL
SELECT 2000000000000 + id, 'weather_data', city, failed, repaired, timestamp FROM weather_checks WHERE failed <> ''
UNION ALL
SELECT 3000000000000 + id, 'news_articles', left(title, 50), failed, false, fetched_at FROM news_checks WHERE failed <> ''
""",
    "anomaly_rows": f"""
SELECT *, row_number() OVER (PARTITION BY window_end, symbol ORDER BY abs(price_change_24h) DESC, timestamp, id) AS symbol_place
FROM (SELECT *, {_WINDOW_END} AS window_end,
             row_number() OVER (PARTITION BY {_WINDOW_END} ORDER BY abs(price_change_24h) DESC, timestamp, id) AS place
      FROM crypto_prices WHERE abs(price_change_24h) > 5)
""",
    "alert_rows": f"""
SELECT *, 'Kryptowaluta: ' || symbol || ', cena: $' || {_two('price_usd')} || ' USD, zmiana 24h: '
  || {_two('price_change_24h')} || '% (' || CASE WHEN price_change_24h > 0 THEN 'wzrost' ELSE 'spadek' END
  || ' o ' || {_two('abs(price_change_24h)')} || '%)' AS explanation
FROM anomaly_rows WHERE symbol_place = 1
""",
    "alerts": f"""
SELECT window_end, count(*) AS anomaly_count,
  string_agg(symbol, ',' ORDER BY place) AS symbols,
  '⚠️ *ANOMALIE CENOWE (' || count(*) || ')*' || chr(10) || chr(10)
  || string_agg(symbol || ': USD ' || {_two('price_usd')} || ' | change 24h: ' || {_two('price_change_24h')} || '%', chr(10) ORDER BY place)
  || chr(10) || chr(10) || '---' || chr(10) || '🤖 *WYJAŚNIENIA:*' || chr(10) || chr(10)
  || string_agg(line_no || '. ' || explanation, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS message
FROM (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY place) AS line_no FROM alert_rows WHERE price_usd <> 0)
GROUP BY window_end
""",
}

_USES = {
    "price_checks": ["crypto_prices"], "weather_checks": ["weather_data"], "news_checks": ["news_articles"],
    "failures": ["price_checks", "weather_checks", "news_checks"], "anomaly_rows": ["crypto_prices"],
    "alert_rows": ["anomaly_rows"], "alerts": ["alert_rows"],
}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for used in [*_needed(_USES.get(name, [])), name]:
            if used not in out:
                out.append(used)
    return out


def with_views(sql: str, *names: str, **extra: str) -> str:
    """The SQL with the named views (and what they use) as common table expressions."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(list(names))]
    parts += [f"{name} AS ({text.strip()})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)}\n{sql.strip()}" if parts else sql.strip()


def local_day(column: str) -> str:
    return f"CAST({column} AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Warsaw' AS DATE)"


def local_clock(column: str) -> str:
    return f"({column} AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Warsaw')"


def day_start(days: int) -> str:
    """Local midnight `days` before the local date of the clock, as UTC."""
    return f"((TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {days} DAY) AT TIME ZONE 'Europe/Warsaw' AT TIME ZONE 'UTC')"


def mean(total: str, count: str, scale: int, places: int) -> str:
    """Half-away-from-zero rounding of an exact mean in integers.

    `total` is a decimal with `scale` digits; the result is a DOUBLE with `places` digits.
    """
    units = f"CAST(CAST({total} AS DECIMAL(38,{scale})) * {10**scale} AS HUGEINT)"
    factor, power = (1, 10 ** (scale - places)) if scale >= places else (10 ** (places - scale), 1)
    top, bottom = f"(2 * abs({units}) * {factor} + {count} * {power})", f"(2 * {count} * {power})"
    whole = f"CAST({top} // {bottom} AS DOUBLE)"
    return f"(CASE WHEN {count} > 0 THEN sign(CAST({units} AS DOUBLE)) * {whole} / {10**places}.0 END)"


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = (), **extra: str):
    """Register `fn(Tables) -> DataFrame` under a name, with its SQL if it has one."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(fn(Tables(spark, folder)))
        if sql is not None:
            SQL[name] = with_views(sql, *views, **extra)
        return fn

    return wrap


def plain(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE and string lists as text, the types both engines print alike."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind == "array<string>":
            column = F.array_join(column, ",")
        out.append(column.alias(field.name))
    return df.select(*out)
