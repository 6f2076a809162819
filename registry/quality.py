"""Quality runs, failure log, quality views and reports, contracts."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators import contracts
from quotemill.operators.quality import ExpressionCheck, cleaned, run_checks, run_totals, summary_line
from quotemill.operators.quality.log import failures, failures_by_day
from quotemill.operators.quality import metrics
from quotemill.operators.quality.run import check_totals
from quotemill.plans import bundles, marts
from quotemill.functions.times import local_date
from quotemill.session import new_work_dir
from quotemill.sources import sinks
from quotemill.sources.schemas import SOURCES
from registry.marts import DAILY, DAILY_VIEWS, WEEKLY_SQL, change_sql, daily
from registry.tables import CHECKS, CLOCK, DQ_CLOCK, SQL, Tables, day_start, local_day, register

def _report(t: Tables, table: str) -> DataFrame:
    return t.report(table).select("id", "dq_passed", "failed_checks", "total_checks", "auto_repaired", "record_id")


@register(
    "dq_run_prices",
    "SELECT id, failed = '' AS dq_passed, failed AS failed_checks, 5 AS total_checks, false AS auto_repaired, "
    "symbol AS record_id FROM price_checks",
    ("price_checks",),
)
def dq_run_prices(t: Tables):
    return _report(t, "crypto_prices")


@register(
    "dq_run_weather",
    "SELECT id, failed = '' AS dq_passed, failed AS failed_checks, 4 AS total_checks, repaired AS auto_repaired, "
    "city AS record_id FROM weather_checks",
    ("weather_checks",),
)
def dq_run_weather(t: Tables):
    return _report(t, "weather_data")


@register(
    "dq_run_news",
    "SELECT id, failed = '' AS dq_passed, failed AS failed_checks, 4 AS total_checks, false AS auto_repaired, "
    "left(title, 50) AS record_id FROM news_checks",
    ("news_checks",),
)
def dq_run_news(t: Tables):
    return _report(t, "news_articles")


@register(
    "dq_cleaned_weather",
    "SELECT id, city, CAST(temperature AS DOUBLE) AS temperature, least(humidity, 100) AS humidity, weather_condition, "
    "timestamp FROM weather_data",
    ("weather_data",),
)
def dq_cleaned_weather(t: Tables):
    return cleaned(t.report("weather_data"))


@register(
    "dq_rerun_after_repair",
    "SELECT 'weather_data' AS dq_table, count(*) AS rows_kept, count(*) FILTER (WHERE failed <> '') AS dq_failures, "
    "CAST(0 AS BIGINT) AS auto_repaired FROM again",
    ("weather_data",),
    again="SELECT concat_ws(',', CASE WHEN temperature NOT BETWEEN -50 AND 50 THEN 't' END, "
          "CASE WHEN trim(weather_condition) = '' THEN 'w' END) AS failed FROM weather_data",
)
def dq_rerun_after_repair(t: Tables):
    return run_totals(run_checks(cleaned(t.report("weather_data")), "weather_data", DQ_CLOCK, F.col("city")))


@register(
    "dq_unknown_table",
    "SELECT 'orders' AS dq_table, count(*) AS rows_kept, CAST(0 AS BIGINT) AS dq_failures, CAST(0 AS BIGINT) AS auto_repaired FROM orders",
)
def dq_unknown_table(t: Tables):
    return run_totals(run_checks(t.raw("orders"), "orders", DQ_CLOCK))


@register(
    "dq_custom_rules",
    """
SELECT o_orderkey, concat_ws(',', CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'ExpressionCheck:large order' END,
  'ExpressionCheck:no such column[ERROR]', CASE WHEN o_orderkey % 3 = 0 THEN 'ExpressionCheck:ratio' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'ExpressionCheck:number' END) AS failed_checks, 4 AS total_checks FROM orders
""",
)
def dq_custom_rules(t: Tables):
    rules = {
        "orders": [
            ExpressionCheck("large order", "o_totalprice > 1000"),
            ExpressionCheck("no such column", "missing > 0"),
            ExpressionCheck("ratio", "abs(o_totalprice / (o_orderkey % 3)) >= 0"),
            ExpressionCheck("number", "CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE '1' END AS INT) = 1"),
        ]
    }
    return run_checks(t.raw("orders"), "orders", DQ_CLOCK, rules=rules).select("o_orderkey", "failed_checks", "total_checks")


_ALL_REPORTS = """
SELECT 'crypto_prices' AS dq_table, failed, false AS repaired FROM price_checks
UNION ALL SELECT 'weather_data', failed, repaired FROM weather_checks
UNION ALL SELECT 'news_articles', failed, false FROM news_checks
"""


@register(
    "dq_run_totals",
    "SELECT dq_table, count(*) AS rows_kept, count(*) FILTER (WHERE failed <> '') AS dq_failures, "
    "count(*) FILTER (WHERE repaired) AS auto_repaired FROM reports GROUP BY dq_table",
    ("failures",),
    reports=_ALL_REPORTS,
)
def dq_run_totals(t: Tables):
    return reduce(DataFrame.unionByName, [run_totals(t.report(name)) for name in CHECKS])


def _check_totals_sql() -> str:
    views = {"crypto_prices": "price_checks", "weather_data": "weather_checks", "news_articles": "news_checks"}
    parts = [
        f"SELECT '{table}' AS dq_table, '{name}' AS check_name, count(*) AS failures FROM {views[table]} "
        f"WHERE NOT coalesce({ok}, false) HAVING count(*) > 0"
        for table, checks in CHECKS.items()
        for name, ok in checks
    ]
    return " UNION ALL ".join(parts)


@register("dq_check_totals", _check_totals_sql(), ("failures",))
def dq_check_totals(t: Tables):
    return reduce(DataFrame.unionByName, [check_totals(t.report(name)) for name in CHECKS])


def _split(failed: str) -> str:
    """The check names of a row as a list; commas also occur inside range names."""
    return f"string_split(regexp_replace({failed}, ',(Not|Range|Url|Future)', '|\\1', 'g'), '|')"


def _lines_sql(table: str, view: str, record: str, total: int, repaired: str) -> str:
    return f"""
SELECT '{table}' AS table_name, id, CASE WHEN failed = '' THEN '✅ {table} [' || {record} || '] — wszystkie {total} checks OK'
  ELSE '⚠️  {table} [' || {record} || '] — FAILED: [''' || array_to_string({_split('failed')}, ''', ''') || '''] ('
       || CASE WHEN {repaired} THEN '🔧 naprawiono' ELSE '❌ nie naprawiono' END || ')' END AS line
FROM {view}"""


@register(
    "dq_summary_lines",
    " UNION ALL ".join(
        [
            _lines_sql("crypto_prices", "price_checks", "symbol", 5, "false"),
            _lines_sql("weather_data", "weather_checks", "city", 4, "repaired"),
            _lines_sql("news_articles", "news_checks", "coalesce(left(title, 50), 'None')", 4, "false"),
        ]
    ),
    ("failures",),
)
def dq_summary_lines(t: Tables):
    reports = [t.report(name) for name in CHECKS]
    lines = [r.select(F.col("dq_table").alias("table_name"), "id", summary_line(r).alias("line")) for r in reports]
    return reduce(DataFrame.unionByName, lines)


@register(
    "dq_failure_log",
    """
SELECT 2000000000000 + id AS id, 'dq_failure' AS insight_type, timestamp AS generated_at,
  '{"table":"weather_data","record_id":"' || city || '","failed_checks":["' || replace(replace(failed, ',N', '","N'), '],R', ']","R')
  || '"],"total_checks":4,"auto_repaired":' || CASE WHEN repaired THEN 'true' ELSE 'false' END
  || ',"checked_at":"2024-01-25 00:00:00","original_record":' || record || ',"fixed_record":'
  || CASE WHEN repaired THEN replace(record, '"humidity":' || humidity, '"humidity":100') ELSE 'null' END || '}' AS content
FROM (SELECT *, '{"id":' || id || ',"city":"' || city || '","temperature":' || CAST(temperature AS VARCHAR)
        || ',"humidity":' || humidity || ',"weather_condition":"' || weather_condition
        || '","timestamp":"' || CAST(timestamp AS VARCHAR) || '"}' AS record FROM weather_checks WHERE failed <> '')
""",
    ("weather_checks",),
)
def dq_failure_log(t: Tables):
    return t.logged("weather_data").select("id", "insight_type", "generated_at", "content")


@register(
    "dq_failure_bodies",
    """
SELECT 1000000000000 + id AS id, 'crypto_prices' AS table_name, symbol AS record_id, failed, 5 AS total_checks, 'false' AS auto_repaired,
  'null' AS fixed, id AS record, CAST(price_usd AS DOUBLE) AS price, volume_24h AS volume, CAST(timestamp AS VARCHAR) AS stamped, NULL AS text
FROM price_checks WHERE failed <> ''
UNION ALL
SELECT 3000000000000 + id, 'news_articles', left(title, 50), failed, 4, 'false', 'null', id, NULL, NULL, CAST(fetched_at AS VARCHAR), description
FROM news_checks WHERE failed <> ''
""",
    ("price_checks", "news_checks"),
)
def dq_failure_bodies(t: Tables):
    """The bodies of price and article failures, field by field."""
    def field(path: str):
        return F.get_json_object("content", f"$.{path}")

    rows = t.failures.filter(field("table").isin("crypto_prices", "news_articles"))
    return rows.select(
        "id",
        field("table").alias("table_name"),
        field("record_id").alias("record_id"),
        F.array_join(F.from_json(field("failed_checks"), "array<string>"), ",").alias("failed"),
        field("total_checks").cast("int").alias("total_checks"),
        field("auto_repaired").alias("auto_repaired"),
        F.coalesce(field("fixed_record"), F.lit("null")).alias("fixed"),
        field("original_record.id").cast("bigint").alias("record"),
        field("original_record.price_usd").cast("double").alias("price"),
        field("original_record.volume_24h").cast("bigint").alias("volume"),
        F.coalesce(field("original_record.timestamp"), field("original_record.fetched_at")).alias("stamped"),
        field("original_record.description").alias("text"),
    )


@register(
    "dq_failures_staged",
    f"SELECT id, {local_day('generated_at')} AS date, table_name, record_id, failed AS failed_checks, "
    "CASE WHEN repaired THEN 'true' ELSE 'false' END AS auto_repaired, generated_at FROM failures",
    ("failures",),
)
def dq_failures_staged(t: Tables):
    return failures_by_day(t.insights, CLOCK.zone)


@register(
    "dq_record_detail",
    """
SELECT f.id, table_name, record_id, failed AS failed_checks, coalesce(repaired, false) AS auto_repaired, generated_at,
  n.source AS source, w.humidity AS humidity, CAST(p.price_usd AS DOUBLE) AS price_usd
FROM failures f
LEFT JOIN news_articles n ON table_name = 'news_articles' AND n.id = f.id - 3000000000000
LEFT JOIN weather_data w ON table_name = 'weather_data' AND w.id = f.id - 2000000000000
LEFT JOIN crypto_prices p ON table_name = 'crypto_prices' AND p.id = f.id - 1000000000000
""",
    ("failures",),
)
def dq_record_detail(t: Tables):
    detail = failures(t.insights).withColumn("auto_repaired", F.col("auto_repaired").cast("boolean"))
    record = F.col("original_record")
    return detail.orderBy(F.desc("generated_at"), "id").select(
        "id", "table_name", "record_id", "failed_checks", "auto_repaired", "generated_at",
        F.get_json_object(record, "$.source").alias("source"),
        F.get_json_object(record, "$.humidity").cast("int").alias("humidity"),
        F.get_json_object(record, "$.price_usd").cast("double").alias("price_usd"),
    )


@register("dq_record_detail_stored", SQL["dq_record_detail"])
def dq_record_detail_stored(t: Tables):
    """The same from typed records, stored by day and read back by path."""
    path = new_work_dir(t.spark, "failure-records")
    sinks.write_batch(t.failure_records, path, 0, local_date("generated_at", CLOCK.zone))
    detail = failures(t.spark.read.parquet(path)).withColumn("auto_repaired", F.col("auto_repaired").cast("boolean"))
    part = lambda name, kind: F.try_variant_get("original_record", f"$.{name}", kind).alias(name)
    return detail.select(
        "id", "table_name", "record_id", "failed_checks", "auto_repaired", "generated_at",
        part("source", "string"), part("humidity", "int"), part("price_usd", "double"),
    )


TREND_SQL = f"""
SELECT {local_day('generated_at')} AS date, table_name, count(*) AS failures_count,
  count(*) FILTER (WHERE repaired) AS auto_repaired_count
FROM failures WHERE generated_at >= {day_start(30)} GROUP BY ALL
"""


@register("dq_trend", TREND_SQL, ("failures",))
def dq_trend(t: Tables):
    return marts.dq_trend(t.failure_records, CLOCK)


@register(
    "dq_summary",
    f"""
SELECT {local_day('generated_at')} AS date, table_name, {_split('failed')}[1] AS primary_failure_type,
  count(*) AS failure_count, count(*) FILTER (WHERE repaired) AS auto_repaired_count, max(generated_at) AS last_seen
FROM failures GROUP BY ALL
""",
    ("failures",),
)
def dq_summary(t: Tables):
    return marts.dq_summary(t.failure_records, CLOCK)


_RECENT = """
SELECT *, row_number() OVER (ORDER BY generated_at DESC, id) AS place FROM failures
WHERE generated_at >= TIMESTAMP '2024-01-30 00:00:00'
"""
_CAPPED = f"SELECT * FROM ({_RECENT}) WHERE place <= 100"
_RECENT_CHECKS = f"""
SELECT place, unnest({_split('failed')}) AS check_name, generate_subscripts({_split('failed')}, 1) AS pos FROM recent
"""


def _report_sql(anomalies: str) -> str:
    return f"""
SELECT 24 AS period_hours, (SELECT count(*) FROM recent) AS total_dq_events,
  (SELECT string_agg(table_name, ',' ORDER BY first_place)
   FROM (SELECT table_name, min(place) AS first_place FROM recent GROUP BY 1)) AS tables_with_issues,
  (SELECT check_name FROM checks GROUP BY 1 ORDER BY count(*) DESC, min(place * 100 + pos) LIMIT 1) AS most_common_failure,
  (SELECT {anomalies} FROM alerts WHERE window_end >= TIMESTAMP '2024-01-30 00:00:00') AS total_anomalies
"""


@register("dq_report_summary", _report_sql("count(*)"), ("failures", "alerts"), recent=_RECENT, checks=_RECENT_CHECKS)
def dq_report_summary(t: Tables):
    return bundles.dq_report(t.insights, CLOCK, 24)["summary"]


@register(
    "dq_report_summary_of_newest", _report_sql("least(count(*), 20)"), ("failures", "alerts"), recent=_CAPPED, checks=_RECENT_CHECKS
)
def dq_report_summary_of_newest(t: Tables):
    return bundles.dq_report(t.insights, CLOCK, 24, newest_failures=100, newest_anomalies=20)["summary"]


@register("dq_report_by_table", "SELECT table_name, count(*) AS failures FROM recent GROUP BY 1", ("failures",), recent=_RECENT)
def dq_report_by_table(t: Tables):
    return bundles.dq_report(t.insights, CLOCK, 24)["by_table"]


@register(
    "dq_report_recent_failures",
    "SELECT id, table_name, record_id, failed AS failed_checks, CASE WHEN repaired THEN 'true' ELSE 'false' END AS auto_repaired, "
    "generated_at FROM recent WHERE place <= 10",
    ("failures",),
    recent=_RECENT,
)
def dq_report_recent_failures(t: Tables):
    recent = bundles.dq_report(t.insights, CLOCK, 24)["recent_failures"]
    return recent.select("id", "table_name", "record_id", "failed_checks", "auto_repaired", "generated_at")


@register(
    "dq_report_recent_anomalies",
    """
SELECT message, '["' || replace(symbols, ',', '","') || '"]' AS symbols, window_end AS generated_at FROM alerts
WHERE window_end >= TIMESTAMP '2024-01-30 00:00:00' ORDER BY window_end DESC LIMIT 5
""",
    ("alerts",),
)
def dq_report_recent_anomalies(t: Tables):
    return bundles.dq_report(t.insights, CLOCK, 24)["recent_anomalies"].drop("id")


NEWEST_ISSUES = """
SELECT 'crypto_prices' AS table_name, symbol AS record_id, replace(failed, ',FutureTimestampCheck:timestamp', '') AS failed
FROM (SELECT * FROM price_checks ORDER BY timestamp DESC NULLS FIRST, id LIMIT 1)
UNION ALL
SELECT 'weather_data', city, failed FROM (SELECT * FROM weather_checks ORDER BY timestamp DESC NULLS FIRST, id LIMIT 1)
UNION ALL
SELECT 'news_articles', left(title, 50), failed FROM (SELECT * FROM news_checks ORDER BY published_at DESC NULLS FIRST, id LIMIT 1)
"""


ISSUES_SQL = (
    f"SELECT table_name, record_id, unnest({_split('failed')}) AS check_name FROM issues "
    "WHERE failed NOT IN ('', 'FutureTimestampCheck:timestamp')"
)


@register(
    "newest_row_issues",
    ISSUES_SQL,
    ("failures",),
    issues=NEWEST_ISSUES,
)
def newest_row_issues(t: Tables):
    return bundles.newest_row_issues(CLOCK, t.prices, t.weather, t.news).drop("at")


@register(
    "newest_row_issues_of_summary",
    f"SELECT table_name, record_id, unnest({_split('failed')}) AS check_name FROM issues WHERE failed <> '' AND table_name <> 'crypto_prices'",
    ("failures",),
    issues=NEWEST_ISSUES,
)
def newest_row_issues_of_summary(t: Tables):
    return bundles.newest_row_issues(CLOCK, readings=t.weather, news=t.news).drop("at")


@register(
    "newest_row_issues_of_symbol",
    f"""
SELECT 'crypto_prices' AS table_name, symbol AS record_id, unnest({_split('failed')}) AS check_name
FROM (SELECT symbol, replace(replace(failed, ',FutureTimestampCheck:timestamp', ''), 'FutureTimestampCheck:timestamp', '') AS failed
      FROM price_checks WHERE symbol = 'ETH' ORDER BY timestamp DESC, id LIMIT 1) WHERE failed <> ''
""",
    ("price_checks",),
)
def newest_row_issues_of_symbol(t: Tables):
    return bundles.newest_row_issues(CLOCK, prices=t.prices, symbol="eth").drop("at")


# --- contracts ---------------------------------------------------------------------------

def _tests_sql(table: str, view: str, tests: list[tuple[str, str]], unique: tuple[str, ...] = ()) -> str:
    parts = [
        f"SELECT '{table}' AS table_name, '{name}' AS test, count(*) FILTER (WHERE {bad}) AS failing_rows FROM {view}"
        for name, bad in tests
    ]
    parts += [
        f"SELECT '{table}', 'unique:{key}', count(*) FROM (SELECT 1 FROM {view} WHERE "
        + " AND ".join(f"{k} IS NOT NULL" for k in key.split(","))
        + f" GROUP BY {key} HAVING count(*) > 1)"
        for key in unique
    ]
    return " UNION ALL ".join(parts)


def _null(*names: str) -> list[tuple[str, str]]:
    return [(f"not_null:{n}", f"{n} IS NULL") for n in names]


def _long(**sizes: int) -> list[tuple[str, str]]:
    return [(f"max_length:{n}", f"length({n}) > {size}") for n, size in sizes.items()]


_TABLE_NAMES = "('crypto_prices', 'weather_data', 'news_articles')"
_STAGED_FAILURES = (
    f"SELECT *, {local_day('generated_at')} AS date, CASE WHEN repaired THEN 'true' ELSE 'false' END AS flag FROM failures"
)
_KNOWN_TABLE = ("accepted_values:table_name", f"table_name NOT IN {_TABLE_NAMES}")
_KNOWN_FLAG = ("accepted_values:auto_repaired", "flag NOT IN ('true', 'false')")


@register(
    "contracts_marts",
    " UNION ALL ".join(
        [
            _tests_sql("mart_market_daily", "daily", _null("date", "btc_avg_price", "news_count"), ("date",)),
            _tests_sql("mart_weekly_summary", "weekly", _null("week", "total_news"), ("week",)),
            _tests_sql("mart_news_correlation", "news_change", _null("date", "news_count"), ("date",)),
            _tests_sql("mart_weather_crypto_correlation", "weather_change", _null("date"), ("date",)),
            _tests_sql("mart_dq_failures", "staged", [*_null("date"), _KNOWN_TABLE, _KNOWN_FLAG]),
            _tests_sql("mart_dq_trend", "trend", [*_null("date"), _KNOWN_TABLE]),
        ]
    ),
    DAILY_VIEWS,
    **DAILY,
    weekly=WEEKLY_SQL,
    news_change=change_sql("news_count"),
    weather_change=change_sql("avg_temperature"),
    staged=_STAGED_FAILURES,
    trend=TREND_SQL,
)
def contracts_marts(t: Tables):
    path = new_work_dir(t.spark, "contracts")
    sinks.publish_mart(daily(t), path, 1)
    mart, insights = sinks.read_mart(t.spark, path), t.insights
    tables = {
        "mart_market_daily": mart,
        "mart_weekly_summary": marts.weekly_summary(mart, CLOCK),
        "mart_news_correlation": marts.news_correlation(mart, CLOCK),
        "mart_weather_crypto_correlation": marts.weather_correlation(mart, CLOCK),
        "mart_dq_failures": failures_by_day(insights, CLOCK.zone),
        "mart_dq_trend": marts.dq_trend(insights, CLOCK),
    }
    parts = [contracts.failing_rows(df, name, contracts.MART_CONTRACTS[name]) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


@register(
    "contracts_sources",
    " UNION ALL ".join(
        [
            _tests_sql("crypto_prices", "crypto_prices", [*_null("symbol", "price_usd"), *_long(symbol=10)]),
            _tests_sql("weather_data", "weather_data", [*_null("city"), *_long(city=100, weather_condition=50)]),
            _tests_sql("news_articles", "news_articles", [*_null("title"), *_long(source=100)], ("url",)),
            _tests_sql(
                "stock_prices", "stock_prices", [*_null("symbol", "trading_date"), *_long(symbol=10)], ("symbol,trading_date",)
            ),
            _tests_sql("ai_insights", "logged", [*_null("insight_type", "content"), *_long(insight_type=50)]),
            _tests_sql("dq_metadata", "metadata", [*_null("table_name"), *_long(table_name=50)], ("table_name",)),
        ]
    ),
    ("crypto_prices", "weather_data", "news_articles", "stock_prices", "failures", "alerts"),
    logged="SELECT 'dq_failure' AS insight_type, failed AS content FROM failures UNION ALL SELECT 'price_anomaly', message FROM alerts",
    metadata="SELECT table_name, count(*) AS n FROM failures GROUP BY 1",
)
def contracts_sources(t: Tables):
    tables = {
        "crypto_prices": t.prices, "weather_data": t.weather, "news_articles": t.news, "stock_prices": t.stocks,
        "ai_insights": t.insights, "dq_metadata": t.metadata,
    }
    parts = [contracts.failing_rows(df, name, contracts.source_contract(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


@register(
    "contract_violations",
    "SELECT id, symbol, 'max_length:symbol' AS broken FROM stock_prices WHERE length(symbol) > 10",
    ("stock_prices",),
)
def contract_violations(t: Tables):
    return contracts.violations(t.stocks, contracts.source_contract("stock_prices")).select("id", "symbol", "broken")


@register(
    "source_freshness",
    """
SELECT *, CASE WHEN age_minutes > 20 THEN 'error' WHEN age_minutes > 10 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max_loaded_at)) / 60000000.0 AS age_minutes FROM (
  SELECT 'crypto_prices' AS table_name, max(timestamp) AS max_loaded_at FROM crypto_prices
  UNION ALL SELECT 'weather_data', max(timestamp) FROM weather_data
  UNION ALL SELECT 'news_articles', max(fetched_at) FROM news_articles))
""",
    ("crypto_prices", "weather_data", "news_articles"),
)
def source_freshness(t: Tables):
    tables = {"crypto_prices": t.prices, "weather_data": t.weather, "news_articles": t.news}
    parts = [contracts.source_freshness(df, name, SOURCES[name].loaded_at, CLOCK) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


_METRICS = " UNION ALL ".join(
    [
        "SELECT '' AS column_name, count(*) AS rows, CAST(sum(CAST(failed <> '' AS INT)) AS BIGINT) AS failures, CAST(0 AS BIGINT) AS repaired, "
        "NULL AS present, NULL AS least, NULL AS greatest FROM days",
        "SELECT 'symbol', NULL, NULL, NULL, count(symbol), NULL, NULL FROM days",
        "SELECT 'price_usd', NULL, NULL, NULL, count(price_usd), min(CAST(price_usd AS DOUBLE)), max(CAST(price_usd AS DOUBLE)) FROM days",
    ]
)


@register(
    "dq_run_metrics",
    f"SELECT 'crypto_prices' AS table_name, m.*, d.distinct_values FROM ({_METRICS}) m LEFT JOIN "
    "(SELECT 'symbol' AS column_name, count(DISTINCT symbol) AS distinct_values FROM days) d USING (column_name)",
    ("price_checks",),
    days=f"SELECT * FROM price_checks WHERE {local_day('timestamp')} BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'",
)
def dq_run_metrics(t: Tables):
    """Stored per day for three batches, one replayed, and merged over eleven days.

    The sketch of few distinct values is exact; estimates of many are left out of the comparison.
    """
    path = new_work_dir(t.spark, "metrics")
    report = t.report("crypto_prices")
    for batch in (0, 1, 2, 1):
        part = report.where(F.col("id") % 3 == batch)
        measured = metrics.measure(part, {"symbol": None, "price_usd": "price_usd"}, local_date("timestamp", CLOCK.zone))
        metrics.store(measured, path, batch)
    merged = metrics.over(t.spark, path, date(2024, 1, 10), date(2024, 1, 20))
    few = F.when(F.col("column_name") == "symbol", F.col("distinct_values")).alias("distinct_values")
    return merged.select("table_name", "column_name", "rows", "failures", "repaired", "present", "least", "greatest", few)
