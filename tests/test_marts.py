"""Marts: equal to the naive join, window edges, plan shape."""

from datetime import datetime

import pytest

from quotemill.clock import Clock
from quotemill.plans import cards, marts
from quotemill.plans.bundles import articles_today
from registry.tables import CLOCK

PRICE = "id bigint, symbol string, price_usd decimal(18,8), price_change_24h decimal(10,2), timestamp timestamp_ntz"



@pytest.fixture(scope="module")
def tiny(spark):
    spark.sql(
        "CREATE OR REPLACE TEMP VIEW tiny_prices AS SELECT id, symbol, CAST(p AS DECIMAL(18,8)) AS price_usd, "
        "CAST(c AS DECIMAL(10,2)) AS price_change_24h, CAST(t AS TIMESTAMP_NTZ) AS timestamp FROM VALUES "
        "(1,'BTC',10,1.5,'2024-01-29 10:00:00'),(2,'BTC',11,-9,'2024-01-29 23:30:00'),(3,'ETH',5,NULL,'2024-01-30 01:00:00'),"
        "(4,'ETH',6,2,'2024-01-30 02:00:00'),(5,'BTC',12,0,'2024-01-30 03:00:00') t(id,symbol,p,c,t)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMP VIEW tiny_news AS SELECT id, 't' AS title, '' AS description, 's' AS source, 'u' AS url, "
        "CAST(t AS TIMESTAMP_NTZ) AS published_at FROM VALUES (1,'2024-01-30 09:00:00'),(2,'2024-01-29 23:10:00'),(3,NULL) t(id,t)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMP VIEW tiny_weather AS SELECT id, 'Warsaw' AS city, CAST(d AS DECIMAL(5,2)) AS temperature, 50 AS humidity, "
        "w AS weather_condition, CAST(t AS TIMESTAMP_NTZ) AS timestamp FROM VALUES (1,1.05,'rain','2024-01-30 08:00:00'),"
        "(2,2.00,'clear','2024-01-30 09:00:00'),(3,3.10,NULL,'2024-01-30 10:00:00'),(4,3.10,NULL,'2024-01-30 11:00:00') t(id,d,w,t)"
    )
    insights = spark.sql(
        "SELECT id, k AS insight_type, '{}' AS content, CAST(t AS TIMESTAMP_NTZ) AS generated_at FROM VALUES "
        "(1,'dq_failure','2024-01-30 08:00:00'),(2,'price_anomaly','2024-01-30 08:00:00') t(id,k,t)"
    )
    return spark.table("tiny_prices"), spark.table("tiny_news"), spark.table("tiny_weather"), insights


def test_pre_aggregated_mart_equals_naive_join(spark, tiny):
    prices, news, weather, insights = tiny
    got = {r["date"]: r for r in marts.market_daily_view(prices, news, weather, insights, CLOCK).collect()}
    insights.createOrReplaceTempView("tiny_insights")
    day = "to_date(convert_timezone('UTC','Europe/Warsaw',{}))"
    naive = spark.sql(
        f"""SELECT {day.format('cp.timestamp')} AS date, count(DISTINCT cp.symbol) AS active_coins,
        round(avg(CASE WHEN cp.symbol='BTC' THEN cp.price_usd END), 2) AS btc, round(avg(cp.price_change_24h), 4) AS chg,
        round(max(abs(cp.price_change_24h)), 4) AS top, count(DISTINCT na.id) AS news, round(avg(wd.temperature), 1) AS temp,
        mode(wd.weather_condition, true) AS weather, count(DISTINCT ai.id) AS failures
        FROM tiny_prices cp LEFT JOIN tiny_news na ON {day.format('na.published_at')} = {day.format('cp.timestamp')}
        LEFT JOIN tiny_weather wd ON {day.format('wd.timestamp')} = {day.format('cp.timestamp')}
        LEFT JOIN tiny_insights ai ON {day.format('ai.generated_at')} = {day.format('cp.timestamp')} AND ai.insight_type = 'dq_failure'
        GROUP BY 1"""
    ).collect()
    assert len(naive) == len(got) == 2
    for row in naive:
        mart = got[row["date"]]
        pairs = [
            ("active_coins", "active_coins"), ("btc", "btc_avg_price"), ("chg", "market_avg_change"), ("top", "max_abs_price_change"),
            ("news", "news_count"), ("temp", "warsaw_avg_temp"), ("weather", "dominant_weather"), ("failures", "dq_failures_count"),
        ]
        for old, new in pairs:
            assert row[old] == mart[new], (row["date"], new)


def test_mood_and_missing_right_sides(tiny):
    prices, news, weather, insights = tiny
    rows = {str(r["date"]): r for r in marts.market_daily_view(prices, news, weather, insights, CLOCK).collect()}
    first = rows["2024-01-29"]
    assert first["news_count"] == 0 and first["dq_failures_count"] == 0 and first["warsaw_avg_temp"] is None
    assert first["market_sentiment"] == "Bullish" and rows["2024-01-30"]["market_sentiment"] == "Bearish"
    assert rows["2024-01-30"]["dominant_weather"] == "clear"


def test_first_row_of_the_change_window_is_null(tables):
    daily = marts.market_daily(tables.prices, tables.news, tables.weather, tables.insights, CLOCK)
    rows = marts.news_correlation(daily, CLOCK, days=5).orderBy("date").collect()
    assert rows[0]["prev_btc_price"] is None and rows[0]["btc_daily_pct_change"] is None
    assert rows[1]["prev_btc_price"] == rows[0]["btc_avg_price"]


def test_zero_previous_price_gives_null_change(spark):
    daily = spark.sql(
        "SELECT CAST(d AS DATE) AS date, 1 AS news_count, CAST(p AS DECIMAL(20,2)) AS btc_avg_price "
        "FROM VALUES ('2024-01-20', 0), ('2024-01-21', 5), ('2024-01-23', 6) t(d, p)"
    )
    rows = marts.news_correlation(daily, CLOCK).orderBy("date").collect()
    assert [None if r["btc_daily_pct_change"] is None else float(r["btc_daily_pct_change"]) for r in rows] == [None, None, 20.0]


def test_today_is_the_local_date(spark):
    news = spark.sql("SELECT CAST(t AS TIMESTAMP_NTZ) AS published_at FROM VALUES ('2024-01-30 22:59:59'), ('2024-01-30 23:00:00'), ('2024-01-31 23:00:00') t(t)")
    assert articles_today(news, Clock(datetime(2024, 1, 31))).first()[0] == 1
    assert Clock(datetime(2024, 1, 30, 23, 30)).today.isoformat() == "2024-01-31"


def test_mart_joins_carry_one_row_per_date(tables):
    """Only pre-aggregated rows are exchanged: every exchange sits on top of a partial aggregate."""
    daily = marts.market_daily(tables.prices, tables.news, tables.weather, tables.insights, CLOCK)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for number, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "HashAggregate" in lines[number + 1] or "Project" in lines[number + 1]


def test_time_bounds_reach_the_scan(tables):
    plan = cards.btc_eth_by_day(tables.prices, CLOCK)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,2024-01-24T00:00)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_windows_reach_every_scan(spark, tables, tmp_path):
    """Stored tables: each input of a windowed mart is read from a lower time bound on."""
    from quotemill.sources.schemas import SOURCES

    stored = {}
    for name, rows in {
        "crypto_prices": tables.prices, "news_articles": tables.news, "weather_data": tables.weather, "ai_insights": tables.failures,
    }.items():
        rows.write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.schema(SOURCES[name].schema).parquet(f"{tmp_path}/{name}")
    inputs = list(stored.values())
    for mart in (
        marts.market_daily(*inputs, CLOCK, days=30),
        marts.weekly_summary(marts.market_daily(*inputs, CLOCK, days=90), CLOCK),
        marts.news_correlation(marts.market_daily(*inputs, CLOCK, days=30), CLOCK),
        marts.market_daily_view(*inputs, CLOCK),
    ):
        plan = mart._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        # A join nobody uses is dropped with its scan.
        assert len(scans) >= 2 and all("GreaterThanOrEqual(" in line for line in scans), plan
