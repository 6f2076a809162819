"""Latest rows, alert rules, contracts, quality report."""

from datetime import datetime

from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.operators import alerts, contracts, latest, replies, trend
from quotemill.plans import bundles
from registry.tables import CLOCK

CLOCK_NOON = Clock(datetime(2024, 1, 30, 12))


def prices(spark, values):
    return spark.sql(
        "SELECT CAST(id AS BIGINT) AS id, symbol, CAST(p AS DECIMAL(18,8)) AS price_usd, CAST(0 AS BIGINT) AS market_cap, "
        "CAST(v AS BIGINT) AS volume_24h, CAST(c AS DECIMAL(10,2)) AS price_change_24h, CAST(t AS TIMESTAMP_NTZ) AS timestamp "
        f"FROM VALUES {values} t(id, symbol, p, v, c, t)"
    )


def test_a_row_can_qualify_through_another_symbol(spark):
    df = prices(
        spark,
        "(1,'BTC',1,1,1,'2024-01-30 10:00:00'),(2,'BTC',2,1,1,'2024-01-30 11:00:00'),(3,'ETH',3,1,1,'2024-01-30 10:00:00'),"
        "(4,'ETH',3,1,1,'2024-01-30 09:00:00')",
    )
    assert sorted(r["id"] for r in latest.latest_prices(df).collect()) == [1, 2, 3]


def test_missing_change_counts_as_zero_and_empty_is_neutral(spark):
    df = prices(spark, "(1,'BTC',1,1,2.5,'2024-01-30 10:00:00'),(2,'ETH',2,1,NULL,'2024-01-30 10:00:00')")
    assert latest.market_sentiment(df).first()[0] == "Bullish"
    four = prices(spark, "(1,'A',1,1,2.5,'2024-01-30 10:00:00'),(2,'B',2,1,NULL,'2024-01-30 10:00:00'),(3,'C',2,1,NULL,'2024-01-30 10:00:00')")
    assert latest.market_sentiment(four).first()[0] == "Neutral"
    assert latest.market_sentiment(df.filter("false")).first()[0] == "Neutral"


def test_sector_label_without_rows(spark, tables):
    assert latest.sector_label(tables.stocks.filter("false")).first()[0] == "Market Stable"


def test_series_direction(spark):
    df = prices(
        spark, "(1,'A',1,1,1,'2024-01-30 10:00:00'),(2,'B',5,1,1,'2024-01-30 10:00:00'),(3,'B',4,1,1,'2024-01-30 11:00:00'),"
        "(4,'C',4,1,1,'2024-01-30 10:00:00'),(5,'C',4,1,1,'2024-01-30 11:00:00')",
    )
    got = {r["symbol"]: r["direction"] for r in latest.series_direction(df).collect()}
    assert got == {"A": "neutral", "B": "down", "C": "up"}


def test_threshold_is_strict_and_ties_keep_the_first(spark):
    df = prices(
        spark, "(1,'A',1,1,5,'2024-01-30 11:50:00'),(2,'B',1,1,-7,'2024-01-30 11:50:00'),(3,'B',1,1,7,'2024-01-30 11:55:00'),"
        "(4,'C',1,1,6,'2024-01-30 11:44:59'),(5,'C',1,1,6,'2024-01-30 11:45:00')",
    )
    recent = alerts.recent_anomalies(df, CLOCK_NOON)
    assert sorted(r["id"] for r in recent.collect()) == [2, 3, 5]
    assert sorted(r["id"] for r in alerts.strongest_per_symbol(recent).collect()) == [2, 5]


def test_duplicates_take_places_before_dedup(spark):
    df = prices(spark, ",".join(f"({i},'A',1,1,{50 - i},'2024-01-30 11:50:00')" for i in range(10)) + ",(99,'B',1,1,6,'2024-01-30 11:51:00')")
    assert [r["symbol"] for r in alerts.strongest_per_symbol(alerts.recent_anomalies(df, CLOCK_NOON)).collect()] == ["A"]


def test_no_symbol_is_lost_in_a_crowded_window(spark):
    """Twelve hits of A and one each of twenty other symbols within one window."""
    rows = [f"({i},'A',1,1,{50 - i},'2024-01-30 11:50:00')" for i in range(12)]
    rows += [f"({100 + i},'S{i}',1,1,6,'2024-01-30 11:51:00')" for i in range(20)]
    kept = alerts.strongest_per_symbol(alerts.anomaly_windows(prices(spark, ",".join(rows))), "window_start").collect()
    assert sorted(r["id"] for r in kept) == [0, *range(100, 120)]


def test_latest_prices_scans_twice(spark, tables):
    plan = latest.latest_prices(tables.prices)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") <= 1 and plan.count("FileScan") <= 2 and "GreaterThanOrEqual(ts" in plan
    assert latest.latest_prices(tables.prices.filter("false")).count() == 0


def test_window_limit_runs_before_the_shuffle(tables):
    windows = alerts.anomaly_windows(tables.prices)
    plan = alerts.strongest_per_symbol(windows, "window_start")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_alert_document(spark):
    rows = prices(spark, "(1,'BTC',100.555,1,7.5,'2024-01-30 11:50:00'),(2,'ETH',2,1,-9,'2024-01-30 11:51:00'),(3,'',2,1,-9,'2024-01-30 11:51:00')")
    notes = spark.createDataFrame([("BTC", "why")], "symbol string, explanation string")
    doc = alerts.alert_documents(alerts.with_explanations(rows, notes), CLOCK_NOON.now_column()).first()
    assert doc["affected_symbols"] == ["ETH", "BTC"] and doc["anomaly_count"] == 2
    assert doc["message"] == (
        "⚠️ *ANOMALIE CENOWE (2)*\n\nETH: USD 2.00 | change 24h: -9.00%\nBTC: USD 100.56 | change 24h: 7.50%"
        "\n\n---\n🤖 *WYJAŚNIENIA:*\n\n1. why"
    )
    assert alerts.alert_documents(alerts.with_explanations(rows.filter("false"), notes), CLOCK_NOON.now_column()).count() == 0


def test_freshness_levels(spark):
    for minutes, status in ((5, "pass"), (10, "pass"), (15, "warn"), (20, "warn"), (25, "error")):
        df = prices(spark, f"(1,'A',1,1,1,'2024-01-30 11:{60 - minutes:02d}:00')")
        assert contracts.source_freshness(df, "x", "timestamp", CLOCK_NOON).first()["status"] == status
    assert contracts.source_freshness(df.filter("false"), "x", "timestamp", CLOCK_NOON).first()["status"] == "error"


def test_contract_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "bad"), (None, None)], "k int, v string")
    contract = contracts.Contract(unique=(("k",),), not_null=("k",), accepted={"v": ("a", "b")}, max_length={"v": 2})
    got = {r["test"]: r["failing_rows"] for r in contracts.failing_rows(df, "t", contract).collect()}
    assert got == {"unique:k": 1, "not_null:k": 2, "accepted_values:v": 1, "max_length:v": 1}
    assert contracts.violations(df, contract).count() == 2


def test_report_on_an_empty_log(tables):
    report = bundles.dq_report(tables.insights.filter("false"), CLOCK)
    row = report["summary"].first()
    assert row["total_dq_events"] == 0 and row["most_common_failure"] is None and row["total_anomalies"] == 0
    assert report["by_table"].count() == 0


def test_report_counts_the_whole_window(spark, tables):
    body = F.to_json(F.struct(F.lit("crypto_prices").alias("table"), F.array(F.lit("A")).alias("failed_checks")))
    log = spark.range(350).select(
        "id", F.lit("dq_failure").alias("insight_type"), body.alias("content"), F.lit(None).cast("string").alias("data_snapshot"),
        F.lit("2024-01-30 12:00:00").cast("timestamp_ntz").alias("generated_at"),
    )
    assert bundles.dq_report(log, CLOCK)["summary"].first()["total_dq_events"] == 350
    assert bundles.dq_report(log, CLOCK, newest_failures=100)["summary"].first()["total_dq_events"] == 100


def test_equal_times_are_ordered_by_id(spark):
    df = prices(spark, "(9,'A',1,1,1,'2024-01-30 10:00:00'),(3,'A',7,1,1,'2024-01-30 10:00:00'),(5,'A',4,1,1,'2024-01-30 11:00:00'),(8,'A',2,1,1,'2024-01-30 11:00:00')")
    facts = trend.trend_facts(df, CLOCK_NOON).first()
    assert (facts["first_value"], facts["last_value"]) == (7.0, 2.0)
    assert latest.series_direction(df).first()["direction"] == "down"


def test_trend_of_short_and_flat_series(spark):
    df = prices(spark, "(1,'A',1,1,1,'2024-01-30 10:00:00'),(2,'B',5,1,1,'2024-01-30 10:00:00'),(3,'B',5,1,1,'2024-01-30 11:00:00')")
    got = {r["symbol"]: (r["trend"], r["pct_change"]) for r in trend.trend_facts(df, CLOCK_NOON).collect()}
    assert got == {"A": (trend.TOO_SHORT, None), "B": ("stable", 0.0)}


def test_spikes_are_counted(spark):
    rows = ",".join(f"({i},'A',{100 if i == 30 else 10},1,1,'2024-01-30 {i % 12:02d}:{i:02d}:00')" for i in range(50))
    assert trend.trend_facts(prices(spark, rows), CLOCK_NOON).first()["spikes"] == 1


def test_replies(spark):
    good = '{"summary":"s","insights":["a","b"],"recommendations":[]}'
    texts = [f"```json\n{good}\n```", f"```\n{good}```", f"  {good} ", "no json", '["list"]', '"text"', None, "", '{"summary":']
    rows = replies.parse_replies(spark.createDataFrame([(t,) for t in texts], "reply string")).collect()
    assert [r["readable"] for r in rows] == [True, True, True] + [False] * 6
    assert rows[0]["insights"] == ["a", "b"] and rows[0]["summary"] == "s" and rows[0]["recommendations"] == []
    assert rows[3]["summary"] == replies.NO_SUMMARY and rows[3]["insights"] == []


def test_summary_message(spark):
    df = spark.createDataFrame([('{"summary":"s","insights":["a","b"],"recommendations":["c"]}',)], "reply string")
    text = replies.summary_message(replies.parse_replies(df), F.lit(None)).first()["message"]
    assert text == (
        "📊 *PODSUMOWANIE GODZINOWE* 📊\n\n*s*\n\n🔍 *Najważniejsze spostrzeżenia:*\n1. a\n2. b\n"
        "\n💡 *Rekomendacje:*\n1. c\n\n⏱️ *Wygenerowano:* przed chwilą"
    )


def test_no_symbol_of_the_day_is_crowded_out(spark):
    from types import SimpleNamespace

    from registry.dashboard import anomalies_dedup_day

    rows = [f"({i},'BTC',1,1,{50 + i},TIMESTAMP_NTZ'{CLOCK.as_of}' - INTERVAL 1 HOUR)" for i in range(12)]
    rows.append(f"(99,'ETH',1,1,-6,TIMESTAMP_NTZ'{CLOCK.as_of}' - INTERVAL 2 HOUR)")
    found = anomalies_dedup_day(SimpleNamespace(prices=prices(spark, ",".join(rows)))).collect()
    assert sorted((r["symbol"], r["id"]) for r in found) == [("BTC", 11), ("ETH", 99)]
    assert alerts.recent_anomalies(prices(spark, ",".join(rows)), CLOCK, minutes=1440).count() == 10
