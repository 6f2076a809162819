from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.plans import day_states, marts
from quotemill.streaming import ingest
from quotemill.streaming.day_mart import DayMart
from registry.tables import CLOCK

PRICE = "symbol STRING, price_usd DECIMAL(18,8), volume_24h BIGINT, price_change_24h DECIMAL(10,2), timestamp TIMESTAMP_NTZ"


def prices(spark, rows):
    typed = [(s, str(p), 1, str(c), datetime.fromisoformat(t)) for s, p, c, t in rows]
    frame = spark.createDataFrame(typed, "symbol STRING, price_usd STRING, volume_24h BIGINT, price_change_24h STRING, timestamp TIMESTAMP_NTZ")
    return frame.select("symbol", F.col("price_usd").cast("decimal(18,8)"), "volume_24h", F.col("price_change_24h").cast("decimal(10,2)"), "timestamp")


def rows_of(df):
    return sorted(map(tuple, df.select("date", "btc_avg_price", "avg_price_change", "active_coins", "news_count").collect()), key=str)


def test_states_of_parts_add_up(tables):
    whole = [tuple(r) for r in marts.market_daily(tables.prices, tables.news, tables.weather, tables.failures, CLOCK).collect()]
    parts = [day_states.states_of(CLOCK, prices=tables.prices.where(F.col("id") % 3 == i)) for i in range(3)]
    states = day_states.states_of(CLOCK, news=tables.news, readings=tables.weather, insights=tables.failures)
    for part in parts:
        states = states.unionByName(day_states.merged(part))
    assert sorted(map(str, map(tuple, day_states.daily_from_states(states).collect()))) == sorted(map(str, whole))


def test_batches_replays_late_rows_and_expiry(spark, tmp_path):
    mart = DayMart(f"{tmp_path}/mart")
    first = [("BTC", 10, 1, "2024-01-02 10:00:00"), ("BTC", 20, 2, "2024-01-03 10:00:00"), ("ETH", 5, 0, "2024-01-03 11:00:00")]
    late = [("BTC", 40, 3, "2024-01-02 12:00:00"), ("BTC", 7, 1, "2024-01-04 12:00:00")]
    absorb = lambda rows, share: mart.absorb(day_states.states_of(CLOCK, prices=prices(spark, rows)), share)
    assert absorb(first, "a") == [date(2024, 1, 2), date(2024, 1, 3)]
    assert absorb(late, "b") == [date(2024, 1, 2), date(2024, 1, 4)]
    whole = marts.market_daily(prices(spark, first + late), *(spark.createDataFrame([], s) for s in (
        "id bigint, title string, description string, source string, url string, published_at timestamp_ntz",
        "city string, temperature decimal(5,2), humidity int, weather_condition string, timestamp timestamp_ntz",
        "insight_type string, generated_at timestamp_ntz")), CLOCK)
    assert rows_of(mart.read(spark)) == rows_of(whole)
    absorb(late, "b")
    assert rows_of(mart.read(spark)) == rows_of(whole)
    # The batch again with other rows: its day without rows loses its share.
    assert absorb(late[:1], "b") == [date(2024, 1, 2), date(2024, 1, 4)]
    assert {r[0] for r in rows_of(mart.read(spark))} == {date(2024, 1, 2), date(2024, 1, 3)}
    mart.expire(spark, date(2024, 1, 3))
    assert {r[0] for r in rows_of(mart.read(spark))} == {date(2024, 1, 3)}
    assert not (tmp_path / "mart/states/date=2024-01-02").exists()
    assert absorb([], "c") == [] and len(rows_of(mart.read(spark))) == 1


def test_untouched_days_are_not_read(spark, tmp_path):
    mart = DayMart(f"{tmp_path}/mart")
    absorb = lambda rows, share: mart.absorb(day_states.states_of(CLOCK, prices=prices(spark, rows)), share)
    absorb([("BTC", 10, 1, "2024-01-02 10:00:00"), ("BTC", 20, 2, "2024-01-03 10:00:00")], "a")
    for file in (tmp_path / "mart/states/date=2024-01-02").rglob("*.parquet"):
        file.write_bytes(b"no parquet at all")
    for crc in (tmp_path / "mart/states/date=2024-01-02").rglob(".*.crc"):
        crc.unlink()
    absorb([("BTC", 40, 2, "2024-01-03 12:00:00")], "b")
    assert {(r[0], float(r[1])) for r in rows_of(mart.read(spark))} == {(date(2024, 1, 2), 10.0), (date(2024, 1, 3), 30.0)}
    with pytest.raises(Exception):
        mart.states(spark, [date(2024, 1, 2)]).collect()


def test_ingest_keeps_the_mart(spark, tmp_path):
    import json

    mart = DayMart(f"{tmp_path}/mart")
    clock = Clock(datetime(2024, 1, 4, 12))
    job = ingest.TickerIngest(f"{tmp_path}/p", clock=lambda: clock, day_mart=mart)
    news = ingest.NewsIngest(f"{tmp_path}/n", clock=lambda: clock, day_mart=mart)
    weather = ingest.WeatherIngest(f"{tmp_path}/w", clock=lambda: clock, day_mart=mart)
    ticker = {"symbol": "BTCUSDT", "lastPrice": "10", "quoteVolume": "5", "priceChangePercent": "2"}
    landed = lambda text, at: spark.createDataFrame([(at, text)], ingest.LANDING_SCHEMA)
    for batch, price in ((0, "10"), (1, "30"), (1, "30")):
        job(landed(json.dumps([ticker | {"lastPrice": price}]), datetime(2024, 1, 4, 10, batch)), batch)
    item = "<item><title>t</title><link>https://x/1</link><pubDate>Thu, 04 Jan 2024 09:00:00 GMT</pubDate></item>"
    for batch in (0, 0, 1):
        news(landed(f"<rss><channel>{item}</channel></rss>", datetime(2024, 1, 4, 10)), batch)
    weather(landed(json.dumps({"current": {"temperature_2m": 7.5, "relative_humidity_2m": 50, "weather_code": 0}}), datetime(2024, 1, 4, 10)), 0)
    row = mart.read(spark).collect()
    assert len(row) == 1 and row[0]["date"] == date(2024, 1, 4)
    assert float(row[0]["btc_avg_price"]) == 20.0 and row[0]["news_count"] == 1 and float(row[0]["avg_temperature"]) == 7.5


def test_metadata_has_one_row_per_table(spark, tmp_path):
    for batch in range(4):
        load = spark.createDataFrame([("crypto_prices", datetime(2024, 1, 1, batch), batch, datetime(2024, 1, 1, batch))],
                                     "table_name string, last_successful_ts timestamp_ntz, rows_inserted bigint, last_check timestamp_ntz")
        ingest.record_load(f"{tmp_path}/dq_metadata", load)
    ingest.record_load(f"{tmp_path}/dq_metadata", load.withColumn("table_name", F.lit("weather_data")))
    rows = ingest.current_metadata(spark, str(tmp_path)).collect()
    assert sorted((r["table_name"], r["rows_inserted"]) for r in rows) == [("crypto_prices", 3), ("weather_data", 3)]
    assert len(list((tmp_path / "dq_metadata").glob("version=*"))) == 2


def test_raw_polls_get_the_time_of_their_files(spark, tmp_path):
    import json
    import os

    source = tmp_path / "polls"
    source.mkdir()
    for n in range(3):
        (source / f"{n}.json").write_text(json.dumps([{"symbol": "BTCUSDT", "lastPrice": str(n + 1), "quoteVolume": "5", "priceChangePercent": "2"}]))
        at = (datetime(2024, 1, 4, 10, n) - datetime(1970, 1, 1)).total_seconds()
        os.utime(source / f"{n}.json", (at, at))
    job = ingest.TickerIngest(f"{tmp_path}/store", clock=lambda: Clock(datetime(2024, 1, 5)))
    ingest.run_ingest(spark, str(source), job, raw_files=True, file_times=True)
    stored = {(float(r["price_usd"]), r["timestamp"]) for r in ingest.stored_prices(spark, f"{tmp_path}/store").collect()}
    assert stored == {(n + 1.0, datetime(2024, 1, 4, 10, n)) for n in range(3)}
