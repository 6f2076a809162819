"""Feeds from files, write semantics, streaming jobs."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quotemill.clock import Clock, instant
from quotemill.plans.marts import daily_crypto_stats
from quotemill.session import new_work_dir, shared_dir
from quotemill.sources import feeds, sinks
from quotemill.sources.schemas import SOURCES
from quotemill.sources.tables import describe_sources, query, read_table
from quotemill.streaming import ingest, jobs
from quotemill.streaming.runs import drain_to_parquet, stream_parquet

CLOCK = Clock(datetime(2024, 1, 31))

TICKERS = [
    {"symbol": "BTCUSDT", "lastPrice": "42000.123456789", "quoteVolume": "1234.9", "priceChangePercent": "-3.8550"},
    {"symbol": "ETHUSDT", "lastPrice": "", "quoteVolume": None, "priceChangePercent": "0"},
    {"symbol": "ADAUSDT", "lastPrice": "12abc", "quoteVolume": "5", "priceChangePercent": "1"},
]
RSS = """<?xml version="1.0"?><rss><channel><title>Feed</title>
<item><title>It's &amp; up</title><description>text</description><link>https://x/1</link><pubDate>Mon, 01 Jan 2024 12:00:00 GMT</pubDate></item>
<item><title></title><link>https://x/2</link></item></channel></rss>"""


def test_ticker_files(spark, tmp_path):
    (tmp_path / "poll.json").write_text(json.dumps(TICKERS))
    raw = feeds.read_ticker_files(spark, str(tmp_path))
    service = feeds.normalise_tickers(raw)
    rows = {r["symbol"]: r for r in service.rows.collect()}
    assert set(rows) == {"BTC", "ETH"}
    assert str(rows["BTC"]["price_usd"]) == "42000.12345679" and rows["BTC"]["volume_24h"] == 1234
    assert str(rows["BTC"]["price_change_24h"]) == "-3.86" and rows["BTC"]["market_cap"] == 0
    assert rows["ETH"]["price_usd"] == 0 and rows["ETH"]["volume_24h"] == 0
    assert [r["symbol"] for r in service.rejects.collect()] == ["ADAUSDT"]
    workflow = {r["symbol"]: r for r in feeds.normalise_tickers(raw, "round").rows.collect()}
    assert workflow["BTC"]["volume_24h"] == 1235 and workflow["ADA"]["price_usd"] == 12
    with pytest.raises(ValueError):
        feeds.normalise_tickers(raw, "other")


def test_news_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    items = feeds.read_news_files(spark, str(tmp_path))
    rows = feeds.normalise_news(items, instant(CLOCK.now), CLOCK.zone).orderBy("url").collect()
    assert rows[0]["title"] == "It's & up" and rows[0]["published_at"] == datetime(2024, 1, 1, 12)
    assert rows[0]["source"] == "BBC News" and rows[0]["fetched_at"] == CLOCK.now
    assert rows[1]["title"] == "" and rows[1]["description"] == "" and rows[1]["published_at"] == CLOCK.now


def test_news_payload_keeps_the_first_items_and_falls_back(spark):
    items = "".join(f"<item><title>t{i}</title><summary>s{i}</summary><link>u{i}</link></item>" for i in range(14))
    df = spark.createDataFrame([(f"<rss><channel>{items}</channel></rss>",)], "payload string")
    parsed = feeds.news_from_payload(df, first=10)
    assert sorted(r["item_pos"] for r in parsed.collect()) == list(range(10))
    assert feeds.news_from_payload(df).count() == 14
    rows = feeds.normalise_news(parsed, instant(CLOCK.now), CLOCK.zone, "workflow", "Feed").collect()
    assert {r["description"] for r in rows} == {f"s{i}" for i in range(10)}


def test_weather_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"current": {"temperature_2m": 15.5, "relative_humidity_2m": 65, "weather_code": 0}}))
    (tmp_path / "b.json").write_text(json.dumps({"current": {}}))
    (tmp_path / "c.json").write_text("<html>502</html>")
    parsed = feeds.normalise_weather(feeds.read_weather_files(spark, str(tmp_path)))
    assert [r["payload"] for r in parsed.rejects.collect()] == ["<html>502</html>"]
    rows = parsed.rows.orderBy("temperature").collect()
    assert [str(r["temperature"]) for r in rows] == ["0.00", "15.50"]
    assert rows[1]["city"] == "Warsaw" and rows[1]["weather_condition"] == "clear sky" and rows[1]["humidity"] == 65


def test_tables_and_parameters(spark, tmp_path):
    df = spark.createDataFrame([(1, "BTC")], "id bigint, symbol string")
    df.write.parquet(f"{tmp_path}/crypto_prices")
    back = read_table(spark, str(tmp_path), "crypto_prices")
    assert back.schema == SOURCES["crypto_prices"].schema and back.first()["price_usd"] is None
    assert query(spark, "SELECT * FROM {t} WHERE symbol = :s", {"s": "BTC' OR '1'='1"}, t=back).count() == 0
    assert describe_sources(spark).filter("required").count() == 9


BAD = ["<html>502 Bad Gateway</html>", '{"code":-1003}', "", None]


def payloads(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_unusable_tickers_are_rejected_and_nothing_stops(spark):
    def ticker(**given):
        return {"symbol": "BTCUSDT", "lastPrice": "1", "quoteVolume": "1", "priceChangePercent": "1"} | given

    odd = [ticker(lastPrice=x) for x in ("1e12", "NaN", "Infinity")] + [ticker(quoteVolume="1e30"), ticker(priceChangePercent="1e15"), ticker(symbol=None)]
    raw = feeds.tickers_from_payload(payloads(spark, [json.dumps([ticker(), *odd]), "[]", *BAD]))
    parsed = feeds.normalise_tickers(raw)
    assert parsed.rows.columns == ["item_pos", "symbol", "price_usd", "market_cap", "volume_24h", "price_change_24h"] and parsed.rows.count() == 1
    rejects = parsed.rejects.collect()
    assert len(rejects) == len(odd) + len(BAD)
    assert sorted(r["payload"] for r in rejects if r["payload"] is not None) == sorted(t for t in BAD if t is not None)
    loose = feeds.normalise_tickers(raw, "round")
    assert loose.rows.count() + loose.rejects.count() == 1 + len(odd) + len(BAD)
    assert loose.rows.agg(F.max("volume_24h")).first()[0] == 1


def test_unreadable_news_and_weather_polls_are_kept(spark):
    news = payloads(spark, [RSS, *BAD])
    assert feeds.unreadable_news(news).count() == len(BAD) and feeds.news_from_payload(news).count() == 2
    good = [json.dumps({"current": {"temperature_2m": t}}) for t in (3.5, 12345)]
    parsed = feeds.normalise_weather(feeds.weather_from_payload(payloads(spark, [*good, *BAD])))
    assert [str(r["temperature"]) for r in parsed.rows.collect()] == ["3.50"]
    assert sorted(str(r["payload"]) for r in parsed.rejects.collect()) == sorted(map(str, [good[1], *BAD]))


def test_articles_without_a_link_are_all_stored(spark, tmp_path):
    items = "".join(f"<item><title>t{i}</title><description>{'x' * 900}</description><link></link></item>" for i in range(12))
    root = f"{tmp_path}/store"
    ingest.NewsIngest(root, clock=lambda: CLOCK)(
        spark.createDataFrame([(None, f"<rss><channel>{items}</channel></rss>"), (None, BAD[0])], ingest.LANDING_SCHEMA), 0
    )
    stored = spark.read.parquet(f"{root}/news_articles").collect()
    assert sorted(r["title"] for r in stored) == sorted(f"t{i}" for i in range(12))
    assert {len(r["description"]) for r in stored} == {900} and {r["url"] for r in stored} == {None}
    assert spark.read.parquet(f"{root}/rejects").first()["payload"] == BAD[0]


# --- write semantics -----------------------------------------------------------------------

def test_rows_without_url_all_pass_and_known_urls_do_not(spark):
    target = spark.createDataFrame([(0, "a")], "id bigint, url string")
    incoming = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, None)], "id bigint, url string")
    fresh = sinks.insert_if_absent(target, incoming, ["url"], [F.col("id")])
    assert sorted(r["id"] for r in fresh.collect()) == [2, 4, 5]


def test_upsert_prefers_the_change_on_ties(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 11)], "t string, v int, n int")
    new = spark.createDataFrame([("a", 1, 20), ("c", 5, 21)], "t string, v int, n int")
    assert sorted(map(tuple, sinks.upsert_latest(old, new, "t", "v").collect())) == [("a", 1, 20), ("b", 1, 11), ("c", 5, 21)]


def test_replayed_batch_is_not_stored_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id bigint, v string")
    for _ in range(2):
        sinks.write_batch(df, f"{tmp_path}/t", 7)
    sinks.write_batch(df, f"{tmp_path}/t", 8)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_retention_keeps_the_bound_and_null(spark):
    df = spark.sql("SELECT CAST(t AS TIMESTAMP_NTZ) AS t FROM VALUES ('2024-01-01 00:00:00'), ('2023-12-31 23:59:59'), (NULL) t(t)")
    assert sinks.retain(df, "t", 30, instant(datetime(2024, 1, 31))).count() == 2


def test_reader_sees_only_complete_mart_versions(spark, tmp_path):
    path = f"{tmp_path}/mart"
    sinks.publish_mart(spark.range(3), path, 1)
    spark.range(9).write.parquet(f"{path}/version=2")
    assert sinks.read_mart(spark, path).count() == 3
    sinks.publish_mart(spark.range(5), path, 2)
    assert sinks.read_mart(spark, path).count() == 5


def test_stamp_and_ids(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    rows = sinks.with_row_id(sinks.stamp(df, instant(CLOCK.now)), "k").collect()
    assert {r["timestamp"] for r in rows} == {CLOCK.now} and len({r["id"] for r in rows}) == 2


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == named.rstrip("/")
    assert new_work_dir(spark, "x").startswith(named.rstrip("/"))


# --- streams ---------------------------------------------------------------------------------

def landing(spark, path, polls):
    rows = [(at, json.dumps(tickers)) for at, tickers in polls]
    df = spark.createDataFrame(rows, "polled_at timestamp_ntz, payload string")
    df.coalesce(1).write.mode("append").parquet(path)


def test_ingest_resumes_without_storing_twice(spark, tmp_path):
    source, root = f"{tmp_path}/landing", f"{tmp_path}/store"
    job = ingest.TickerIngest(root, clock=lambda: CLOCK, refresh=daily_crypto_stats)
    landing(spark, source, [(datetime(2024, 1, 30, 10), TICKERS)])
    ingest.run_ingest(spark, source, job)
    ingest.run_ingest(spark, source, job)
    assert ingest.stored_prices(spark, root).count() == 2
    landing(spark, source, [(datetime(2024, 1, 30, 11), TICKERS[:1])])
    ingest.run_ingest(spark, source, job)
    stored = ingest.stored_prices(spark, root)
    assert stored.count() == 3 and {r["date"] for r in stored.collect()} == {date(2024, 1, 30)}
    failures = ingest.stored_failures(spark, root).collect()
    assert [json.loads(f["content"])["failed_checks"] for f in failures] == [["RangeCheck:price_usd[0.0,None]"]]
    assert spark.read.parquet(f"{root}/rejects").count() == 1
    assert ingest.current_metadata(spark, root).first()["rows_inserted"] == 1
    assert sinks.read_mart(spark, f"{root}/mart").count() == 2


def test_retention_and_failed_refresh_do_not_stop_the_loop(spark, tmp_path):
    source, root = f"{tmp_path}/landing", f"{tmp_path}/store"

    def broken(prices, clock):
        raise RuntimeError("no mart")

    job = ingest.TickerIngest(root, clock=lambda: CLOCK, retention_days=10, refresh=broken)
    landing(spark, source, [(datetime(2024, 1, 2, 10), TICKERS[:1]), (datetime(2024, 1, 30, 10), TICKERS[:1])])
    ingest.run_ingest(spark, source, job)
    assert ingest.stored_prices(spark, root).count() == 1


def test_stores_stay_bounded_over_many_batches(spark, tmp_path):
    """A day per batch with two days of retention; a batch is replayed in between."""
    def at(day):
        return Clock(datetime(2024, 1, day, 12))

    counts = []
    for day in range(1, 7):
        clock = at(day)
        polled = datetime(2024, 1, day, 10)
        weather = ingest.WeatherIngest(f"{tmp_path}/w", clock=lambda: clock, retention_days=2)
        news = ingest.NewsIngest(f"{tmp_path}/n", clock=lambda: clock, retention_days=2)
        prices = ingest.TickerIngest(f"{tmp_path}/p", clock=lambda: clock, retention_days=2, refresh=daily_crypto_stats, refresh_days=8)
        polls = [
            (weather, json.dumps({"current": {"temperature_2m": day}})),
            (news, f"<rss><channel><item><title>t</title><link>https://x/{day}</link></item></channel></rss>"),
            (prices, json.dumps(TICKERS[:1])),
        ]
        for job, text in polls:
            landed = spark.createDataFrame([(polled, text)], ingest.LANDING_SCHEMA)
            for _ in range(2 if day == 4 else 1):
                job(landed, day)
        counts.append(tuple(len(list((tmp_path / s).glob("date=*"))) for s in ("w/weather_data", "n/news_articles", "p/crypto_prices")))
    assert counts[-1] == counts[-3] == (3, 3, 3)
    assert spark.read.parquet(f"{tmp_path}/w/weather_data").count() == 3
    assert len(list((tmp_path / "p/mart").glob("version=*"))) == 2
    assert sinks.read_mart(spark, f"{tmp_path}/p/mart").count() == 3


def test_raw_response_files_and_known_urls(spark, tmp_path):
    source, root = tmp_path / "feeds", f"{tmp_path}/store"
    source.mkdir()
    (source / "one.xml").write_text(RSS)
    job = ingest.NewsIngest(root, clock=lambda: CLOCK)
    ingest.run_ingest(spark, str(source), job, raw_files=True)
    (source / "two.xml").write_text(RSS.replace("https://x/2", "https://x/3"))
    ingest.run_ingest(spark, str(source), job, raw_files=True)
    stored = spark.read.parquet(f"{root}/news_articles")
    assert sorted(r["url"] for r in stored.collect()) == ["https://x/1", "https://x/2", "https://x/3"]
    # The same batch again finds its own first attempt and must not lose it.
    job(spark.createDataFrame([(None, RSS)], ingest.LANDING_SCHEMA), 0)
    again = spark.read.parquet(f"{root}/news_articles")
    assert again.filter("batch_id = 0").count() == 2


def test_raw_tickers_are_stamped(spark, tmp_path):
    source, root = tmp_path / "polls", f"{tmp_path}/store"
    source.mkdir()
    (source / "poll.json").write_text(json.dumps(TICKERS, indent=1))
    ingest.run_ingest(spark, str(source), ingest.TickerIngest(root, clock=lambda: CLOCK), raw_files=True)
    assert {r["timestamp"] for r in ingest.stored_prices(spark, root).collect()} == {CLOCK.now}


def test_articles_without_url_all_pass_the_stream(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (3, None), (4, None)]
    df = spark.createDataFrame(rows, "id bigint, url string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/in")
    out = drain_to_parquet(jobs.new_articles_stream(stream_parquet(spark, f"{tmp_path}/in", df.schema)), "t", f"{tmp_path}/out")
    assert spark.read.parquet(out).count() == 3
    # A later poll brings the same article again and a new one.
    spark.createDataFrame([(5, "a"), (6, "b")], "id bigint, url string").withColumn(
        "fetched_at", F.lit("2024-01-02").cast("timestamp_ntz")
    ).write.mode("append").parquet(f"{tmp_path}/in")
    drain_to_parquet(jobs.new_articles_stream(stream_parquet(spark, f"{tmp_path}/in", df.schema)), "t", f"{tmp_path}/out")
    assert {r["id"] for r in spark.read.parquet(out).collect()} - {1, 2} == {3, 4, 6}


# --- hot keys: rows are reduced before they are shuffled ----------------------------------------

def _below_first_exchange(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Exchange hashpartitioning"):]


def test_one_hot_url_sends_one_row_per_task(spark):
    rows = spark.range(0, 30000, 1, 6).select(
        "id", F.when(F.col("id") % 3 == 0, "https://hot").otherwise(F.concat(F.lit("https://x/"), "id")).alias("url")
    )
    kept = sinks.keep_first(rows, ["url"], [F.col("id")])
    assert kept.count() == 20001 and kept.filter("url = 'https://hot'").first()["id"] == 0
    below = _below_first_exchange(kept)
    assert "WindowGroupLimit" in below and "Partial" in below and "SortAggregate" not in below
    assert below.count("Range (") == 1


def test_upsert_and_strongest_reduce_before_the_shuffle(spark, tables):
    from quotemill.operators import alerts

    strongest = alerts.strongest_per_symbol(tables.prices)
    assert "WindowGroupLimit" in _below_first_exchange(strongest)
    versions = spark.range(0, 30000, 1, 6).select((F.col("id") % 3).alias("key"), F.col("id").alias("version"))
    both = sinks.upsert_latest(versions, versions.limit(10), "key", "version")
    assert "WindowGroupLimit" in _below_first_exchange(both)


def test_no_registered_query_multiplies_rows(spark):
    """No cross join in any plan, not even of small frames."""
    from registry.tables import QUERIES
    from tests.conftest import SMALL

    for name, run in QUERIES.items():
        if name.startswith("stream"):
            continue
        plan = run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
