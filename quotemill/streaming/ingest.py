"""Ingest loops over landed polls: tickers, news, weather.

A landing folder holds the polls either as parquet rows (polled_at, payload) or as the
raw response files, one poll per file.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quotemill.clock import Clock, live_clock
from quotemill.functions.times import instant_to_utc, local_date
from quotemill.functions.weather import SHORT_CODES
from quotemill.operators.joins import settled
from quotemill.operators.quality import cleaned, observe_run, run_checks
from quotemill.operators.quality.log import failure_log
from quotemill.plans.day_states import states_of
from quotemill.sources import key_filters, sinks
from quotemill.sources.feeds import (
    news_from_payload,
    normalise_news,
    normalise_tickers,
    normalise_weather,
    tickers_from_payload,
    unreadable_news,
    weather_from_payload,
)
from quotemill.sources.schemas import CRYPTO_PRICES
from quotemill.streaming.day_mart import DayMart

log = logging.getLogger(__name__)

_NEWS_STORED = "title STRING, id BIGINT, description STRING, source STRING, url STRING, published_at TIMESTAMP_NTZ"
_INSIGHTS_STORED = "id BIGINT, insight_type STRING, content STRING, data_snapshot STRING, generated_at TIMESTAMP_NTZ"
LANDING_SCHEMA = "polled_at TIMESTAMP_NTZ, payload STRING"


@dataclass(frozen=True)
class TickerIngest:
    """One micro-batch of landed polls into the store below `root`.

    Every write goes to a folder named after the batch, so a batch replayed after a
    failure replaces its own output. `refresh` rebuilds a mart from the stored days; with
    `refresh_days` it gets those of the last days only, the others are not read. `day_mart` takes
    the batch's day states instead and recomputes the days of the batch alone.
    """

    root: str
    clock: Callable[[], Clock] = live_clock
    volume_mode: str = "truncate"
    retention_days: int | None = sinks.RETENTION_DAYS["crypto_prices"][1]
    refresh: Callable[[DataFrame, Clock], DataFrame] | None = None
    refresh_days: int | None = None
    day_mart: DayMart | None = None

    def __call__(self, landed: DataFrame, batch_id: int) -> None:
        clock = self.clock()
        parsed = normalise_tickers(tickers_from_payload(landed), self.volume_mode)
        stamped = sinks.stamp(parsed.rows.withColumnRenamed("polled_at", "timestamp"), clock.now_column())
        batch = stamped.withColumn("_batch", F.lit(batch_id))
        rows = sinks.with_row_id(batch, "_batch", "item_pos", "symbol", "timestamp", "price_usd", "volume_24h", "price_change_24h")
        checked = run_checks(
            rows.select(*CRYPTO_PRICES.names), "crypto_prices", clock, record_id=F.col("symbol")
        ).persist(StorageLevel.MEMORY_AND_DISK)
        metrics = Observation("dq")
        try:
            sinks.append_snapshots(cleaned(observe_run(checked, metrics)), f"{self.root}/crypto_prices", batch_id, clock.zone)
            day = local_date("generated_at", clock.zone)
            sinks.write_batch(failure_log(checked), f"{self.root}/ai_insights", batch_id, day)
            sinks.write_batch(parsed.rejects, f"{self.root}/rejects", batch_id)
            record_load(f"{self.root}/dq_metadata", sinks.load_metadata(checked, "crypto_prices", clock.now_column()))
            if self.day_mart is not None:
                logged = failure_log(checked)
                states = states_of(clock, prices=cleaned(checked), insights=logged)
                self.day_mart.absorb(states, f"tickers-{batch_id}")
        finally:
            checked.unpersist()
        counted = metrics.get
        level = logging.WARNING if counted.get("failures") else logging.INFO
        log.log(level, "batch %s: %s", batch_id, counted)
        spark = landed.sparkSession
        expire(spark, f"{self.root}/crypto_prices", self.retention_days, clock)
        if self.refresh is not None:
            try:
                stored = stored_prices(spark, self.root, clock, self.refresh_days)
                sinks.publish_mart(self.refresh(stored, clock), f"{self.root}/mart", batch_id)
            except Exception:
                log.warning("mart refresh of batch %s failed; the old version stays", batch_id, exc_info=True)


@dataclass(frozen=True)
class NewsIngest:
    """One micro-batch of landed RSS polls: the items whose URL is not stored yet.

    Articles without a URL are all stored. `first` and `clip` keep so many items of a poll and
    characters of a description; by default everything is kept. Days beyond the retention go.
    """

    root: str
    clock: Callable[[], Clock] = live_clock
    variant: str = "service"
    source: str = "BBC News"
    first: int | None = None
    clip: int | None = None
    retention_days: int | None = sinks.RETENTION_DAYS["news_articles"][1]
    day_mart: DayMart | None = None

    def __call__(self, landed: DataFrame, batch_id: int) -> None:
        clock = self.clock()
        items = news_from_payload(landed, first=self.first)
        rows = normalise_news(items, clock.now_column(), clock.zone, self.variant, self.source, self.clip)
        path = f"{self.root}/news_articles"
        order = [F.coalesce("polled_at", "fetched_at"), F.col("item_pos")]
        spark = landed.sparkSession
        # A replayed batch must not meet the rows of its own first attempt.
        known, keys = _stored(spark, path, "url STRING, batch_id BIGINT, date DATE"), f"{self.root}/news_keys"
        if known is None:
            fresh = sinks.keep_first(rows, ["url"], order)
        else:
            # Only the stored days whose key filter knows some URL of the batch are read.
            others = known.filter(F.col("batch_id") != batch_id)
            fresh = key_filters.insert_if_absent(others, keys, rows, ["url"], order, but_batch=batch_id)
        articles = sinks.with_row_id(fresh.drop("polled_at", "item_pos"), "url", "title", "published_at")
        day = local_date("fetched_at", clock.zone)
        articles = settled(articles)
        key_filters.write_filters(articles, keys, batch_id, ["url"], day)
        sinks.write_batch(articles, path, batch_id, day)
        sinks.write_batch(unreadable_news(landed), f"{self.root}/rejects", batch_id)
        if self.day_mart is not None:
            stored = _stored(spark, path, f"{_NEWS_STORED}, date DATE, batch_id BIGINT")
            self.day_mart.absorb(states_of(clock, news=stored.filter(F.col("batch_id") == batch_id)), f"news-{batch_id}")
        expire(spark, path, self.retention_days, clock)
        expire(spark, keys, self.retention_days, clock)


@dataclass(frozen=True)
class WeatherIngest:
    """One micro-batch of landed weather polls, appended. Days beyond the retention go."""

    root: str
    clock: Callable[[], Clock] = live_clock
    city: str = "Warsaw"
    codes: dict[int, str] = field(default_factory=lambda: dict(SHORT_CODES))
    retention_days: int | None = sinks.RETENTION_DAYS["weather_data"][1]
    day_mart: DayMart | None = None

    def __call__(self, landed: DataFrame, batch_id: int) -> None:
        clock = self.clock()
        parsed = normalise_weather(weather_from_payload(landed), self.city, self.codes)
        stamped = sinks.stamp(parsed.rows.withColumnRenamed("polled_at", "timestamp"), clock.now_column())
        path = f"{self.root}/weather_data"
        sinks.write_batch(stamped, path, batch_id, local_date("timestamp", clock.zone))
        sinks.write_batch(parsed.rejects, f"{self.root}/rejects", batch_id)
        if self.day_mart is not None:
            self.day_mart.absorb(states_of(clock, readings=stamped, city=self.city), f"weather-{batch_id}")
        expire(landed.sparkSession, path, self.retention_days, clock)


def expire(spark: SparkSession, path: str, days: int | None, clock: Clock) -> None:
    """Delete the stored local days that lie wholly beyond the retention.

    The day the bound falls into stays; `sinks.retain` gives readers the exact bound.
    """
    if days is not None:
        bound = replace(clock, as_of=clock.now - timedelta(days=days))
        sinks.drop_old_days(spark, path, bound.today)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A store that may not exist yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(path)


def stored_prices(spark: SparkSession, root: str, clock: Clock | None = None, days: int | None = None) -> DataFrame:
    """Prices written by the ingest, with their `date` partition; with `days` the last ones only."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CRYPTO_PRICES.fields)
    stored = spark.read.schema(f"{ddl}, batch_id BIGINT, date DATE").parquet(f"{root}/crypto_prices")
    return stored if clock is None or days is None else stored.filter(F.col("date") >= clock.day(days))


def stored_failures(spark: SparkSession, root: str) -> DataFrame:
    """The failure log written by the ingest, with its `date` partition."""
    return spark.read.schema(f"{_INSIGHTS_STORED}, date DATE, batch_id BIGINT").parquet(f"{root}/ai_insights")


def record_load(path: str, load: DataFrame) -> None:
    """Put a load into the metadata: one row per table, written as a version of its own."""
    spark = load.sparkSession
    version = sinks.newest_version(spark, path)
    if version is not None:
        stored = spark.read.schema(load.schema).parquet(f"{path}/version={version}")
        load = sinks.upsert_latest(stored, load, "table_name", "last_check")
    sinks.publish_mart(load.coalesce(1), path, (version or 0) + 1)


def current_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The newest metadata row per table."""
    return sinks.read_mart(spark, f"{root}/dq_metadata").select(
        "table_name", "last_successful_ts", "rows_inserted", "last_check"
    )


def run_ingest(
    spark: SparkSession,
    landing: str,
    job: TickerIngest | NewsIngest | WeatherIngest,
    every: str | None = None,
    files_per_batch: int | None = None,
    raw_files: bool = False,
    file_times: bool = False,
) -> None:
    """Run a loop over a landing folder: once over everything available, or every `every`.

    Raw files have no poll time of their own: they get the batch's, or with `file_times` each the
    time its file was written, which is when its poll came back.
    """
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if raw_files:
        whole = reader.text(landing, wholetext=True)
        written = instant_to_utc(F.col("_metadata.file_modification_time"))
        polled = written if file_times else F.lit(None).cast("timestamp_ntz")
        landed = whole.select(polled.alias("polled_at"), F.col("value").alias("payload"))
    else:
        landed = reader.schema(LANDING_SCHEMA).parquet(landing)
    writer = landed.writeStream.foreachBatch(job).option("checkpointLocation", f"{job.root}/checkpoint")
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    writer.start().awaitTermination()
