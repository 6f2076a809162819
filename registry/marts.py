"""Staging, marts, correlation tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quotemill.operators import staging
from quotemill.plans import day_states, marts
from quotemill.session import new_work_dir
from quotemill.streaming.day_mart import DayMart
from registry.tables import CLOCK, Tables, day_start, local_clock, local_day, mean, register

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

STAGED_PRICES = f"""
SELECT symbol, price_usd, volume_24h, price_change_24h, {local_clock('timestamp')} AS timestamp_local,
       {local_day('timestamp')} AS date
FROM crypto_prices WHERE price_usd > 0 AND timestamp <= {AS_OF}
"""
STAGED_NEWS = f"""
SELECT id, title, description, source, url, {local_clock('published_at')} AS published_at_local,
       {local_day('published_at')} AS date
FROM news_articles WHERE title <> ''
"""
STAGED_WEATHER = f"""
SELECT city, temperature, humidity, weather_condition, {local_clock('timestamp')} AS timestamp_local,
       {local_day('timestamp')} AS date
FROM weather_data WHERE city = 'Warsaw'
"""


def _price_days(table: str, date: str, where: str = "true") -> str:
    return f"""
SELECT {date} AS date, count(DISTINCT symbol) AS active_coins,
  sum(price_usd) FILTER (WHERE symbol = 'BTC') AS btc_sum, count(price_usd) FILTER (WHERE symbol = 'BTC') AS btc_n,
  sum(price_usd) FILTER (WHERE symbol = 'ETH') AS eth_sum, count(price_usd) FILTER (WHERE symbol = 'ETH') AS eth_n,
  sum(price_change_24h) AS chg_sum, count(price_change_24h) AS chg_n, max(abs(price_change_24h)) AS chg_max
FROM {table} WHERE {where} GROUP BY ALL
"""


DAILY_SQL = f"""
SELECT p.date, {mean('btc_sum', 'btc_n', 8, 2)} AS btc_avg_price, {mean('eth_sum', 'eth_n', 8, 2)} AS eth_avg_price,
  {mean('chg_sum', 'chg_n', 2, 2)} AS avg_price_change, active_coins, coalesce(news_count, 0) AS news_count,
  {mean('t_sum', 't_n', 2, 1)} AS avg_temperature, coalesce(dq_failures_count, 0) AS dq_failures_count
FROM price_days p
LEFT JOIN (SELECT date, count(DISTINCT id) AS news_count FROM stg_news GROUP BY date) n ON n.date = p.date
LEFT JOIN (SELECT date, sum(temperature) AS t_sum, count(temperature) AS t_n FROM stg_weather GROUP BY date) w ON w.date = p.date
LEFT JOIN (SELECT {local_day('generated_at')} AS date, count(DISTINCT id) AS dq_failures_count FROM failures GROUP BY 1) f
  ON f.date = p.date
"""
DAILY_PARTS = {
    "stg_prices": STAGED_PRICES, "stg_news": STAGED_NEWS, "stg_weather": STAGED_WEATHER,
    "price_days": _price_days("stg_prices", "date"),
}
DAILY_VIEWS = ("failures",)
DAILY = {**DAILY_PARTS, "daily": DAILY_SQL}


def daily(t: Tables, days: int | None = None):
    return marts.market_daily(t.prices, t.news, t.weather, t.failure_marks, CLOCK, days=days)


@register("stg_prices", "SELECT * REPLACE (CAST(price_usd AS DOUBLE) AS price_usd, "
          "CAST(price_change_24h AS DOUBLE) AS price_change_24h) FROM staged", ("crypto_prices",), staged=STAGED_PRICES)
def stg_prices(t: Tables):
    return staging.stage_prices(t.prices, CLOCK)


@register("stg_news", "SELECT * FROM staged", ("news_articles",), staged=STAGED_NEWS)
def stg_news(t: Tables):
    return staging.stage_news(t.news, CLOCK)


@register("stg_weather", "SELECT * REPLACE (CAST(temperature AS DOUBLE) AS temperature) FROM staged",
          ("weather_data",), staged=STAGED_WEATHER)
def stg_weather(t: Tables):
    return staging.stage_weather(t.weather, CLOCK)


@register(
    "daily_stats",
    f"""
SELECT symbol, {local_day('timestamp')} AS date, round({mean('sum(price_usd)', 'count(price_usd)', 8, 8)}, 6) AS avg_price,
  CAST(max(price_usd) AS DOUBLE) AS max_price, CAST(min(price_usd) AS DOUBLE) AS min_price
FROM crypto_prices WHERE timestamp >= {day_start(7)} GROUP BY ALL
""",
    ("crypto_prices",),
)
def daily_stats(t: Tables):
    stats = marts.daily_crypto_stats(t.prices, CLOCK)
    return stats.withColumn("avg_price", F.round(F.round("avg_price", 8).cast("double"), 6))


@register(
    "market_daily_view",
    f"""
SELECT p.date, active_coins, {mean('btc_sum', 'btc_n', 8, 2)} AS btc_avg_price, {mean('eth_sum', 'eth_n', 8, 2)} AS eth_avg_price,
  {mean('chg_sum', 'chg_n', 2, 4)} AS market_avg_change, CAST(chg_max AS DOUBLE) AS max_abs_price_change,
  CASE WHEN chg_sum > chg_n THEN 'Bullish' WHEN chg_sum < -chg_n THEN 'Bearish' ELSE 'Neutral' END AS market_sentiment,
  coalesce(news_count, 0) AS news_count, CAST(NULL AS DOUBLE) AS avg_news_sentiment, 0 AS positive_news, 0 AS negative_news,
  {mean('t_sum', 't_n', 2, 1)} AS warsaw_avg_temp, dominant_weather, coalesce(dq_failures_count, 0) AS dq_failures_count
FROM price_days p
LEFT JOIN (SELECT {local_day('published_at')} AS date, count(DISTINCT id) AS news_count FROM news_articles GROUP BY 1) n ON n.date = p.date
LEFT JOIN (SELECT {local_day('timestamp')} AS date, sum(temperature) AS t_sum, count(temperature) AS t_n FROM weather_data GROUP BY 1) w
  ON w.date = p.date
LEFT JOIN (SELECT date, weather_condition AS dominant_weather FROM (
             SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, weather_condition) AS rn FROM (
               SELECT {local_day('timestamp')} AS date, weather_condition, count(*) AS n FROM weather_data GROUP BY ALL))
           WHERE rn = 1) m ON m.date = p.date
LEFT JOIN (SELECT {local_day('generated_at')} AS date, count(DISTINCT id) AS dq_failures_count FROM failures GROUP BY 1) f ON f.date = p.date
""",
    ("failures",),
    price_days=_price_days("crypto_prices", local_day("timestamp"), f"timestamp >= {day_start(90)}"),
)
def market_daily_view(t: Tables):
    return marts.market_daily_view(t.prices, t.news, t.weather, t.failure_marks, CLOCK)


@register("market_daily", "SELECT * FROM daily", DAILY_VIEWS, **DAILY)
def market_daily(t: Tables):
    return daily(t)


def _cents(column: str, digits: int) -> str:
    return f"sum(CAST({column} AS DECIMAL(20,{digits})))"


WEEKLY_SQL = f"""
SELECT CAST(date_trunc('week', date) AS DATE) AS week,
  {mean(_cents('btc_avg_price', 2), 'count(btc_avg_price)', 2, 2)} AS avg_btc_price,
  {mean(_cents('eth_avg_price', 2), 'count(eth_avg_price)', 2, 2)} AS avg_eth_price,
  {mean(_cents('avg_price_change', 2), 'count(avg_price_change)', 2, 2)} AS avg_market_change,
  CAST(sum(news_count) AS BIGINT) AS total_news,
  {mean(_cents('avg_temperature', 1), 'count(avg_temperature)', 1, 1)} AS avg_temperature
FROM daily WHERE date >= DATE '2024-01-31' - INTERVAL 90 DAY GROUP BY 1
"""


@register("weekly_summary", WEEKLY_SQL, DAILY_VIEWS, **DAILY)
def weekly_summary(t: Tables):
    return marts.weekly_summary(daily(t, 90), CLOCK)


def change_sql(measure: str) -> str:
    cents = "CAST(CAST({0} AS DECIMAL(20,2)) * 100 AS HUGEINT)"
    new, old = cents.replace("{0}", "btc_avg_price"), cents.replace("{0}", "prev_btc_price")
    return f"""
SELECT date, {measure}, btc_avg_price, prev_btc_price,
  CASE WHEN prev_btc_price <> 0 THEN
    sign(CAST(({new} - {old}) * sign({old}) AS DOUBLE)) * CAST((2 * abs({new} - {old}) * 10000 + abs({old})) // (2 * abs({old})) AS DOUBLE) / 100.0
  END AS btc_daily_pct_change
FROM (SELECT date, {measure}, btc_avg_price, lag(btc_avg_price) OVER (ORDER BY date) AS prev_btc_price
      FROM daily WHERE date >= DATE '2024-01-31' - INTERVAL 30 DAY)
"""


@register("news_correlation", change_sql("news_count"), DAILY_VIEWS, **DAILY)
def news_correlation(t: Tables):
    return marts.news_correlation(daily(t, 30), CLOCK)


@register("weather_correlation", change_sql("avg_temperature"), DAILY_VIEWS, **DAILY)
def weather_correlation(t: Tables):
    return marts.weather_correlation(daily(t, 30), CLOCK)


@register(
    "news_daily",
    f"""
SELECT {local_day('published_at')} AS date, count(*) AS article_count, CAST(NULL AS DOUBLE) AS avg_sentiment,
  CAST(NULL AS DOUBLE) AS min_sentiment, CAST(NULL AS DOUBLE) AS max_sentiment, 0 AS positive_count,
  0 AS negative_count, count(*) AS no_sentiment_count
FROM news_articles WHERE published_at >= {day_start(30)} GROUP BY 1
""",
    ("news_articles",),
)
def news_daily(t: Tables):
    return marts.news_daily(t.news, CLOCK)


def _absorbed(t: Tables) -> DayMart:
    """The mart after batches of several feeds, late rows, a replay and an expired day."""
    mart = DayMart(new_work_dir(t.spark, "day-mart"))
    half = F.col("timestamp") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    late = F.col("id") % 10 == 7  # of all days, they come after the rest
    batches = {
        "tickers-0": {"prices": t.prices.where(half & ~late)},
        "news-0": {"news": t.news},
        "weather-0": {"readings": t.weather},
        "tickers-1": {"prices": t.prices.where(~half & ~late)},
        "failures-0": {"insights": t.failure_marks},
        "tickers-2": {"prices": t.prices.where(late)},
    }
    for share, rows in [*batches.items(), ("tickers-1", batches["tickers-1"])]:
        mart.absorb(day_states.states_of(CLOCK, **rows), share)
    mart.expire(t.spark, date(2024, 1, 5))
    return mart


@register("incremental_market_daily", "SELECT * FROM daily WHERE date >= DATE '2024-01-05'", DAILY_VIEWS, **DAILY)
def incremental_market_daily(t: Tables):
    return _absorbed(t).read(t.spark)


@register("market_daily_from_states", "SELECT * FROM daily", DAILY_VIEWS, **DAILY)
def market_daily_from_states(t: Tables):
    """All states at once: the sources fold into one row per date without a join."""
    states = day_states.states_of(CLOCK, t.prices, t.news, t.weather, t.failure_marks)
    return day_states.daily_from_states(states)
