"""Rolling-origin test of the forecast: fitted at many past moments, scored against what came.

The sums a fit needs are folded to one row per symbol and hour. A range window over these rows
gives the sums of the training days before every origin in one pass, so no price row is read once
per origin. Each price after an origin is then scored by the model of the last origin before it.
"""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.times import epoch_micros
from quotemill.operators.forecast import COEFFICIENTS, FEATURES, MIN_ROWS, PAIRS, _centred, _predicted, _solve, features
from quotemill.operators.joins import join_summary, settled

HOUR = 3_600_000_000
SUMS = ["training_points", "s_price", *[f"s_{f}" for f in FEATURES], *[f"y_{f}" for f in FEATURES], *[f"m_{i}_{j}" for i, j in PAIRS]]


def hourly_moments(rows: DataFrame) -> DataFrame:
    """(symbol, hour, sums) of rows with price and features; hours since 1970 in UTC."""
    values = {"training_points": F.lit(1), "s_price": F.col("price")}
    values |= {f"s_{f}": F.col(f) for f in FEATURES}
    values |= {f"y_{f}": F.col(f) * F.col("price") for f in FEATURES}
    values |= {f"m_{i}_{j}": F.col(FEATURES[i]) * F.col(FEATURES[j]) for i, j in PAIRS}
    return rows.groupBy("symbol", "hour").agg(*[F.sum(value).alias(name) for name, value in values.items()])


def rolling_models(hourly: DataFrame, every_hours: int, days: int, first: int, last: int) -> DataFrame:
    """(symbol, hour, training_points, s_price, coefficients): one fit per symbol and origin hour.

    Origins are the multiples of `every_hours` from hour `first` to `last`; each is fitted on the
    `days` before it, if they hold enough rows. The window's rows are one per symbol and hour.
    """
    origins = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(every_hours))).alias("hour")
    nothing = [F.lit(0).cast("bigint").alias(c) if c == "training_points" else F.lit(0.0).alias(c) for c in SUMS]
    symbols = hourly.select("symbol").distinct().select("symbol", origins)
    marks = symbols.select("symbol", F.col("hour").cast("bigint").alias("hour"), *nothing, F.lit(True).alias("origin"))
    both = hourly.select("symbol", "hour", *SUMS, F.lit(False).alias("origin")).unionByName(marks)
    before = Window.partitionBy("symbol").orderBy("hour").rangeBetween(-24 * days, -1)
    sums = both.select("symbol", "hour", "origin", *[F.sum(c).over(before).alias(c) for c in SUMS])
    wanted = sums.where(F.col("origin") & (F.col("training_points") >= MIN_ROWS)).drop("origin")
    schema = "symbol string, hour bigint, training_points bigint, s_price double, intercept double, "
    schema += ", ".join(f"{c} double" for c in COEFFICIENTS)
    return wanted.mapInPandas(partial(_solve, kept=("symbol", "hour", "training_points", "s_price")), schema)


def forecast_backtest(prices: DataFrame, clock: Clock, every_hours: int = 24, days: int = 7, back_days: int = 21) -> DataFrame:
    """(symbol, origin, training_points, scored, mae, bias, naive_mae) per symbol and origin.

    Origins lie every `every_hours` in the last `back_days` before now. Every positive price from
    an origin to the next (or now) is scored: mean absolute error, mean error, and the error of
    repeating the training mean for comparison. Origins with too few training rows, or without a
    price after them, have no row. Models, one row per symbol and origin, are stored once.
    """
    start = clock.ago(days=days + back_days)
    wanted = (F.col("timestamp") >= start) & (F.col("timestamp") <= clock.now_column()) & (F.col("price_usd") > 0)
    rows = prices.where(wanted).select("symbol", F.col("price_usd").cast("double").alias("price"), "timestamp")
    hour = F.floor(epoch_micros(F.col("timestamp")) / HOUR).cast("bigint")
    rows = _centred(features(rows, clock.zone), clock).withColumn("hour", hour)
    now = int((clock.now - datetime(1970, 1, 1)).total_seconds() // 3600)
    first = -(-(now - 24 * back_days) // every_hours) * every_hours
    last = now // every_hours * every_hours
    models = rolling_models(hourly_moments(rows), every_hours, days, first, last)
    models = settled(models.withColumns({"key": F.struct("symbol", "hour"), "mean_price": F.col("s_price") / F.col("training_points")}))
    origin = (F.floor(F.col("hour") / every_hours) * every_hours).cast("bigint")
    scored = rows.where(F.col("hour") >= first).withColumn("key", F.struct("symbol", origin.alias("hour")))
    scored = join_summary(scored.drop("symbol", "hour"), models.drop("symbol", "hour", "s_price"), "key")
    error = F.col("price") - _predicted()
    by_model = scored.groupBy("key", "training_points").agg(
        F.count("*").alias("scored"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"),
        F.avg(F.abs(F.col("price") - F.col("mean_price"))).alias("naive_mae"),
    )
    began = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("key.hour").cast("int"))
    return by_model.select(F.col("key.symbol").alias("symbol"), began.alias("origin"), "training_points", "scored", "mae", "bias", "naive_mae")
