"""Linear price forecast of all symbols at once, with error bands.

The fit needs only 27 sums per symbol, which partial aggregation computes wherever the
rows are; the 5x5 solve then runs on one row per symbol. A symbol that holds most rows
is as cheap as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.times import epoch_micros, local_time, time_then_id
from quotemill.operators.joins import join_summary, settled

FEATURES = ["unix", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
MIN_ROWS = 10
MAX_HORIZON = 48
Z_95 = 1.96
SECONDS_PER_DAY = 86_400.0
COEFFICIENTS = [f"b_{name}" for name in FEATURES]
KEPT = ("symbol", "training_points", "last_ts", "last_price")


def training_window(prices: DataFrame, clock: Clock, days: int = 7) -> DataFrame:
    """Positive prices of the last days, every symbol."""
    wanted = (F.col("timestamp") >= clock.ago(days=days)) & (F.col("price_usd") > 0)
    return prices.filter(wanted).select("symbol", F.col("price_usd").cast("double").alias("price"), "timestamp", "id")


def _calendar(local: Column) -> dict[str, Column]:
    day = 2 * np.pi * F.hour(local) / 24
    week = 2 * np.pi * F.weekday(local) / 7
    return {"hour_sin": F.sin(day), "hour_cos": F.cos(day), "dow_sin": F.sin(week), "dow_cos": F.cos(week)}


def features(df: DataFrame, zone: str, column: str = "timestamp") -> DataFrame:
    """Unix seconds plus cyclic hour and weekday (Monday = 0) in the local zone."""
    local = local_time(column, zone)
    return df.withColumns({"unix": epoch_micros(F.col(column)) / 1_000_000.0, **_calendar(local)})


def _origin(clock: Clock) -> Column:
    return epoch_micros(clock.now_column()) / 1_000_000.0


def _centred(df: DataFrame, clock: Clock) -> DataFrame:
    """Unix time as days from now: large raw seconds would cost the sums their precision."""
    return df.withColumn("unix", (F.col("unix") - _origin(clock)) / SECONDS_PER_DAY)


def moments(train: DataFrame) -> DataFrame:
    """Row count, feature and price sums, cross products, and the last point per symbol."""
    sums = [F.sum(f).alias(f"s_{f}") for f in FEATURES]
    sums += [F.sum(F.col(f) * F.col("price")).alias(f"y_{f}") for f in FEATURES]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"m_{i}_{j}") for i, j in PAIRS]
    return train.groupBy("symbol").agg(
        F.count("*").alias("training_points"),
        F.sum("price").alias("s_price"),
        *sums,
        F.max("timestamp").alias("last_ts"),
        F.max_by("price", time_then_id(F.col("timestamp"), F.col("id"))).alias("last_price"),
    )


def scaler(train: DataFrame) -> DataFrame:
    """Mean and population deviation per symbol and feature; deviation 0 becomes 1."""
    aggregates = []
    for name in FEATURES:
        deviation = F.stddev_pop(name)
        aggregates += [
            F.avg(name).alias(f"mean_{name}"),
            F.coalesce(F.nullif(deviation, F.lit(0.0)), F.lit(1.0)).alias(f"scale_{name}"),
        ]
    return train.groupBy("symbol").agg(*aggregates)


def _solve(batches: Iterator[pd.DataFrame], kept: tuple[str, ...] = KEPT) -> Iterator[pd.DataFrame]:
    """Minimum-norm least squares of standardised features from the sums, one row per model."""
    size = len(FEATURES)
    for pdf in batches:
        n = pdf["training_points"].to_numpy(float)
        mean = pdf[[f"s_{f}" for f in FEATURES]].to_numpy(float) / n[:, None]
        mean_price = pdf["s_price"].to_numpy(float) / n
        second = np.empty((len(pdf), size, size))
        for i, j in PAIRS:
            second[:, i, j] = second[:, j, i] = pdf[f"m_{i}_{j}"].to_numpy(float) / n
        spread = second - mean[:, :, None] * mean[:, None, :]
        with_price = pdf[[f"y_{f}" for f in FEATURES]].to_numpy(float) / n[:, None] - mean * mean_price[:, None]
        variance = np.einsum("nii->ni", spread)
        constant = variance <= 1e-12 * np.maximum(1.0, np.einsum("nii->ni", second))
        scale = np.sqrt(np.where(constant, 1.0, variance))
        live = ~constant
        scaled = spread / (scale[:, :, None] * scale[:, None, :]) * (live[:, :, None] & live[:, None, :])
        weights = np.einsum(
            "nij,nj->ni", np.linalg.pinv(scaled, rcond=1e-10, hermitian=True), with_price / scale * live
        )
        slope = weights / scale
        out = pdf[list(kept)].copy()
        out["intercept"] = mean_price - (slope * mean).sum(axis=1)
        out[COEFFICIENTS] = slope
        yield out


def fit(train: DataFrame) -> DataFrame:
    """Coefficients per symbol."""
    schema = "symbol string, training_points bigint, last_ts timestamp_ntz, last_price double, intercept double, "
    schema += ", ".join(f"{c} double" for c in COEFFICIENTS)
    return moments(train).mapInPandas(_solve, schema)


def _predicted() -> Column:
    total = F.col("intercept")
    for name, coefficient in zip(FEATURES, COEFFICIENTS):
        total = total + F.col(name) * F.col(coefficient)
    return total


@dataclass(frozen=True)
class Forecast:
    """Forecast rows, and the symbols without enough rows with the reason."""

    points: DataFrame
    skipped: DataFrame


def forecast(prices: DataFrame, clock: Clock, horizon_hours: int = 24, days: int = 7) -> Forecast:
    """Hourly forecast for every symbol with at least ten training rows.

    The models, one row per symbol, are fitted at once (this call runs that job); residuals and
    forecasts are lazy. Of several last rows of the same time the one with the highest id counts.
    """
    if not 1 <= horizon_hours <= MAX_HORIZON:
        raise ValueError(f"horizon must be 1 to {MAX_HORIZON} hours")
    train = _centred(features(training_window(prices, clock, days), clock.zone), clock)
    models = settled(fit(train))
    enough = F.col("training_points") >= MIN_ROWS
    usable = models.filter(enough)
    residual = F.abs(F.col("price") - _predicted())
    errors = (
        join_summary(train, usable.select("symbol", "intercept", *COEFFICIENTS), "symbol")
        .groupBy("symbol")
        .agg(F.avg(residual).alias("mae"), F.stddev_pop(residual).alias("spread"))
    )
    # Future hours keep the UTC offset of the last point, as adding hours to an offset time does.
    local = local_time(F.col("last_ts"), clock.zone)
    ahead = F.make_dt_interval(F.lit(0), F.col("step"))
    steps = (
        usable.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon_hours))))
        .withColumn("forecast_ts", F.col("last_ts") + ahead)
        .withColumn("local_ts", local + ahead)
        .withColumn("unix", (epoch_micros(F.col("forecast_ts")) / 1_000_000.0 - _origin(clock)) / SECONDS_PER_DAY)
        .withColumns(_calendar(F.col("local_ts")))
        .withColumn("price", _predicted())
    )
    band = Z_95 * F.col("spread")
    points = steps.join(errors, "symbol").select(
        "symbol",
        F.lit("LinearRegression").alias("model"),
        "training_points",
        F.lit(horizon_hours).alias("horizon_hours"),
        "step",
        "forecast_ts",
        F.bround("price", 2).alias("predicted_price"),
        F.bround(F.greatest(F.lit(0.0), F.col("price") - band), 2).alias("lower_bound"),
        F.bround(F.col("price") + band, 2).alias("upper_bound"),
        F.bround("last_price", 2).alias("last_known_price"),
        F.bround("mae", 2).alias("mae_usd"),
    )
    skipped = models.filter(~enough).select(
        "symbol",
        "training_points",
        F.concat(
            F.lit("Insufficient data for "), F.col("symbol"), F.lit(": only "),
            F.col("training_points").cast("string"), F.lit(" rows available. Need at least 10."),
        ).alias("reason"),
    )
    return Forecast(points, skipped)


def actual_and_forecast(prices: DataFrame, points: DataFrame, clock: Clock, days: int = 7) -> DataFrame:
    """Actual series and forecast series in one frame."""
    actual = prices.filter(F.col("timestamp") >= clock.ago(days=days)).select(
        "symbol", "timestamp", F.col("price_usd").cast("double").alias("value"), F.lit("actual").alias("kind")
    )
    ahead = points.select(
        "symbol", F.col("forecast_ts").alias("timestamp"), F.col("predicted_price").alias("value"),
        F.lit("forecast").alias("kind"),
    )
    return actual.unionByName(ahead)
