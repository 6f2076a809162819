"""Forecast: features, scaling, fit, error bands."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.operators import backtest, forecast
from registry.tables import CLOCK, Tables, local_clock, register

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
NAMES = ["unix", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
SIZE = range(len(NAMES))

_ANGLE = {
    "hour_sin": "sin(2 * pi() * hour(local) / 24)", "hour_cos": "cos(2 * pi() * hour(local) / 24)",
    "dow_sin": "sin(2 * pi() * (isodow(local) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(local) - 1) / 7)",
}
_CALENDAR = ", ".join(f"{sql} AS {name}" for name, sql in _ANGLE.items())
TRAIN = (
    f"SELECT symbol, CAST(price_usd AS DOUBLE) AS price, timestamp, id, {local_clock('timestamp')} AS local FROM crypto_prices "
    f"WHERE timestamp >= {AS_OF} - INTERVAL 7 DAY AND price_usd > 0"
)
FEATURES = f"SELECT symbol, price, timestamp, epoch_us(timestamp) / 1000000.0 AS unix, {_CALENDAR} FROM train"


@register("forecast_training", "SELECT symbol, price, timestamp FROM train", ("crypto_prices",), train=TRAIN)
def forecast_training(t: Tables):
    return forecast.training_window(t.prices, CLOCK).drop("id")


_ROUNDED = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in NAMES)


@register("forecast_features", f"SELECT symbol, timestamp, {_ROUNDED} FROM features", ("crypto_prices",), train=TRAIN, features=FEATURES)
def forecast_features(t: Tables):
    rows = forecast.features(forecast.training_window(t.prices, CLOCK), CLOCK.zone)
    return rows.select("symbol", "timestamp", *[(F.round(n, 6) + 0.0).alias(n) for n in NAMES])


@register(
    "forecast_scaler",
    "SELECT symbol, "
    + ", ".join(f"round(avg({n}), 4) + 0.0 AS mean_{n}, round(coalesce(nullif(stddev_pop({n}), 0), 1), 4) AS scale_{n}" for n in NAMES)
    + " FROM features GROUP BY symbol",
    ("crypto_prices",),
    train=TRAIN,
    features=FEATURES,
)
def forecast_scaler(t: Tables):
    rows = forecast.features(forecast.training_window(t.prices, CLOCK), CLOCK.zone)
    scaled = forecast.scaler(rows)
    return scaled.select("symbol", *[(F.round(c, 4) + 0.0).alias(c) for c in scaled.columns if c != "symbol"])


def _solved_sql() -> dict[str, str]:
    """Least squares by elimination, one step per variable, one row per symbol."""
    centre = ", ".join(f"avg({n}) AS m{i}" for i, n in enumerate(NAMES))
    stats = f"SELECT symbol, count(*) AS n, avg(price) AS mp, {centre} FROM days GROUP BY symbol"
    cells = [f"avg(({NAMES[i]} - m{i}) * ({NAMES[j]} - m{j})) AS a{i}{j}" for i in SIZE for j in SIZE]
    cells += [f"avg(({NAMES[i]} - m{i}) * (price - mp)) AS b{i}" for i in SIZE]
    out = {
        "train": TRAIN,
        "features": FEATURES,
        "days": f"SELECT * REPLACE ((unix - epoch_us({AS_OF}) / 1000000.0) / 86400.0 AS unix) FROM features",
        "stats": stats,
        "step0": f"SELECT symbol, {', '.join(cells)} FROM days JOIN stats USING (symbol) GROUP BY symbol",
    }
    for k in SIZE:
        columns = []
        for i in SIZE:
            for j in SIZE:
                columns.append(f"a{i}{j}" if i == k else f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}")
            columns.append(f"b{i}" if i == k else f"b{i} - a{i}{k} / a{k}{k} * b{k} AS b{i}")
        out[f"step{k + 1}"] = f"SELECT symbol, {', '.join(columns)} FROM step{k}"
    slopes = ", ".join(f"b{i} / a{i}{i} AS w{i}" for i in SIZE)
    weights = " - ".join(["mp", *[f"b{i} / a{i}{i} * m{i}" for i in SIZE]])
    out["model"] = f"SELECT symbol, {slopes}, {weights} AS w FROM step5 JOIN stats USING (symbol)"
    fitted = " + ".join(["w", *[f"w{i} * {NAMES[i]}" for i in SIZE]])
    out["errors"] = (
        f"SELECT symbol, avg(abs(price - ({fitted}))) AS mae, stddev_pop(abs(price - ({fitted}))) AS spread "
        "FROM days JOIN model USING (symbol) GROUP BY symbol"
    )
    out["last_row"] = (
        "SELECT symbol, count(*) AS training_points, max(timestamp) AS last_ts, max(local) AS last_local, "
        "arg_max(price, (timestamp, id)) AS last_price FROM train GROUP BY symbol"
    )
    out["ahead"] = (
        f"SELECT *, (epoch_us(forecast_ts) - epoch_us({AS_OF})) / 86400000000.0 AS unix, {_CALENDAR} FROM ("
        "SELECT symbol, training_points, last_price, step, last_ts + to_hours(step) AS forecast_ts, last_local + to_hours(step) AS local "
        "FROM last_row, (SELECT unnest(range(1, 25)) AS step))"
    )
    out["points"] = (
        f"SELECT *, {fitted} AS p FROM ahead JOIN model USING (symbol) JOIN errors USING (symbol)"
    )
    return out


SOLVED = _solved_sql()


@register(
    "forecast_points",
    """
SELECT symbol, 'LinearRegression' AS model, training_points, 24 AS horizon_hours, CAST(step AS INT) AS step, forecast_ts,
  round(p, 2) AS predicted_price, round(greatest(0.0, p - 1.96 * spread), 2) AS lower_bound, round(p + 1.96 * spread, 2) AS upper_bound,
  round(last_price, 2) AS last_known_price, round(mae, 2) AS mae_usd FROM points
""",
    ("crypto_prices",),
    **SOLVED,
)
def forecast_points(t: Tables):
    return forecast.forecast(t.prices, CLOCK).points


@register(
    "forecast_next_hours",
    "SELECT symbol, CAST(step AS INT) AS step, round(p, 2) AS predicted_price FROM points WHERE step <= 6",
    ("crypto_prices",),
    **SOLVED,
)
def forecast_next_hours(t: Tables):
    points = forecast.forecast(t.prices, CLOCK, horizon_hours=48).points
    return points.filter(F.col("step") <= 6).select("symbol", "step", "predicted_price")


@register(
    "forecast_skipped",
    """
SELECT symbol, count(*) AS training_points, 'Insufficient data for ' || symbol || ': only ' || count(*) || ' rows available. Need at least 10.' AS reason
FROM crypto_prices WHERE timestamp >= TIMESTAMP '2024-01-30 22:00:00' AND price_usd > 0 GROUP BY symbol HAVING count(*) < 10
""",
    ("crypto_prices",),
)
def forecast_skipped(t: Tables):
    return forecast.forecast(t.prices, Clock(datetime(2024, 2, 6, 22))).skipped


@register(
    "actual_and_forecast",
    f"""
SELECT symbol, timestamp, CAST(price_usd AS DOUBLE) AS value, 'actual' AS kind FROM crypto_prices WHERE timestamp >= {AS_OF} - INTERVAL 7 DAY
UNION ALL SELECT symbol, forecast_ts, round(p, 2), 'forecast' FROM points
""",
    ("crypto_prices",),
    **SOLVED,
)
def actual_and_forecast(t: Tables):
    points = forecast.forecast(t.prices, CLOCK).points
    return forecast.actual_and_forecast(t.prices, points, CLOCK)


def _backtest_sql() -> dict[str, str]:
    """The fits of every origin by elimination, from the price rows of the days before it."""
    out = {
        "rows": "SELECT symbol, CAST(price_usd AS DOUBLE) AS price, timestamp, " + local_clock("timestamp") + " AS local FROM crypto_prices "
                f"WHERE timestamp >= {AS_OF} - INTERVAL 28 DAY AND timestamp <= {AS_OF} AND price_usd > 0",
        "days": f"SELECT symbol, price, timestamp, (epoch_us(timestamp) - epoch_us({AS_OF})) / 86400000000.0 AS unix, {_CALENDAR} FROM rows",
        "origins": f"SELECT unnest(generate_series({AS_OF} - INTERVAL 21 DAY, {AS_OF}, INTERVAL 1 DAY)) AS origin",
        "trained": "SELECT * FROM days JOIN origins ON timestamp >= origin - INTERVAL 7 DAY AND timestamp < origin",
    }
    centre = ", ".join(f"avg({n}) AS m{i}" for i, n in enumerate(NAMES))
    out["stats"] = f"SELECT symbol, origin, count(*) AS n, avg(price) AS mp, {centre} FROM trained GROUP BY symbol, origin HAVING count(*) >= 10"
    cells = [f"avg(({NAMES[i]} - m{i}) * ({NAMES[j]} - m{j})) AS a{i}{j}" for i in SIZE for j in SIZE]
    cells += [f"avg(({NAMES[i]} - m{i}) * (price - mp)) AS b{i}" for i in SIZE]
    out["step0"] = f"SELECT symbol, origin, {', '.join(cells)} FROM trained JOIN stats USING (symbol, origin) GROUP BY symbol, origin"
    for k in SIZE:
        columns = []
        for i in SIZE:
            for j in SIZE:
                columns.append(f"a{i}{j}" if i == k else f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}")
            columns.append(f"b{i}" if i == k else f"b{i} - a{i}{k} / a{k}{k} * b{k} AS b{i}")
        out[f"step{k + 1}"] = f"SELECT symbol, origin, {', '.join(columns)} FROM step{k}"
    slopes = ", ".join(f"b{i} / a{i}{i} AS w{i}" for i in SIZE)
    weights = " - ".join(["mp", *[f"b{i} / a{i}{i} * m{i}" for i in SIZE]])
    out["model"] = f"SELECT symbol, origin, n, mp, {slopes}, {weights} AS w FROM step5 JOIN stats USING (symbol, origin)"
    fitted = " + ".join(["w", *[f"w{i} * {NAMES[i]}" for i in SIZE]])
    out["scored"] = (
        f"SELECT symbol, origin, n, price - ({fitted}) AS error, abs(price - mp) AS naive FROM days "
        "JOIN model USING (symbol) WHERE timestamp >= origin AND timestamp < origin + INTERVAL 1 DAY"
    )
    return out


@register(
    "forecast_backtest",
    "SELECT symbol, origin, n AS training_points, count(*) AS scored, round(avg(abs(error)), 3) AS mae, round(avg(error), 3) + 0.0 AS bias, "
    "round(avg(naive), 3) AS naive_mae FROM scored GROUP BY ALL",
    ("crypto_prices",),
    **_backtest_sql(),
)
def forecast_backtest(t: Tables):
    found = backtest.forecast_backtest(t.prices, CLOCK)
    return found.withColumns({"mae": F.round("mae", 3), "bias": F.round("bias", 3) + 0.0, "naive_mae": F.round("naive_mae", 3)})
