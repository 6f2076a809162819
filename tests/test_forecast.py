"""Forecast against numpy least squares."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.operators import forecast
from quotemill.operators.joins import join_summary, settled


def series(spark, rows):
    values = [(i, s, float(p), t.isoformat(sep=" ")) for i, (s, p, t) in enumerate(rows)]
    df = spark.createDataFrame(values, "id bigint, symbol string, p double, t string")
    return df.select("id", "symbol", F.col("p").cast("decimal(18,8)").alias("price_usd"), F.col("t").cast("timestamp_ntz").alias("timestamp"))


def numpy_forecast(rows, hours, offset):
    """Least squares with standardised features, solved by the pseudo-inverse of the data matrix."""

    def features(times):
        out = []
        for t in times:
            local = t + offset
            h, d = 2 * np.pi * local.hour / 24, 2 * np.pi * local.weekday() / 7
            out.append([(t - datetime(1970, 1, 1)).total_seconds(), np.sin(h), np.cos(h), np.sin(d), np.cos(d)])
        return np.array(out)

    times, y = [t for _, _, t in rows], np.array([p for _, p, _ in rows], float)
    x = features(times)
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-12] = 1.0
    x = (x - mean) / std
    weights = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]
    fitted = (x - x.mean(0)) @ weights + y.mean()
    residual = np.abs(y - fitted)
    future = (features([times[-1] + timedelta(hours=i + 1) for i in range(hours)]) - mean) / std
    predicted = (future - x.mean(0)) @ weights + y.mean()
    return predicted, residual.mean(), 1.96 * residual.std()


WARSAW_SUMMER = timedelta(hours=2)


@pytest.mark.parametrize(
    "count, minutes, noise", [(24, 60, 0.0), (24, 60, 25.0), (300, 30, 40.0), (12, 5, 3.0), (60, 60, 10.0)]
)
def test_forecast_matches_numpy(spark, count, minutes, noise):
    start = datetime(2026, 4, 20)
    random = np.random.default_rng(3)
    rows = [("BTC", round(70000 + 100 * i + noise * random.normal(), 4), start + timedelta(minutes=minutes * i)) for i in range(count)]
    clock = Clock(rows[-1][2] + timedelta(minutes=1))
    points = forecast.forecast(series(spark, rows), clock, horizon_hours=6).points.orderBy("step").collect()
    used = [r for r in rows if r[2] >= clock.now - timedelta(days=7)]
    predicted, mae, band = numpy_forecast(used, 6, WARSAW_SUMMER)
    assert len(points) == 6 and points[0]["training_points"] == len(used)
    for point, want in zip(points, predicted):
        assert point["predicted_price"] == pytest.approx(want, abs=0.02)
        assert point["lower_bound"] == pytest.approx(max(0.0, want - band), abs=0.02)
        assert point["upper_bound"] == pytest.approx(want + band, abs=0.02)
        assert point["mae_usd"] == pytest.approx(mae, abs=0.02)
    assert points[0]["forecast_ts"] == rows[-1][2] + timedelta(hours=1)
    assert points[0]["last_known_price"] == pytest.approx(rows[-1][1], abs=0.006)


def test_planted_line_is_continued(spark):
    start = datetime(2026, 4, 20)
    rows = [("BTC", 70000 + 100 * i, start + timedelta(hours=i)) for i in range(160)]
    points = forecast.forecast(series(spark, rows), Clock(start + timedelta(hours=160)), 6).points.orderBy("step").collect()
    assert [p["predicted_price"] for p in points] == pytest.approx([86000 + 100 * i for i in range(6)], abs=0.05)
    assert points[0]["mae_usd"] == 0.0


def test_lower_bound_is_not_negative(spark):
    start = datetime(2026, 4, 20)
    rows = [("X", 0.01 + (i % 8 == 0) * 50, start + timedelta(hours=i)) for i in range(24)]
    points = forecast.forecast(series(spark, rows), Clock(start + timedelta(hours=24)), 3).points.collect()
    assert all(p["lower_bound"] == 0.0 for p in points)


@pytest.mark.parametrize("count", [5, 9])
def test_short_series_are_skipped_with_a_reason(spark, count):
    start = datetime(2026, 4, 20)
    rows = [("BTC", 1 + i, start + timedelta(hours=i)) for i in range(count)]
    rows += [("ETH", 1 + i, start + timedelta(hours=i)) for i in range(10)]
    result = forecast.forecast(series(spark, rows), Clock(start + timedelta(hours=24)))
    assert result.skipped.first()["reason"] == f"Insufficient data for BTC: only {count} rows available. Need at least 10."
    assert {r["symbol"] for r in result.points.collect()} == {"ETH"}
    nothing = forecast.forecast(series(spark, rows).filter("false"), Clock(start))
    assert nothing.points.count() == 0 and nothing.skipped.count() == 0


@pytest.mark.parametrize("hours", [0, 49, -1])
def test_horizon_guard(spark, tables, hours):
    with pytest.raises(ValueError):
        forecast.forecast(tables.prices, Clock(datetime(2024, 1, 31)), horizon_hours=hours)


def test_features(spark):
    rows = [("A", 1, datetime(2026, 4, 1, 10)), ("A", 1, datetime(2026, 4, 1, 11))]
    got = forecast.features(series(spark, rows), "Europe/Warsaw").orderBy("timestamp").collect()
    assert got[0]["unix"] == 1775037600.0
    assert got[0]["hour_sin"] == pytest.approx(0.0) and got[0]["hour_cos"] == pytest.approx(-1.0)
    assert got[0]["dow_sin"] == pytest.approx(np.sin(2 * np.pi * 2 / 7))


def test_join_summary_is_planned_by_measured_size(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 7 * (F.col("id") % 3 > 0).cast("int")).alias("k"))
    summary = settled(rows.groupBy("k").agg(F.count("*").alias("n")))
    small = join_summary(rows, summary, "k")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    expected = sorted(map(tuple, small.select("id", "k", "n").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        large = join_summary(rows, summary, "k")
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, large.select("id", "k", "n").collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_task_functions_load_without_the_package(tmp_path):
    """Executors need numpy, pandas and pyarrow, not this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from quotemill.operators import vectors

    for function in (forecast._solve, vectors._partition_top(None, None, None, 3)):
        (tmp_path / "f").write_bytes(cloudpickle.dumps(function))
        code = "from pyspark import cloudpickle; print(callable(cloudpickle.loads(open('f', 'rb').read())))"
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert done.stdout.strip() == "True", done.stderr
