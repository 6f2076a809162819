"""Stems, tones, weather codes, time parsing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quotemill.functions import numbers, texts, times, weather

# Words of the published sample vocabulary of the stemmer with their stems.
SAMPLE = """
consign consign|consigned consign|consignment consign|consistency consist|consistently consist|consolation consol
consolatory consolatori|consoled consol|consolidating consolid|consolingly consol|conspicuously conspicu
conspiracy conspiraci|conspirators conspir|constables constabl|constancy constanc|knackeries knackeri|knavish knavish
kneeled kneel|knightly knight|knitted knit|knives knive|knocker knocker|generates generat|generously generous
communism communism|hopping hop|hoping hope|happy happi|say say|by by|cry cri|ties tie|cries cri|gas gas|this this
kiwis kiwi|luxuriated luxuri|agreed agre|feed feed|plastered plaster|bled bled|sing sing|conflated conflat|sized size
hissing hiss|fizzed fizz|filing file|relational relat|conditional condit|valenci valenc|digitizer digit|radically radic
vilely vile|analogously analog|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|callousness callous
formality formal|sensitivity sensit|sensibility sensibl|triplicate triplic|formative format|electrical electr
goodness good|revival reviv|inference infer|adjustable adjust|irritant irrit|replacement replac|adoption adopt
probate probat|rate rate|cease ceas|controll control|roll roll|skies sky|dying die|news news|innings inning
proceeded proceed|inflation inflat|markets market|rises rise|youth youth|boyish boyish|fluently fluentli
"""


def test_stems(spark):
    pairs = [tuple(p.split()) for line in SAMPLE.strip().splitlines() for p in line.split("|")]
    df = spark.createDataFrame(pairs, "token string, want string").withColumn("got", texts.stem(F.col("token")))
    assert df.filter(F.col("got") != F.col("want")).collect() == []


@pytest.mark.parametrize(
    "title, tone",
    [("Oil supply tight", "POS"), ("Markets FALL", "NEG"), ("Gains wiped, shares drop", "POS"), ("Calm", "NEU"), (None, "NEU")],
)
def test_headline_tone(spark, title, tone):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(texts.headline_tone(F.col("t"))).first()[0] == tone


@pytest.mark.parametrize(
    "code, short, full", [(0, "clear sky", "clear sky"), (48, "unknown", "icy fog"), (7, "unknown", "unknown"), (None, "unknown", "unknown")]
)
def test_weather_codes(spark, code, short, full):
    df = spark.createDataFrame([(code,)], "c int")
    got = df.select(weather.condition_text(F.col("c")), weather.condition_text(F.col("c"), weather.FULL_CODES)).first()
    assert tuple(got) == (short, full)
    assert len(weather.SHORT_CODES) == 12 and len(weather.FULL_CODES) == 19


def test_gauges_keep_null_and_clamp(spark):
    df = spark.createDataFrame([(None,), (-30.0,), (10.0,), (50.0,)], "t double")
    got = [r[0] for r in df.select(weather.temperature_gauge(F.col("t"))).collect()]
    assert got == [None, 0.0, 50.0, 100.0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mon, 01 Jan 2024 12:00:00 GMT", datetime(2024, 1, 1, 12)),
        ("01 Jan 2024 12:00:00 +0200", datetime(2024, 1, 1, 10)),
        ("Tue, 2 Jul 2024 08:05:00 GMT", datetime(2024, 7, 2, 8, 5)),
        ("2024-01-01T12:00:00Z", datetime(2024, 1, 1, 12)),
        ("2024-07-01T12:00:00+02:00", datetime(2024, 7, 1, 10)),
        ("2024-07-01T12:00:00", datetime(2024, 7, 1, 10)),
        ("yesterday", None),
        (None, None),
    ],
)
@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_feed_times(spark, text, want, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame([(text,)], "s string")
        assert df.select(times.parse_feed_time(F.col("s"), "Europe/Warsaw")).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("utc, local", [("2024-01-30 23:30:00", "2024-01-31"), ("2024-07-01 21:59:00", "2024-07-01"), ("2024-07-01 22:00:00", "2024-07-02")])
def test_local_date(spark, utc, local):
    df = spark.createDataFrame([(utc,)], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    assert str(df.select(times.local_date("t", "Europe/Warsaw")).first()[0]) == local


def test_exact_average_rounds_the_true_mean(spark):
    """0.0049999.. must not become 0.01 through an intermediate rounding."""
    df = spark.sql("SELECT CAST(x AS DECIMAL(10,2)) AS x FROM VALUES (0.01), (0.01), (0.01), (0.00), (0.00), (0.00), (0.00) t(x)")
    assert str(df.select(F.round(numbers.exact_avg(F.sum("x"), F.count("x")), 2)).first()[0]) == "0.00"
    assert df.filter("x > 5").select(numbers.exact_avg(F.sum("x"), F.count("x"))).first()[0] is None
