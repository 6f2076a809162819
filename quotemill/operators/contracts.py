"""Dataset contracts: uniqueness, required columns, accepted values, lengths, freshness."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.functions.times import minutes_between
from quotemill.sources.schemas import SOURCES


@dataclass(frozen=True)
class Contract:
    """What must hold for a table."""

    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    accepted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)


# Contracts of the marts.
CHECKED_TABLES = ("crypto_prices", "weather_data", "news_articles")
MART_CONTRACTS = {
    "mart_market_daily": Contract(unique=(("date",),), not_null=("date", "btc_avg_price", "news_count")),
    "mart_dq_failures": Contract(
        not_null=("date",), accepted={"table_name": CHECKED_TABLES, "auto_repaired": ("true", "false")}
    ),
    "mart_weekly_summary": Contract(unique=(("week",),), not_null=("week", "total_news")),
    "mart_news_correlation": Contract(unique=(("date",),), not_null=("date", "news_count")),
    "mart_dq_trend": Contract(not_null=("date",), accepted={"table_name": CHECKED_TABLES}),
    "mart_weather_crypto_correlation": Contract(unique=(("date",),), not_null=("date",)),
}
WARN_MINUTES, ERROR_MINUTES = 10, 20


def source_contract(table: str) -> Contract:
    """The constraints the DDL of a raw table states."""
    source = SOURCES[table]
    return Contract(unique=source.unique, not_null=source.not_null, max_length=source.max_length)


def _row_tests(contract: Contract) -> dict[str, Column]:
    tests: dict[str, Column] = {}
    for name in contract.not_null:
        tests[f"not_null:{name}"] = F.col(name).isNull()
    for name, values in contract.accepted.items():
        tests[f"accepted_values:{name}"] = F.col(name).isNotNull() & ~F.col(name).isin(list(values))
    for name, size in contract.max_length.items():
        tests[f"max_length:{name}"] = F.length(name) > size
    return tests


def failing_rows(df: DataFrame, table: str, contract: Contract) -> DataFrame:
    """(table_name, test, failing_rows): row tests in one pass, one aggregation per unique key.

    A unique key fails once per duplicated value; keys with a NULL never conflict.
    """
    out = None
    tests = _row_tests(contract)
    if tests:
        names = list(tests)
        counts = df.agg(*[F.count_if(F.coalesce(tests[n], F.lit(False))).alias(f"t{i}") for i, n in enumerate(names)])
        pairs = [F.struct(F.lit(n).alias("test"), F.col(f"t{i}").alias("failing_rows")) for i, n in enumerate(names)]
        out = counts.select(F.inline(F.array(*pairs)))
    for key in contract.unique:
        groups = df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n"))
        duplicates = groups.agg(F.count_if(F.col("n") > 1).alias("failing_rows")).select(
            F.lit(f"unique:{','.join(key)}").alias("test"), "failing_rows"
        )
        out = duplicates if out is None else out.unionByName(duplicates)
    return out.select(F.lit(table).alias("table_name"), "test", "failing_rows")


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """The rows that break a row test, with the names of the tests."""
    tests = _row_tests(contract)
    broken = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def source_freshness(
    df: DataFrame, table: str, loaded_at: str, clock: Clock, warn: int = WARN_MINUTES, error: int = ERROR_MINUTES
) -> DataFrame:
    """pass, warn or error by the age of the newest row."""
    last = df.agg(F.max(loaded_at).alias("max_loaded_at"))
    age = minutes_between(clock.now_column(), F.col("max_loaded_at"))
    status = F.when(F.col("max_loaded_at").isNull() | (age > error), "error").when(age > warn, "warn").otherwise("pass")
    return last.select(
        F.lit(table).alias("table_name"), "max_loaded_at", age.alias("age_minutes"), status.alias("status")
    )
