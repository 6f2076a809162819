"""Time columns. Event times are TIMESTAMP_NTZ columns holding UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_utc_ntz(df: DataFrame, name: str) -> DataFrame:
    """Turn a zoned TIMESTAMP column into its UTC wall time; an NTZ column stays as it is."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return df.withColumn(name, instant_to_utc(F.col(name)))
    return df


def instant_to_utc(col: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))


def utc_to_instant(col: Column) -> Column:
    """UTC wall time to a zoned TIMESTAMP, whatever the session zone is (watermarks need it)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col).cast("timestamp")


def local_time(col: Column | str, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(col) if isinstance(col, str) else col)


def local_date(col: Column | str, zone: str) -> Column:
    return F.to_date(local_time(col, zone))


def epoch_micros(col: Column) -> Column:
    """Microseconds since 1970 of a UTC wall time, independent of the session zone."""
    return F.unix_micros(utc_to_instant(col))


def time_then_id(time: Column, row_id: Column) -> Column:
    """One decimal that orders by time, then id; unlike a struct it fits a hash aggregate's buffer."""
    step = F.lit(str(2**64)).cast("decimal(20,0)")
    return epoch_micros(time).cast("decimal(18,0)") * step + F.coalesce(row_id, F.lit(0)).cast("decimal(20,0)")


def minutes_between(later: Column, earlier: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(60_000_000.0)


def parse_feed_time(text: Column, zone: str) -> Column:
    """RFC-822 or ISO text to a UTC wall time; unreadable text gives NULL.

    ISO text without an offset is read in the local zone, as the database did.
    """
    clean = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    named = F.try_to_timestamp(clean, F.lit("d MMM yyyy HH:mm:ss z"))
    offset = F.try_to_timestamp(clean, F.lit("d MMM yyyy HH:mm:ss Z"))
    has_zone = clean.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    iso_zoned = F.when(has_zone, clean.try_cast("timestamp"))
    iso_local = F.when(~has_zone, clean.try_cast("timestamp_ntz"))
    return F.coalesce(
        instant_to_utc(F.coalesce(named, offset, iso_zoned)),
        F.convert_timezone(F.lit(zone), F.lit("UTC"), iso_local),
    )
