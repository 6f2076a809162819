"""The fixed evaluation time that stands for "now" in every time-dependent operator."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "Europe/Warsaw"


def _utc_naive(moment: datetime) -> datetime:
    if moment.tzinfo is None:
        return moment
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Clock:
    """`as_of` is a UTC instant (naive = UTC); `zone` gives the local calendar.

    All bounds are computed once on the driver, so they reach the scan as plain
    literals and are pushed down to parquet.
    """

    as_of: datetime
    zone: str = MARKET_ZONE

    @property
    def now(self) -> datetime:
        return _utc_naive(self.as_of)

    @property
    def today(self) -> date:
        return self.now.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(self.zone)).date()

    def midnight(self, day: date) -> datetime:
        """UTC instant at which `day` starts in the local zone."""
        return _utc_naive(datetime.combine(day, time.min, tzinfo=ZoneInfo(self.zone)))

    def now_column(self) -> Column:
        return instant(self.now)

    def ago(self, **span: int) -> Column:
        """`now` minus a timedelta given as keywords (days, hours, minutes)."""
        return instant(self.now - timedelta(**span))

    def ahead(self, **span: int) -> Column:
        return instant(self.now + timedelta(**span))

    def day_start(self, days_back: int = 0) -> Column:
        """Local midnight `days_back` days before today, as a UTC instant."""
        return instant(self.midnight(self.today - timedelta(days=days_back)))

    def day(self, days_back: int = 0) -> Column:
        """Local calendar date `days_back` days before today."""
        return F.lit(self.today - timedelta(days=days_back))


def live_clock(zone: str = MARKET_ZONE) -> Clock:
    """The clock of a running job; reports and tests pass a fixed one."""
    return Clock(datetime.now(timezone.utc), zone)


def instant(moment: datetime) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
