"""Check classes: each gives a validity column and, where possible, a repair column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.clock import Clock
from quotemill.functions.texts import not_blank
from quotemill.functions.times import instant_to_utc

# Fields whose out-of-range values are clamped; others are only flagged.
REPAIRABLE_FIELDS = {"humidity"}


class Check:
    """Extension point: subclass it and add the instance to a rule list.

    `valid` sees the schema of the rows as repaired so far. A NULL result counts as
    failed. `repair` returns the repaired value of `repairs`, or there is no repair.
    """

    name: str
    repairs: str | None = None

    def valid(self, schema: T.StructType, clock: Clock) -> Column:
        raise NotImplementedError

    def repair(self, schema: T.StructType) -> Column | None:
        return None


def _type_of(schema: T.StructType, field: str) -> T.DataType | None:
    return schema[field].dataType if field in schema.names else None


@dataclass(frozen=True)
class NotNullCheck(Check):
    """Present, not NULL, and not blank if it is text."""

    field: str

    @property
    def name(self) -> str:
        return f"NotNullCheck:{self.field}"

    def valid(self, schema, clock):
        kind = _type_of(schema, self.field)
        if kind is None:
            return F.lit(False)
        value = F.col(self.field)
        if isinstance(kind, T.StringType):
            return value.isNotNull() & not_blank(value)
        return value.isNotNull()


@dataclass(frozen=True)
class RangeCheck(Check):
    """Numeric and inside the bounds; NaN passes, since it compares false with any bound."""

    field: str
    min_val: float | None = None
    max_val: float | None = None
    exclusive_min: bool = False
    nullable: bool = False

    @property
    def name(self) -> str:
        return f"RangeCheck:{self.field}[{self.min_val},{self.max_val}]"

    @property
    def repairs(self) -> str | None:
        return self.field if self.field in REPAIRABLE_FIELDS else None

    def _number(self, kind: T.DataType) -> Column:
        value = F.col(self.field)
        if isinstance(kind, T.BooleanType):
            return value.cast("int").cast("double")
        if isinstance(kind, T.NumericType):
            return value.cast("double")
        if isinstance(kind, T.StringType):
            return value.try_cast("double")
        return F.lit(None).cast("double")

    def valid(self, schema, clock):
        kind = _type_of(schema, self.field)
        if kind is None:
            return F.lit(self.nullable)
        number = self._number(kind)
        bounds = []
        if self.min_val is not None:
            low = F.lit(float(self.min_val))
            bounds.append((number > low) if self.exclusive_min else (number >= low))
        if self.max_val is not None:
            below = number <= F.lit(float(self.max_val))
            # NaN sorts above every number here, so only the upper bound needs the exception.
            can_be_nan = isinstance(kind, (T.FloatType, T.DoubleType, T.StringType))
            bounds.append((below | F.isnan(number)) if can_be_nan else below)
        inside = reduce(and_, bounds) if bounds else number.isNotNull()
        if self.nullable:
            return F.col(self.field).isNull() | F.coalesce(inside, F.lit(False))
        return inside

    def repair(self, schema):
        kind = _type_of(schema, self.field)
        if self.repairs is None or kind is None:
            return None
        number = self._number(kind)
        fixed = number
        if self.max_val is not None:
            fixed = F.when(number > self.max_val, F.lit(float(self.max_val))).otherwise(fixed)
        if self.min_val is not None:
            fixed = F.when(number < self.min_val, F.lit(float(self.min_val))).otherwise(fixed)
        return F.when(number.isNull(), F.col(self.field)).otherwise(fixed.cast(kind))


@dataclass(frozen=True)
class UrlFormatCheck(Check):
    """Text that starts with http:// or https:// after leading white space."""

    field: str

    @property
    def name(self) -> str:
        return f"UrlFormatCheck:{self.field}"

    def valid(self, schema, clock):
        if not isinstance(_type_of(schema, self.field), T.StringType):
            return F.lit(False)
        return F.col(self.field).rlike(r"(?U)^\s*https?://")


@dataclass(frozen=True)
class FutureTimestampCheck(Check):
    """Not later than now plus some minutes; NULL and non-timestamps pass."""

    field: str
    max_future_minutes: int = 5

    @property
    def name(self) -> str:
        return f"FutureTimestampCheck:{self.field}"

    def valid(self, schema, clock):
        kind = _type_of(schema, self.field)
        limit = clock.ahead(minutes=self.max_future_minutes)
        value = F.col(self.field)
        if isinstance(kind, T.TimestampNTZType):
            return value.isNull() | (value <= limit)
        if isinstance(kind, T.TimestampType):
            return value.isNull() | (instant_to_utc(value) <= limit)
        return F.lit(True)


@dataclass(frozen=True)
class ExpressionCheck(Check):
    """A user rule given as a SQL condition over the columns of the row."""

    label: str
    sql: str

    @property
    def name(self) -> str:
        return f"ExpressionCheck:{self.label}"

    def valid(self, schema, clock):
        return F.expr(self.sql)
