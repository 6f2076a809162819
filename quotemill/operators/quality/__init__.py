"""Declarative record checks, repairs, failure log and reports."""

from quotemill.operators.quality.checks import (
    Check,
    ExpressionCheck,
    FutureTimestampCheck,
    NotNullCheck,
    RangeCheck,
    UrlFormatCheck,
)
from quotemill.operators.quality.rules import RULES
from quotemill.operators.quality.run import cleaned, observe_run, run_checks, run_totals, summary_line

__all__ = [
    "Check", "ExpressionCheck", "FutureTimestampCheck", "NotNullCheck", "RangeCheck", "UrlFormatCheck",
    "RULES", "cleaned", "observe_run", "run_checks", "run_totals", "summary_line",
]
