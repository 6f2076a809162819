"""Run a rule list over a DataFrame: one narrow stage, rows flagged, never dropped."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quotemill.clock import Clock
from quotemill.operators.quality.checks import Check
from quotemill.operators.quality.rules import RULES

log = logging.getLogger(__name__)


@contextmanager
def _nulls_for_errors(spark: SparkSession) -> Iterator[None]:
    """Expressions resolved inside give NULL where they would fail on a row: x / 0, a bad cast.

    The mode is part of a resolved expression, so it holds when the plan runs later.
    """
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _with_flags(df: DataFrame, checks: dict[str, Check], clock: Clock) -> tuple[DataFrame, dict[str, Check]]:
    """The rows with one failure flag per check, and the checks that do not fit the schema."""
    if not checks:
        return df, {}
    try:
        schema = df.schema
        with _nulls_for_errors(df.sparkSession):
            flags = {mark: ~F.coalesce(check.valid(schema, clock), F.lit(False)) for mark, check in checks.items()}
            marked = df.withColumns(flags)
            marked.schema
        return marked, {}
    except AnalysisException as error:
        if len(checks) == 1:
            [check] = checks.values()
            log.warning("check %s cannot run: %s", check.name, str(error).splitlines()[0])
            return df, dict(checks)
    unfit: dict[str, Check] = {}
    for mark, check in checks.items():
        df, failed = _with_flags(df, {mark: check}, clock)
        unfit.update(failed)
    return df, unfit


def _stages(checks: Sequence[Check], fields: list[str]) -> list[dict[str, Check]]:
    """Checks grouped into projections: a new one starts after a check that can repair a field."""
    stages: list[dict[str, Check]] = [{}]
    for position, check in enumerate(checks):
        stages[-1][f"_bad_{position}"] = check
        if check.repairs in fields:
            stages.append({})
    return stages


def run_checks(
    df: DataFrame,
    table: str,
    clock: Clock,
    record_id: Column | None = None,
    rules: dict[str, list[Check]] | None = None,
) -> DataFrame:
    """The rows, repaired where a rule can repair them, with the report columns appended.

    Checks run in order and each sees the repairs of the earlier ones. A check that
    cannot be evaluated on this schema is reported as `name[ERROR]` for every row; a row on
    which a user's condition has no value (division by zero, a bad cast) fails that check.
    """
    checks: Sequence[Check] = (RULES if rules is None else rules).get(table, [])
    fields = df.columns
    current = df.withColumn("original_record", F.struct(*[F.col(f"`{c}`") for c in fields]))
    flags: list[tuple[str, Column]] = []
    for stage in _stages(checks, fields):
        current, unfit = _with_flags(current, stage, clock)
        for mark, check in stage.items():
            if mark in unfit:
                flags.append((f"{check.name}[ERROR]", F.lit(True)))
                continue
            flags.append((check.name, F.col(mark)))
            fixed = check.repair(current.schema)
            if fixed is not None:
                current = current.withColumn(
                    check.repairs, F.when(F.col(mark), fixed).otherwise(F.col(check.repairs))
                )
    failing = F.lit(False)
    for _, bad in flags:
        failing = failing | bad
    names = [F.when(bad, F.lit(name)) for name, bad in flags]
    # The flag is built from the conditions alone: filtering on it needs no list of names.
    report = current.withColumns(
        {
            "_failing": failing,
            "failed_checks": F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"),
        }
    )
    repaired_fields = {c.repairs for c in checks if c.repairs in fields}
    changed = F.lit(False)
    for name in sorted(repaired_fields):
        changed = changed | ~F.col(name).eqNullSafe(F.col("original_record")[name])
    return report.select(
        *[F.col(f"`{c}`") for c in fields],
        F.lit(table).alias("dq_table"),
        (~F.col("_failing")).alias("dq_passed"),
        "failed_checks",
        F.lit(len(checks)).alias("total_checks"),
        (changed & F.col("_failing")).alias("auto_repaired"),
        (record_id if record_id is not None else F.lit(None)).cast("string").alias("record_id"),
        "original_record",
        F.struct(*[F.col(f"`{c}`") for c in fields]).alias("fixed_record"),
        clock.now_column().alias("checked_at"),
    )


def cleaned(report: DataFrame) -> DataFrame:
    """The repaired rows without the report columns."""
    return report.select("fixed_record.*")


def run_totals(report: DataFrame) -> DataFrame:
    """Rows kept, failed and repaired of a run."""
    return report.groupBy("dq_table").agg(
        F.count("*").alias("rows_kept"),
        F.count_if(~F.col("dq_passed")).alias("dq_failures"),
        F.count_if("auto_repaired").alias("auto_repaired"),
    )


def check_totals(report: DataFrame) -> DataFrame:
    """Failures per table and check."""
    return report.select("dq_table", F.explode("failed_checks").alias("check_name")).groupBy(
        "dq_table", "check_name"
    ).agg(F.count("*").alias("failures"))


def summary_line(report: DataFrame) -> Column:
    """One line of text per report row."""
    names = F.concat(F.lit("['"), F.concat_ws("', '", report["failed_checks"]), F.lit("']"))
    head = F.concat(report["dq_table"], F.lit(" ["), F.coalesce(report["record_id"], F.lit("None")), F.lit("] — "))
    status = F.when(report["auto_repaired"], "🔧 naprawiono").otherwise("❌ nie naprawiono")
    return F.when(
        report["dq_passed"],
        F.concat(F.lit("✅ "), head, F.lit("wszystkie "), report["total_checks"].cast("string"), F.lit(" checks OK")),
    ).otherwise(F.concat(F.lit("⚠️  "), head, F.lit("FAILED: "), names, F.lit(" ("), status, F.lit(")")))


def observe_run(report: DataFrame, metrics: Observation) -> DataFrame:
    """Attach run metrics that are delivered with the action that writes the rows."""
    return report.observe(
        metrics,
        F.count("*").alias("rows"),
        F.count_if(~F.col("dq_passed")).alias("failures"),
        F.count_if("auto_repaired").alias("repaired"),
    )
