"""The daily mart kept up to date batch by batch from stored day states.

    states/date=D/share=S     what batch S adds to day D
    shares/share=S            the days of batch S
    mart/version=V            one row per day; `mart-versions` names the newest whole version

A batch reads and rewrites the states of its own days only. Absorbing it again replaces its
shares, also where it now has other days; days it touches are computed again from all their
shares, all other days are taken over from the mart's last version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.joins import settled
from quotemill.plans.day_states import STATE, as_states, daily_from_states, merged
from quotemill.sources import sinks


@dataclass(frozen=True)
class DayMart:
    """States, shares and mart below `root`; `build` makes mart rows (with `date`) of states."""

    root: str
    build: Callable[[DataFrame], DataFrame] = daily_from_states

    def absorb(self, states: DataFrame, share: str) -> list[date | None]:
        """Store the states of one batch, named uniquely among all feeds, and refresh its days.

        Returns the days that were computed again. A crash leaves the record of all days
        concerned, so absorbing the batch once more mends what is half written.
        """
        spark = states.sparkSession
        states = settled(merged(states))
        own = self._days(states)
        known = self._days_of(spark, share)
        touched = sorted({*own, *known}, key=lambda d: (d is None, d or date.min))
        if touched != known:
            self._record(spark, share, touched)
        shared = states.withColumn("share", F.lit(share)).repartition("date")
        writer = shared.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("date", "share").parquet(f"{self.root}/states")
        for day in set(touched) - set(own):
            sinks.delete_folder(spark, f"{self.root}/states/{_folder(day)}/share={share}")
        self.refresh(spark, touched)
        if len(own) < len(touched):
            self._record(spark, share, own)
        return touched

    def refresh(self, spark: SparkSession, days: list[date | None]) -> None:
        """Compute the given days again from their states and publish the mart."""
        fresh = self.build(self.states(spark, days))
        path = f"{self.root}/mart"
        version = sinks.newest_version(spark, path)
        if version is not None:
            kept = sinks.read_mart(spark, path, version).where(~_on_days(days))
            fresh = kept.unionByName(fresh)
        sinks.publish_mart(fresh.coalesce(1), path, (version or 0) + 1)  # one row per day

    def expire(self, spark: SparkSession, oldest: date) -> None:
        """Forget the days before `oldest`: their folders and their mart rows."""
        sinks.drop_old_days(spark, f"{self.root}/states", oldest)
        path = f"{self.root}/mart"
        version = sinks.newest_version(spark, path)
        if version is not None:
            kept = sinks.read_mart(spark, path).where((F.col("date") >= F.lit(oldest)) | F.col("date").isNull())
            sinks.publish_mart(settled(kept).coalesce(1), path, version + 1)

    def states(self, spark: SparkSession, days: list[date | None]) -> DataFrame:
        """The stored states of some days; the folders of other days are not read."""
        stored = spark.read.schema(f"{STATE}, share STRING").option("basePath", f"{self.root}/states")
        folders = [f"{self.root}/states/{_folder(day)}" for day in days]
        folders = [f for f in folders if sinks.folder_exists(spark, f)]
        if not folders:
            return spark.createDataFrame([], STATE)
        return as_states(stored.parquet(*folders))

    def read(self, spark: SparkSession) -> DataFrame:
        return sinks.read_mart(spark, f"{self.root}/mart")

    def _days(self, states: DataFrame) -> list[date | None]:
        return [r["date"] for r in states.select("date").distinct().collect()]

    def _days_of(self, spark: SparkSession, share: str) -> list[date | None]:
        path = f"{self.root}/shares/share={share}"
        if not sinks.folder_exists(spark, path):
            return []
        return sorted(self._days(spark.read.schema("date DATE").parquet(path)), key=lambda d: (d is None, d or date.min))

    def _record(self, spark: SparkSession, share: str, days: list[date | None]) -> None:
        rows = spark.createDataFrame([(d,) for d in days], "date DATE").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.root}/shares/share={share}")


def _folder(day: date | None) -> str:
    return f"date={'__HIVE_DEFAULT_PARTITION__' if day is None else day.isoformat()}"


def _on_days(days: list[date | None]):
    known = F.col("date").isin([d for d in days if d is not None])
    return F.when(F.col("date").isNull(), F.lit(None in days)).otherwise(known)
