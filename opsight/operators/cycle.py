"""The signal stream: fourteen signal plans with one output shape, appended as a snapshot per cycle.

A registry maps signal names to plans; a cycle runs them all in one job, scores the rows, sets each against the signal's
previous snapshot and appends them to the snapshot table. A cycle is one folder of the table, named by its number, so a cycle that is run
again replaces its own rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import fixed, ladder, rnd
from .leading import score_signals

SNAPSHOT = "signal_name string, numeric_value double, snapshot_time timestamp, status string, trend string, direction string"


def signal_rows(plans: dict[str, Callable[..., DataFrame]], source, at: Column) -> DataFrame:
    """(signal_name, numeric_value, snapshot_time): each plan's value at `at`; a plan without a row gives a null value."""
    out = None
    for name, plan in plans.items():
        value = plan(source).agg(F.max(F.col("numeric_value").cast("double")).alias("numeric_value"))
        row = value.select(F.lit(name).alias("signal_name"), "numeric_value", at.alias("snapshot_time"))
        out = row if out is None else out.unionByName(row)
    return out


def against_previous(rows: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Adds trend ('+0.5') and direction of each signal against its previous snapshot."""
    if previous is None:
        return rows.withColumn("trend", F.lit(None).cast("string")).withColumn("direction", F.lit("flat"))
    j = rows.join(previous.select("signal_name", F.col("numeric_value").alias("_before")), "signal_name", "left")
    d = rnd(F.col("numeric_value") - F.col("_before"), 9)
    trend = F.when(d >= 0, F.concat(F.lit("+"), fixed(d, 1))).otherwise(fixed(d, 1))
    return (j.withColumn("trend", F.when(d.isNotNull(), trend))
            .withColumn("direction", ladder([(d > 0, "up"), (d < 0, "down")], "flat")).drop("_before"))


class SnapshotTable:
    """The silver table of signal snapshots, appended cycle by cycle under `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, cycle: int) -> str:
        return f"{self.path}/cycle={cycle}"

    def cycle(self, number: int) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT).parquet(self._folder(number))

    def append(self, number: int, rows: DataFrame, config: DataFrame, previous: int | None = None) -> DataFrame:
        """Scores `signal_rows`, compares them with cycle `previous` and writes them as cycle `number`; returns what was written."""
        scored = score_signals(rows, config).select(*rows.columns, "status")
        out = against_previous(scored, None if previous is None else self.cycle(previous))
        out.select("signal_name", "numeric_value", "snapshot_time", "status", "trend", "direction").coalesce(1).write.mode("overwrite").parquet(self._folder(number))
        return self.cycle(number)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT + ", cycle int").parquet(self.path)
