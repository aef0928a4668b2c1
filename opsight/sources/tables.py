"""Reading the given tables (SRC-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. Parquet: Catalyst prunes columns and pushes filters into the scan.

    Nothing is kept between calls, so files that have come since are read; `Model` keeps a run's tables.
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
