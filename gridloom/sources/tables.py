"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; Parquet gives column pruning and pushed filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
