"""Parquet tables of one folder, read with column pruning left to the optimizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` (a Parquet file or folder called name.parquet)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
