"""Parquet files as read-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """The file's columns as they are; Spark prunes and pushes down into the scan."""
    return spark.read.parquet(path)
