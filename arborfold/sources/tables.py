"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; columns and filters used later reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
