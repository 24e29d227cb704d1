"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``; a file or a directory of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
