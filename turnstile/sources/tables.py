"""Readers for the tables that queries run over.

Only Spark's own readers touch a path, so any file system Spark knows works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")
