"""Reading the stored tables. Paths go to Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder`` (one file or a folder of files)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
