"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as stored; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, *key: str) -> DataFrame:
    """One row for each key. Rows that arrive again have the same content, so any of them serves.

    Null keys cannot be told apart and are all kept; the input is read once.
    """
    has_key = F.lit(True)
    for k in key:
        has_key = has_key & F.col(k).isNotNull()
    own = "__row_without_key"
    return df.withColumn(own, F.when(~has_key, F.monotonically_increasing_id())).dropDuplicates([*key, own]).drop(own)
