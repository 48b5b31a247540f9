"""Table scans and versioned-row views over a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one table; column pruning and filters reach the Parquet reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _when(loaded: str) -> Column:
    return F.coalesce(F.col(loaded), F.lit("9999-12-31").cast("timestamp_ntz"))


def first_rows(df: DataFrame, key: str, columns: list[str], loaded: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the values of its earliest row, and ``first_loaded``.

    Null keys form no row. A null ``loaded`` sorts last. Ties take the smallest
    values. The result has exactly ``key``, ``columns`` and ``first_loaded``.
    """
    row = F.struct(_when(loaded).alias("_t"), *[F.col(c) for c in columns])
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("_r"), F.min(loaded).alias("first_loaded"))
    return picked.select(key, *[F.col("_r")[c].alias(c) for c in columns], "first_loaded")


def latest_rows(df: DataFrame, key: str, columns: list[str], loaded: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the values of its latest version, and ``first_loaded``.

    Null keys form no row. A null ``loaded`` sorts first. Ties take the largest
    values, nulls being smallest.
    """
    row = F.struct(F.col(loaded).alias("_t"), *[F.col(c) for c in columns])
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_r"), F.min(loaded).alias("first_loaded"))
    return picked.select(key, *[F.col("_r")[c].alias(c) for c in columns], "first_loaded")
