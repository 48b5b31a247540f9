"""All queries of the core library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.queries import cargo, cases, chunksets, documents, quality, structure, texts, usage
from tidewater.queries.registry import Query

MODULES = [usage, cargo, texts, chunksets, documents, structure, quality, cases]


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.query.queries.items()}


def sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.query.sql.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return usage.usage_daily_all(spark, folder)
