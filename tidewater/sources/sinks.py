"""Sinks: appends with positions, partition replacement, verified upserts, documents as JSON, Markdown and CSV.

A rerun of any of them gives the same table: partitions are replaced, not added to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.chunksets import consolidate, upsert


def with_positions(documents: DataFrame, chunks: str = "chunks") -> DataFrame:
    """Documents with an array of chunks (title, body) as chunk rows with their position; null arrays give none."""
    keep = [c for c in documents.columns if c != chunks]
    return documents.select(*keep, F.posexplode(chunks).alias("position", "_c")).select(*keep, "position", "_c.title", "_c.body")


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replaces exactly the partitions of ``key`` that ``df`` holds; others stay."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def publish(old: DataFrame, new: DataFrame, path: str, key: str) -> int:
    """Writes the upsert of ``new`` into ``old`` to a new path and verifies the count; raises if rows got lost."""
    merged = upsert(old, new, key)
    merged.write.mode("errorifexists").parquet(path)
    spark = old.sparkSession
    stored = spark.read.parquet(path).join(new.select(key).distinct(), key, "left_semi").count()
    wanted = new.count()
    if stored != wanted:
        raise RuntimeError(f"{stored} of {wanted} rows were stored")
    return stored


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def delete_where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that do not meet a condition on their metadata; rows for which it is unknown stay."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.where(~F.coalesce(c, F.lit(False)))


def cleared(df: DataFrame) -> DataFrame:
    """A collection of the same columns without rows."""
    return df.sparkSession.createDataFrame([], df.schema)


def append_usage(rows: DataFrame, path: str) -> None:
    """Appends usage rows to their log, one folder per day of ``ts``; rows without a time go to the null day."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): every row as a JSON object, as an interface answers it; null fields are left out."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("overwrite").partitionBy(key).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def markdown(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """(key, block, body): chunks as Markdown sections in order."""
    part = F.concat(F.lit("## "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return consolidate(chunks.select(key, order, part.alias("part")), [key], order, "part")


def write_markdown(chunks: DataFrame, path: str, key: str, order: str) -> None:
    markdown(chunks, key, order).select(key, F.col("body").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def save_state(state: DataFrame, path: str) -> None:
    """The state table under a new version folder; readers take the greatest."""
    state.write.mode("errorifexists").parquet(path)
