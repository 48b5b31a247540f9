"""Lags, running sums and fills over ordered groups of any size.

A window over a group sorts it in one task; a document or user may hold a third
of all rows. Here a group is cut into blocks of its order column: windows run
within (group, block), block summaries - one row each - carry what crosses a
boundary, and an equi join brings it back. Results equal the plain window's.

Orders must be numeric and, with the further order columns, unique in a group.
Null group keys form a group of their own; rows with a null order come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Width of a block in units of the order column.
WIDTH = 4096


def _blocked(df: DataFrame, order: str, width: float) -> DataFrame:
    return df.withColumn("_od_b", F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62))).cast("long"))


def _join(df: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    keys = [*group, "_od_b"]
    c = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_od_carry")
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(c, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def lagged(df: DataFrame, group: list[str], order: list[str], value: str, to: str, width: float = WIDTH) -> DataFrame:
    """Adds the value of the row before; null for a group's first row."""
    b = _blocked(df, order[0], width).withColumn("_od_v", F.struct(F.col(value).alias("v")))
    inner = F.lag("_od_v").over(W.partitionBy(*group, "_od_b").orderBy(*order))
    ends = b.groupBy(*group, "_od_b").agg(F.max_by("_od_v", F.struct(*order)).alias("_od_e"))
    carried = ends.withColumn("_od_carry", F.lag("_od_e").over(W.partitionBy(*group).orderBy("_od_b")))
    out = _join(b.withColumn("_od_in", inner), carried, group)
    return out.withColumn(to, F.coalesce("_od_in", "_od_carry")["v"]).drop("_od_b", "_od_v", "_od_in", "_od_carry")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column | str, to: str, width: float = WIDTH) -> DataFrame:
    """Adds the sum of the value up to and with each row; null values count 0."""
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    b = _blocked(df, order[0], width).withColumn("_od_v", v)
    inner = F.sum("_od_v").over(W.partitionBy(*group, "_od_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    totals = b.groupBy(*group, "_od_b").agg(F.sum("_od_v").alias("_od_t"))
    carried = totals.withColumn("_od_carry", F.sum("_od_t").over(W.partitionBy(*group).orderBy("_od_b").rowsBetween(W.unboundedPreceding, -1)))
    out = _join(b.withColumn("_od_in", inner), carried, group)
    return out.withColumn(to, F.col("_od_in") + F.coalesce("_od_carry", F.lit(0))).drop("_od_b", "_od_v", "_od_in", "_od_carry")


def numbered(df: DataFrame, group: list[str], order: list[str], to: str, width: float = WIDTH) -> DataFrame:
    """Adds the row's number in its group, from 1."""
    return running_sum(df, group, order, F.lit(1), to, width)


def filled(df: DataFrame, group: list[str], order: list[str], value: str, to: str, width: float = WIDTH) -> DataFrame:
    """Adds the last non-null value up to and with each row."""
    b = _blocked(df, order[0], width)
    inner = F.last(value, True).over(W.partitionBy(*group, "_od_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    ends = b.groupBy(*group, "_od_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_od_e"))
    carried = ends.withColumn("_od_carry", F.last("_od_e", True).over(W.partitionBy(*group).orderBy("_od_b").rowsBetween(W.unboundedPreceding, -1)))
    out = _join(b.withColumn("_od_in", inner), carried, group)
    return out.withColumn(to, F.coalesce("_od_in", "_od_carry")).drop("_od_b", "_od_in", "_od_carry")


def top_rows(df: DataFrame, group: list[str], order: list[Column], n: int, spread: Column, parts: int = 16) -> DataFrame:
    """The first ``n`` rows of each group; first of each of ``parts`` parts of it, then of what these leave."""
    part = F.pmod(F.xxhash64(spread), F.lit(parts))
    d = df.withColumn("_p", part).withColumn("_k", F.row_number().over(W.partitionBy(*group, "_p").orderBy(*order))).where(F.col("_k") <= n)
    return d.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= n).drop("_p", "_k")
