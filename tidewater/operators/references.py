"""References to records that do not exist.

Parent keys are compressed into runs of consecutive integers. A reference is
matched as of the preceding run start; a key beyond that run's end has no
parent. Each run carries, aligned to its keys, when the parent first arrived
and whether its latest version is deleted, so one match also finds references
to deleted parents and to parents that came later.

Keys that are strings take part through an exact split into a name space (all
before the trailing digits, and the number of those digits) and an integer.

Layout at scale: runs are cut at blocks of ``BLOCK`` keys, so an array of runs
is bounded; references are joined on (name space, block, salt). The salt spreads
a parent that a third of all rows refer to over ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidewater.sources.tables import first_rows, latest_rows

BLOCK = 128
SALTS = 8


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """Adds ``_ns`` and ``_num``; (``_ns``, ``_num``) equals iff the keys are equal."""
    c = F.col(key)
    if isinstance(df.schema[key].dataType, T.StringType):
        digits = F.regexp_extract(c, r"([0-9]{1,18})\z", 1)
        ns = F.concat(F.expr(f"left(`{key}`, length(`{key}`) - length(regexp_extract(`{key}`, '([0-9]{{1,18}})\\\\z', 1)))"), F.lit("\u0000"), F.length(digits).cast("string"))
        return df.withColumn("_ns", ns).withColumn("_num", F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(`{key}`, '([0-9]{{1,18}})\\\\z', 1), '') as bigint)"), F.lit(0).cast("long")))
    return df.withColumn("_ns", F.lit("")).withColumn("_num", c.cast("long"))


def _block(num: Column) -> Column:
    return F.floor(num / F.lit(BLOCK)).cast("long") if BLOCK & (BLOCK - 1) else F.shiftright(num, BLOCK.bit_length() - 1)


def compress_runs(parents: DataFrame, key: str, loaded: str = "loaded_at", deleted: str | None = "deleted_at") -> DataFrame:
    """(``_ns``, ``_block``, ``runs``): sorted runs (start, end, info) of each block of parent keys.

    ``info[i]`` describes key ``start + i``: ``seen`` (first arrival) and ``gone``
    (latest version deleted; on equal times a deletion wins). Null keys are left
    out; an empty table gives no row.
    """
    cols = [deleted] if deleted else []
    one = latest_rows(parents.select(key, loaded, *cols), key, cols, loaded)
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    k = _keyed(one.withColumn("_gone", gone), key).withColumn("_block", _block(F.col("_num")))
    by = W.partitionBy("_ns", "_block").orderBy("_num")
    k = k.withColumn("_new", F.coalesce((F.col("_num") != F.lag("_num").over(by) + 1).cast("int"), F.lit(1)))
    k = k.withColumn("_run", F.sum("_new").over(by))
    runs = k.groupBy("_ns", "_block", "_run").agg(
        F.min("_num").alias("start"),
        F.max("_num").alias("end"),
        F.sort_array(F.collect_list(F.struct("_num", F.col("first_loaded").alias("seen"), F.col("_gone").alias("gone")))).alias("info"),
    )
    return runs.groupBy("_ns", "_block").agg(F.sort_array(F.collect_list(F.struct("start", "end", "info"))).alias("runs"))


def find_orphans(refs: DataFrame, parents: DataFrame, row_id: str, ref_key: str, parent_key: str, loaded: str = "loaded_at", deleted: str | None = "deleted_at") -> DataFrame:
    """References that do not resolve: (row_id, ref_key string, first_loaded, reason).

    ``reason`` is ``missing`` (no such parent), ``deleted`` (the parent's latest
    version is deleted) or ``late`` (the parent first arrived after the row did).
    Rows of one id count once, by their earliest row; null ids and null
    references are no cases; keys compare exactly as written. A parent or row
    without any arrival time is never late. Other columns play no part.
    """
    rows = first_rows(refs.select(row_id, ref_key, loaded), row_id, [ref_key], loaded)
    rows = _keyed(rows.where(F.col(ref_key).isNotNull()), ref_key)
    rows = rows.withColumn("_block", _block(F.col("_num"))).withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int"))
    runs = compress_runs(parents, parent_key, loaded, deleted).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    j = rows.join(runs, ["_ns", "_block", "_salt"], "left")
    j = j.withColumn("_asof", F.expr("try_element_at(filter(runs, r -> r.start <= _num), -1)"))
    j = j.withColumn("_info", F.expr("case when _num <= _asof.end then _asof.info[cast(_num - _asof.start as int)] end"))
    reason = F.when(F.col("_info").isNull(), "missing").when(F.col("_info.gone"), "deleted").when(F.col("_info.seen") > F.col("first_loaded"), "late")
    out = j.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return out.select(F.col(row_id).alias("row_id"), F.col(ref_key).cast("string").alias("ref_key"), "first_loaded", "reason")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of orphans per table, month of first arrival and reason."""
    month = F.date_format("first_loaded", "yyyy-MM")
    return orphans.groupBy("table_name", month.alias("month"), "reason").agg(F.count("*").alias("n"))
