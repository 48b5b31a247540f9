"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}


def build_session(app: str = "tidewater", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` overrides them (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a local folder is made on a local master; on a
    cluster, whose machines would not share it, that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"tidewater-{sc.applicationId}")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartitions by ``keys`` into a fixed number of tasks, which adaptive execution does not coalesce.

    For Python stages, whose cost per byte is far above what coalescing by size assumes.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


#: Inputs below this size, by the plan's statistics, are repartitioned before a map-only Python stage: such a file has too few row groups to be read by many tasks.
SMALL = 1 << 25


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spreads a small input over all cores before a map-only Python stage; larger inputs keep the splits of their scan."""
    spark = df.sparkSession
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL:
        return df
    return df.repartition(2 * spark.sparkContext.defaultParallelism, key)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewater_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tidewater-")) / "tidewater.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("tidewater") / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._tidewater_shipped = True
