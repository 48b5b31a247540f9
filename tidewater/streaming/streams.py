"""Structured Streaming: usage windows, quotas, rate limits, landing-folder ingest and progress sessions."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.session import shared_dir


def usage_windows(events: DataFrame, ts: str, key: str, value: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(key, start, end, requests, total) per window of event time; rows later than ``late`` are dropped, null times too."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("requests"), F.sum(value).alias("total"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "total")


def daily_quota(events: DataFrame, ts: str, key: str, limit: int, late: str = "1 day") -> DataFrame:
    """Requests per key and day, and whether the limit is reached; a limit of 0 never is."""
    d = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("requests"))
    return d.select(key, F.to_date("w.start").alias("day"), "requests", ((F.lit(limit) > 0) & (F.col("requests") >= limit)).alias("exhausted"))


def progress_sessions(events: DataFrame, ts: str, task: str, idle: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """(task, start, end, events, done): a task's events until it was idle; ``done`` if one of them says so."""
    g = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(F.session_window(ts, idle).alias("w"), task)
    return g.agg(F.count("*").alias("events"), F.max((F.col("event_type") == "done").cast("int")).alias("_d")).select(task, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", (F.col("_d") == 1).alias("done"))


def limit_rate(events: DataFrame, key: str, ts: str, tokens: str, per_window: int, seconds: int = 60) -> DataFrame:
    """(key, ts, tokens, wait_seconds): how long each request must wait so that no window exceeds the tokens.

    The requests of a key that one trigger brings are sorted by time, then tokens,
    before any is granted, however they arrive; across triggers the order of
    arrival counts. The state per key is the requests still inside the window -
    bounded by the window, since granted tokens are; a request beyond the whole
    limit waits for an empty window.
    """
    schema = f"`{key}` string, ts timestamp, tokens long, wait_seconds double"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = deque(zip(*state.get, strict=True)) if state.exists else deque()
        held = sum(m for _, m in live)
        out = []
        for t, n in sorted(x for b in batches for x in b[["_t", "_n"]].itertuples(index=False, name=None)):
            at = max(t, live[-1][0]) if live else t
            while live and (live[0][0] <= at - seconds or held + n > per_window):
                at = max(at, live[0][0] + seconds)
                held -= live.popleft()[1]
            live.append((at, n))
            held += n
            out.append((str(k[0]), pd.Timestamp(round(t * 1e6), unit="us"), int(n), at - t))
        state.update(([s for s, _ in live], [m for _, m in live]))
        yield pd.DataFrame(out, columns=[key, "ts", "tokens", "wait_seconds"])

    e = events.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias(key), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("_n"))
    return e.groupBy(key).applyInPandasWithState(run, schema, "at array<double>, n array<long>", "append", GroupStateTimeout.NoTimeout)


def ingest(spark: SparkSession, landing: str, checkpoint: str, process: Callable[[DataFrame, int], None], extension: str = "*") -> None:
    """Processes every file that landed and was not yet seen, then ends; each file once, also over restarts."""
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "true").load(landing)
    q = f.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now; the result is a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").start(f"{folder}/table")
    else:
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/table")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet file as a stream."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if spark.read.parquet(path).inputFiles()[0].rsplit("/", 2)[-2].endswith(".parquet") else f"{folder}/{name}*.parquet")


def backoff(attempt: int, base: float = 1.0, most: float = 60.0) -> float:
    """Seconds to wait before a retry: doubling up to ``most``."""
    return min(base * 2**attempt, most)


def embed_batches(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], size: int = 20, attempts: int = 3) -> DataFrame:
    """(key, embedding) by an injected model in batches, retried with growing pauses; a batch that keeps failing fails the task."""
    import time

    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), size):
                part = b.iloc[i : i + size]
                for n in range(attempts):
                    try:
                        got = embed(part[text].fillna("").tolist())
                        break
                    except (OSError, TimeoutError):
                        if n == attempts - 1:
                            raise
                        time.sleep(backoff(n, 0.1, 2.0))
                yield pd.DataFrame({key: part[key].tolist(), "embedding": got})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A deterministic embedding of word hashes, for tests and offline runs."""
    import hashlib

    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % size] += 1.0 if h >> 60 & 1 else -1.0
        out.append(v)
    return out

