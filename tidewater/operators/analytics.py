"""Usage, portfolio and cost aggregates (declarative; one shuffle per grouping key).

Shared rules: counts of nothing are 0; sums over no rows or only nulls are 0;
averages are rounded half to even; ties in rankings fall to the key. Rows with a
null timestamp belong to no day. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def zero_sum(c: str | Column) -> Column:
    """Sum that is 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def scoped(df: DataFrame, scope: str | None, column: str = "client_id") -> DataFrame:
    """Rows of one tenant; all rows where ``scope`` is None."""
    return df if scope is None else df.where(F.col(column) == scope)


def month_start(as_of: str) -> Column:
    return F.trunc(F.lit(as_of).cast("date"), "MM")


def daily_series(logs: DataFrame, as_of: str, days: int, ts: str, tokens: str, latency: str) -> DataFrame:
    """Exactly ``days`` rows up to ``as_of``: (day, label, requests, tokens, avg_latency), zero where nothing happened.

    The range predicate reaches the scan; the spine is generated, never collected.
    """
    last = F.lit(as_of).cast("date")
    first = F.date_sub(last, days - 1)
    inside = logs.where((F.col(ts) >= first.cast("timestamp_ntz")) & (F.col(ts) < F.date_add(last, 1).cast("timestamp_ntz")))
    per_day = inside.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"), F.bround(F.avg(latency)).cast("long").alias("avg_latency"))
    spine = logs.sparkSession.range(days).select(F.date_add(first, F.col("id").cast("int")).alias("day"))
    j = spine.join(per_day, "day", "left")
    return j.select("day", F.date_format("day", "d MMM").alias("label"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "tokens", "avg_latency")])


def usage_by(logs: DataFrame, key: str, tokens: str, ts: str, since: Column, until: Column) -> DataFrame:
    """(key, requests, tokens) of the period."""
    inside = logs.where((F.col(ts) >= since.cast("timestamp_ntz")) & (F.col(ts) < until.cast("timestamp_ntz")))
    return inside.groupBy(key).agg(F.count("*").alias("requests"), zero_sum(tokens).alias("tokens"))


def usage_total(logs: DataFrame, tokens: str, ts: str, since: Column, until: Column) -> DataFrame:
    """One row, also over nothing: (requests, tokens)."""
    inside = logs.where((F.col(ts) >= since.cast("timestamp_ntz")) & (F.col(ts) < until.cast("timestamp_ntz")))
    return inside.agg(F.count("*").alias("requests"), zero_sum(tokens).alias("tokens"))


def top(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of largest ``by``, ties by key; a TakeOrdered, no full sort."""
    return df.orderBy(F.col(by).desc(), F.col(key)).limit(n)


def merge_usage(clients: DataFrame, key: str, *usages: DataFrame) -> DataFrame:
    """Client list with its usage figures, 0 where a client has none."""
    out = clients
    for u in usages:
        out = out.join(u, key, "left")
    figures = [c for u in usages for c in u.columns if c != key]
    return out.select(*clients.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in figures])


def sliding_sum(df: DataFrame, key: str, ts: str, value: str, seconds: int, blocks: int = 20) -> DataFrame:
    """Adds ``window_sum``: the sum of the rows of the key less than ``seconds`` before, the row's own included.

    A key is cut into blocks of ``blocks`` times the window; rows at the end of a
    block are copied into the next, so that a key of very many rows is summed in
    many tasks. Rows with a null time are summed among themselves.
    """
    span = seconds * 1_000_000
    r = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    own = F.coalesce(F.floor(F.col("_us") / (span * blocks)), F.lit(-1)).cast("long")
    nxt = F.coalesce(F.floor((F.col("_us") + span) / (span * blocks)), F.lit(-1)).cast("long")
    r = r.withColumn("_own", own).withColumn("_b", F.explode(F.array_distinct(F.array(own, nxt))))
    w = W.partitionBy(key, "_b").orderBy("_us").rangeBetween(-(span - 1), 0)
    return r.withColumn("window_sum", F.sum(value).over(w)).where("_b = _own").drop("_us", "_own", "_b")


def document_summary(files: DataFrame, group: str) -> DataFrame:
    """Per group: documents, active ones, chunks, last change and how far the group has come.

    Conditional aggregates in a single pass; a null group is its own row.
    """
    active = F.col("status") == "active"
    g = files.groupBy(group).agg(
        F.count("*").alias("documents"),
        F.count_if(active).alias("active"),
        F.count_if(F.col("status") == "error").alias("errors"),
        zero_sum(F.when(active, F.col("chunk_count"))).cast("long").alias("chunks"),
        F.max(F.coalesce("activated_at", "uploaded_at")).alias("last_change"),
    )
    label = F.when(F.col("active") == F.col("documents"), "complete").when(F.col("active") > 0, "partial").when(F.col("errors") > 0, "failed").otherwise("pending")
    return g.withColumn("state", label)


def fleet_metrics(summary: DataFrame) -> DataFrame:
    """One row over the summary: groups, complete ones, documents, chunks."""
    return summary.agg(F.count("*").alias("groups"), F.count_if(F.col("state") == "complete").alias("complete"), zero_sum("documents").alias("documents"), zero_sum("chunks").alias("chunks"))


def section_progress(sections: DataFrame, files: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(client_id, sections, filled, verified, progress): sections with a document, with only active ones, truncated per cent.

    The section list of a client is the default list overlaid with its own rows;
    inactive rows hide a section.
    """
    slugs = F.array(*[F.lit(s) for s in defaults])
    clients = sections.select("client_id").where("client_id is not null").distinct()
    full = clients.select("client_id", F.explode(slugs).alias("slug")).join(sections.select("client_id", "slug", F.col("active").alias("shown")), ["client_id", "slug"], "left").where(F.coalesce("shown", F.lit(True)))
    docs = files.groupBy("client_id", F.col("document_category").alias("slug")).agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "active").alias("all_active"))
    j = full.join(docs, ["client_id", "slug"], "left")
    g = j.groupBy("client_id").agg(F.count("*").alias("sections"), F.count_if(F.col("n") > 0).alias("filled"), F.count_if(F.col("all_active")).alias("verified"))
    return g.withColumn("progress", (F.col("verified") * 100 / F.col("sections")).cast("int"))


def category_totals(df: DataFrame, category: str, amount: str) -> DataFrame:
    """(category, total) and a last row ``TOTAL``; amounts that are no numbers are skipped, blank categories read ``—``."""
    name = F.coalesce(F.nullif(F.trim(F.col(category)), F.lit("")), F.lit("—"))
    value = F.col(amount).cast("string").try_cast("double")
    rows = df.select(name.alias("category"), value.alias("v")).where("v is not null")
    return rows.rollup("category").agg(zero_sum("v").alias("total")).withColumn("category", F.coalesce("category", F.lit("TOTAL")))


def last_value_total(df: DataFrame, key: str, amount: str, label: str, order: str) -> DataFrame:
    """Per key the sum of the amounts and the label of the last row by ``order``."""
    return df.groupBy(key).agg(zero_sum(amount).alias("total"), F.max_by(label, order).alias("last_label"))


def compare_two(df: DataFrame, ref: str, item: str, amount: str, a: object, b: object) -> DataFrame:
    """Two references side by side: (item, a, b, difference); an item missing on one side counts 0 there."""
    side = lambda r, name: df.where(F.col(ref) == F.lit(r)).groupBy(item).agg(zero_sum(amount).alias(name))
    j = side(a, "a").join(side(b, "b"), item, "full_outer")
    return j.select(item, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("a", "b")]).withColumn("difference", F.col("b") - F.col("a"))
