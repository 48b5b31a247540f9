"""Usage, portfolio and cost queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import analytics as an
from tidewater.queries.registry import Registry
from tidewater.sources.tables import latest_rows, table

query = Registry()

AS_OF = "2024-01-30"
_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
_MONTH = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"


def usage_logs(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a usage log: client, user, time, tokens and latency."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").select(F.col("event_type").alias("client"), "user_id", "ts", k.alias("tokens"), F.col("value").alias("latency"), "event_id")


@query(
    "usage_daily_spine",
    f"""
SELECT CAST(s.day AS DATE) AS day, strftime(s.day, '%-d %b') AS label, coalesce(n, 0) AS requests, coalesce(t, 0) AS tokens, coalesce(a, 0) AS avg_latency
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS day) s
LEFT JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS n, CAST(sum({_K}) AS BIGINT) AS t, CAST(round_even(avg(value), 0) AS BIGINT) AS a
           FROM events WHERE {_MONTH} AND event_type = 'click' AND user_id = 7 GROUP BY 1) e ON e.d = CAST(s.day AS DATE)
""",
)
def usage_daily_spine(spark: SparkSession, d: str) -> DataFrame:
    logs = usage_logs(spark, d).where("client = 'click' and user_id = 7")
    return an.daily_series(logs, AS_OF, 30, "ts", "tokens", "latency")


@query(
    "usage_daily_all",
    f"""
SELECT CAST(ts AS DATE) AS day, strftime(min(ts), '%-d %b') AS label, count(*) AS requests, coalesce(CAST(sum({_K}) AS BIGINT), 0) AS tokens, CAST(round_even(avg(value), 0) AS BIGINT) AS avg_latency
FROM events WHERE {_MONTH} GROUP BY 1
""",
)
def usage_daily_all(spark: SparkSession, d: str) -> DataFrame:
    return an.daily_series(usage_logs(spark, d), AS_OF, 30, "ts", "tokens", "latency")


@query("usage_today_by_client", "SELECT event_type AS client, count(*) AS requests, coalesce(CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT), 0) AS tokens FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1")
def usage_today_by_client(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit(AS_OF).cast("date")
    return an.usage_by(usage_logs(spark, d), "client", "tokens", "ts", day, F.date_add(day, 1))


@query("usage_month_by_client", f"SELECT event_type AS client, count(*) AS requests, coalesce(CAST(sum({_K}) AS BIGINT), 0) AS tokens FROM events WHERE {_MONTH} GROUP BY 1")
def usage_month_by_client(spark: SparkSession, d: str) -> DataFrame:
    return an.usage_by(usage_logs(spark, d), "client", "tokens", "ts", an.month_start(AS_OF), F.date_add(F.lit(AS_OF).cast("date"), 1))


@query("usage_month_total", f"SELECT count(*) AS requests, coalesce(CAST(sum({_K}) AS BIGINT), 0) AS tokens FROM events WHERE {_MONTH}")
def usage_month_total(spark: SparkSession, d: str) -> DataFrame:
    return an.usage_total(usage_logs(spark, d), "tokens", "ts", an.month_start(AS_OF), F.date_add(F.lit(AS_OF).cast("date"), 1))


@query("usage_top_users", f"SELECT user_id, count(*) AS requests, coalesce(CAST(sum({_K}) AS BIGINT), 0) AS tokens FROM events WHERE {_MONTH} GROUP BY 1 ORDER BY requests DESC, user_id LIMIT 10")
def usage_top_users(spark: SparkSession, d: str) -> DataFrame:
    per = an.usage_by(usage_logs(spark, d), "user_id", "tokens", "ts", an.month_start(AS_OF), F.date_add(F.lit(AS_OF).cast("date"), 1))
    return an.top(per, "requests", "user_id", 10)


@query(
    "usage_quota",
    "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests, count(*) >= 3 AS exhausted FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
)
def usage_quota(spark: SparkSession, d: str) -> DataFrame:
    """Daily quota check with a limit of 3 requests."""
    g = usage_logs(spark, d).where("ts is not null").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"))
    return g.withColumn("exhausted", F.col("requests") >= 3)


@query(
    "usage_sliding_tokens",
    f"""
SELECT event_id, user_id, CAST(sum({_K}) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS window_sum FROM events
""",
)
def usage_sliding_tokens(spark: SparkSession, d: str) -> DataFrame:
    return an.sliding_sum(usage_logs(spark, d), "user_id", "ts", "tokens", 3600).select("event_id", "user_id", "window_sum")


def current(spark: SparkSession, d: str, name: str, key: str, columns: list[str]) -> DataFrame:
    """Latest versions that are not deleted."""
    return latest_rows(table(spark, d, name), key, [*columns, "deleted_at"]).where("deleted_at is null").drop("deleted_at", "first_loaded")


def _current_sql(name: str, key: str, columns: str) -> str:
    cols = ", ".join(f"r.{c.strip()} AS {c.strip()}" for c in columns.split(","))
    pack = ", ".join(f"{c.strip()} := {c.strip()}" for c in columns.split(","))
    return f"(SELECT {key}, {cols} FROM (SELECT {key}, arg_max(struct_pack({pack}, gone := deleted_at IS NOT NULL), loaded_at) AS r FROM {name} WHERE {key} IS NOT NULL GROUP BY {key}) WHERE NOT r.gone)"


@query(
    "client_activity",
    f"""
SELECT c.client_id, c.name, coalesce(s.sessions, 0) AS sessions, coalesce(f.files, 0) AS files, coalesce(f.chunks, 0) AS chunks
FROM {_current_sql("client_configs", "client_id", "name")} c
LEFT JOIN (SELECT client_id, count(*) AS sessions FROM {_current_sql("chat_sessions", "id", "client_id")} GROUP BY 1) s USING (client_id)
LEFT JOIN (SELECT client_id, count(*) AS files, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM {_current_sql("document_files", "id", "client_id, chunk_count")} GROUP BY 1) f USING (client_id)
""",
)
def client_activity(spark: SparkSession, d: str) -> DataFrame:
    clients = current(spark, d, "client_configs", "client_id", ["name"]).select("client_id", "name")
    sessions = current(spark, d, "chat_sessions", "id", ["client_id"]).groupBy("client_id").agg(F.count("*").alias("sessions"))
    files = current(spark, d, "document_files", "id", ["client_id", "chunk_count"]).groupBy("client_id").agg(F.count("*").alias("files"), F.sum("chunk_count").alias("chunks"))
    return an.merge_usage(clients, "client_id", sessions, files)


_FILES = _current_sql("document_files", "id", "group_name, status, chunk_count, uploaded_at, activated_at, client_id, document_category, vessel_id")
_SUMMARY = f"""
SELECT group_name, count(*) AS documents, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'error') AS errors,
  coalesce(CAST(sum(chunk_count) FILTER (status = 'active') AS BIGINT), 0) AS chunks, max(coalesce(activated_at, uploaded_at)) AS last_change,
  CASE WHEN count(*) FILTER (status = 'active') = count(*) THEN 'complete' WHEN count(*) FILTER (status = 'active') > 0 THEN 'partial'
       WHEN count(*) FILTER (status = 'error') > 0 THEN 'failed' ELSE 'pending' END AS state
FROM {_FILES} GROUP BY 1
"""


def current_files(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "document_files", "id", ["group_name", "status", "chunk_count", "uploaded_at", "activated_at", "client_id", "document_category", "vessel_id"])


@query("document_summary", _SUMMARY)
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    return an.document_summary(current_files(spark, d), "group_name")


@query("fleet_metrics", f"SELECT count(*) AS groups, count(*) FILTER (state = 'complete') AS complete, coalesce(CAST(sum(documents) AS BIGINT), 0) AS documents, coalesce(CAST(sum(chunks) AS BIGINT), 0) AS chunks FROM ({_SUMMARY})")
def fleet_metrics(spark: SparkSession, d: str) -> DataFrame:
    return an.fleet_metrics(document_summary(spark, d))


#: The default sections of a dossier (fixed values).
SECTIONS = {
    "vessel_specifications": "Vessel Specifications",
    "charter_party": "Charter Party",
    "fixture_recap": "Fixture Recap",
    "addendum": "Addendum",
    "speed_consumption": "Speed and Consumption",
    "lifting_equipment": "Lifting Equipment",
    "inventory": "Inventory",
    "hseq_documents": "HSEQ Documents",
    "vessel_owners_details": "Vessel and Owners",
    "delivery_details": "Delivery Details",
}
_SECTION_VALUES = ", ".join(f"('{s}', '{label}')" for s, label in SECTIONS.items())


def own_sections(spark: SparkSession, d: str) -> DataFrame:
    """One row per client and section: the last to arrive, greatest id among equals."""
    t = table(spark, d, "dossier_section_configs").where("client_id is not null and slug is not null")
    g = t.groupBy("client_id", "slug").agg(F.max(F.struct("loaded_at", "id", "active", "label")).alias("r"))
    return g.select("client_id", "slug", "r.active", "r.label")


_OWN = "(SELECT client_id, slug, r.active AS active, r.label AS label FROM (SELECT client_id, slug, max(struct_pack(a := loaded_at, b := id, active := active, label := label)) AS r FROM dossier_section_configs WHERE client_id IS NOT NULL AND slug IS NOT NULL GROUP BY 1, 2))"


@query(
    "dossier_progress",
    f"""
SELECT client_id, count(*) AS sections, count(*) FILTER (n > 0) AS filled, count(*) FILTER (all_active) AS verified,
  CAST(trunc(count(*) FILTER (all_active) * 100.0 / count(*)) AS INT) AS progress
FROM (SELECT DISTINCT client_id FROM dossier_section_configs WHERE client_id IS NOT NULL) c
CROSS JOIN (VALUES {_SECTION_VALUES}) v(slug, lbl)
LEFT JOIN {_OWN} o USING (client_id, slug)
LEFT JOIN (SELECT client_id, document_category AS slug, count(*) AS n, bool_and(status = 'active') AS all_active FROM {_FILES} GROUP BY 1, 2) f USING (client_id, slug)
WHERE coalesce(o.active, true) GROUP BY 1
""",
)
def dossier_progress(spark: SparkSession, d: str) -> DataFrame:
    return an.section_progress(own_sections(spark, d), current_files(spark, d), SECTIONS)


@query(
    "section_labels",
    f"""
SELECT o.client_id, o.slug, coalesce(nullif(o.label, ''), v.lbl, o.slug) AS label FROM {_OWN} o
LEFT JOIN (VALUES {_SECTION_VALUES}) v(slug, lbl) ON v.slug = o.slug WHERE o.active
""",
)
def section_labels(spark: SparkSession, d: str) -> DataFrame:
    """Configured label of each shown section, else the default one."""
    base = spark.createDataFrame(list(SECTIONS.items()), "slug string, default_label string")
    j = own_sections(spark, d).where("active").join(F.broadcast(base), "slug", "left")
    return j.select("client_id", "slug", F.coalesce(F.nullif("label", F.lit("")), "default_label", "slug").alias("label"))


@query("cost_totals", "SELECT coalesce(category, 'TOTAL') AS category, round(total, 2) AS total FROM (SELECT l_returnflag AS category, sum(l_extendedprice) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag))")
def cost_totals(spark: SparkSession, d: str) -> DataFrame:
    return an.category_totals(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").withColumn("total", F.round("total", 2))


@query("cost_last_label", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, arg_max(o_orderpriority, o_orderkey) AS last_label FROM orders GROUP BY 1")
def cost_last_label(spark: SparkSession, d: str) -> DataFrame:
    return an.last_value_total(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderpriority", "o_orderkey").withColumn("total", F.round("total", 2))


@query(
    "cost_compare",
    """
SELECT coalesce(x.l_returnflag, y.l_returnflag) AS l_returnflag, round(coalesce(x.a, 0), 2) AS a, round(coalesce(y.b, 0), 2) AS b, round(coalesce(y.b, 0) - coalesce(x.a, 0), 2) AS difference
FROM (SELECT l_returnflag, sum(l_extendedprice) AS a FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) x
FULL JOIN (SELECT l_returnflag, sum(l_extendedprice) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) y USING (l_returnflag)
""",
)
def cost_compare(spark: SparkSession, d: str) -> DataFrame:
    got = an.compare_two(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", "l_extendedprice", "O", "F")
    return got.select("l_returnflag", *[F.round(c, 2).alias(c) for c in ("a", "b", "difference")])


@query("open_sessions", f"SELECT id, user_email, client_id, updated_at FROM {_current_sql('chat_sessions', 'id', 'user_email, client_id, updated_at')} ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 50")
def open_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The 50 sessions last used; nulls last, ties by id."""
    s = current(spark, d, "chat_sessions", "id", ["user_email", "client_id", "updated_at"])
    return s.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(50)


@query("session_page", f"SELECT id, client_id FROM {_current_sql('chat_sessions', 'id', 'client_id')} ORDER BY client_id, id LIMIT 20 OFFSET 40")
def session_page(spark: SparkSession, d: str) -> DataFrame:
    """Third page of 20 in a fixed order."""
    return current(spark, d, "chat_sessions", "id", ["client_id"]).select("id", "client_id").orderBy("client_id", "id").offset(40).limit(20)
