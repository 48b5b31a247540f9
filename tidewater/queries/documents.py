"""Nested cost, grid, layout, sink and streaming queries on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import costs as co
from tidewater.operators import grids as gr
from tidewater.operators import layout as la
from tidewater.queries.registry import Registry
from tidewater.queries.texts import _CHUNKS, chunks
from tidewater.session import cut_lineage, spread
from tidewater.sources import sinks
from tidewater.sources.tables import first_rows, table
from tidewater.streaming import streams

query = Registry()


_MADE: dict[tuple[str, str], DataFrame] = {}


def statements(spark: SparkSession, d: str) -> DataFrame:
    """``_nested``, written once per application and folder: the operators read nested statements, they do not make them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MADE:
        _MADE[key] = cut_lineage(_nested(spark, d))
    return _MADE[key]


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cost statements: return flag as category, line as item, status as stage, the part's parity as persona."""
    li = table(spark, d, "lineitem")
    stage = F.when(F.col("l_linestatus") == "O", "PDA").otherwise("FDA")
    persona = F.when(F.col("l_partkey") % 2 == 0, "OPERATOR").otherwise("AGENT")
    cost = F.array(F.struct(stage.alias("stage"), persona.alias("persona"), F.col("l_extendedprice").alias("amount")), F.struct(F.lit("SDA").alias("stage"), F.lit("AGENT").alias("persona"), F.col("l_tax").alias("amount")))
    remarks = F.when(F.col("l_quantity") > 40, F.array(F.struct(F.lit("large").alias("text"), F.lit("desk").alias("author")))).otherwise(F.array().cast("array<struct<text: string, author: string>>"))
    item = F.struct(F.col("l_linenumber").cast("string").alias("name"), cost.alias("costs"), remarks.alias("comments"))
    cats = li.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", item.alias("i")))).alias("x"))
    cats = cats.select("l_orderkey", F.struct(F.col("l_returnflag").alias("name"), F.transform("x", lambda e: e["i"]).alias("items")).alias("c"))
    return cats.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("c")).alias("categories")).select(F.col("l_orderkey").alias("statement_id"), F.lit("USD").alias("currency"), "categories")


_AMOUNT = "CASE WHEN l_linestatus = 'O' AND l_partkey % 2 = 0 THEN l_extendedprice WHEN l_linestatus = 'F' AND l_partkey % 2 = 0 THEN l_extendedprice ELSE l_extendedprice + l_tax END"


@query("cost_breakdown", f"SELECT l_orderkey AS statement_id, l_returnflag AS category, CAST(l_linenumber AS VARCHAR) AS item, round({_AMOUNT}, 4) AS amount FROM lineitem")
def cost_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return co.breakdown(statements(spark, d)).select("statement_id", "category", "item", F.round("amount", 4).alias("amount"))


@query("cost_scores", f"SELECT l_orderkey AS statement_id, CAST(l_linenumber AS VARCHAR) AS item, CASE WHEN l_quantity > 40 THEN 10 ELSE 0 END + CASE WHEN {_AMOUNT} > 0 THEN 1 ELSE 0 END AS content_score FROM lineitem WHERE {_AMOUNT} > 0 OR l_quantity > 40")
def cost_scores(spark: SparkSession, d: str) -> DataFrame:
    return co.meaningful(co.breakdown(statements(spark, d))).select("statement_id", "item", "content_score")


@query("statement_totals", f"SELECT l_orderkey AS statement_id, round(sum({_AMOUNT}), 2) AS total, 'USD' AS currency FROM lineitem WHERE {_AMOUNT} > 0 GROUP BY 1")
def statement_totals(spark: SparkSession, d: str) -> DataFrame:
    return co.statement_totals(co.breakdown(statements(spark, d))).withColumn("total", F.round("total", 2))


@query("cost_notes")
def cost_notes(spark: SparkSession, d: str) -> DataFrame:
    return co.notes(co.breakdown(statements(spark, d)))


@query(
    "port_candidates",
    """
SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, min(c_custkey)) AS k FROM customer GROUP BY 1, 2) WHERE k = 1
""",
)
def port_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The commonest segment per nation, of equals the first seen."""
    return co.commonest(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")


@query(
    "exact_or_fuzzy",
    """
WITH h AS (SELECT p_brand, p_partkey, p_type = 'PROMO' AND p_size = 1 AS e, contains(p_type, 'PROMO') AS f FROM part)
SELECT p_brand, p_partkey FROM h JOIN (SELECT p_brand, bool_or(e) AS any_e FROM h WHERE e OR f GROUP BY 1) a USING (p_brand) WHERE (e OR f) AND (e OR NOT any_e)
""",
)
def exact_or_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return co.exact_or_fuzzy(p, "p_brand", (F.col("p_type") == "PROMO") & (F.col("p_size") == 1), F.contains("p_type", F.lit("PROMO"))).select("p_brand", "p_partkey")


def manifest_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every manifest as a packing list: one to three title rows, a header row, its items, a blank row, one without sizes, and a totals row."""
    it = first_rows(table(spark, d, "placed_items"), "id", ["manifest_id", "item_position", "item_id", "l", "w", "h", "weight_kg"]).drop("first_loaded")
    heads = ["PL N°", "Length (mm)", "Width (mm)", "Height (mm)", "Gross weight"]
    arr = lambda *v: F.array(*[F.lit(x) if isinstance(x, str) else x for x in v])
    mm = lambda c: F.round(F.col(c) * 1000, 0).cast("long").cast("string")
    rows = it.select("manifest_id", (F.col("item_position") + 4).alias("r"), F.array(F.coalesce("item_id", F.lit("")), mm("l"), mm("w"), mm("h"), F.col("weight_kg").cast("string")).alias("v"))
    m = it.select("manifest_id").distinct()
    top = m.select("manifest_id", F.explode(F.sequence(F.lit(0), (F.col("manifest_id") % 3).cast("int"))).alias("r"), arr("Shipper", "", "", "", "").alias("v"))
    head = m.select("manifest_id", (F.col("manifest_id") % 3 + 1).cast("int").alias("r"), F.when(F.col("manifest_id") % 2 == 0, arr(*heads)).otherwise(arr(*heads[:3], "Remarks", "x")).alias("v"))
    blank = m.select("manifest_id", F.lit(900_000).alias("r"), arr("", " ", "", "", "").alias("v"))
    flat = m.where("manifest_id % 4 = 0").select("manifest_id", F.lit(900_001).alias("r"), arr("A-1", "0", "0", "", "5").alias("v"))
    foot = m.select("manifest_id", F.lit(1_000_000).alias("r"), arr("TOTAL", "", "", "", "1").alias("v"))
    e = rows.unionByName(top).unionByName(head).unionByName(blank).unionByName(flat).unionByName(foot)
    return e.select(F.col("manifest_id").cast("string").alias("sheet_id"), "r", F.posexplode("v").alias("c", "value"))


@query("grid_headers", "SELECT CAST(manifest_id AS VARCHAR) AS sheet_id, CAST(manifest_id % 3 + 1 AS INT) AS header_row, CASE WHEN manifest_id % 2 = 0 THEN 9 ELSE 6 END AS score FROM placed_items WHERE manifest_id IS NOT NULL GROUP BY manifest_id")
def grid_headers(spark: SparkSession, d: str) -> DataFrame:
    return gr.find_headers(manifest_cells(spark, d)).select("sheet_id", "header_row", "score")


@query("grid_items")
def grid_items(spark: SparkSession, d: str) -> DataFrame:
    return gr.parse_items(manifest_cells(spark, d))


@query(
    "grid_skips",
    """
WITH i AS (SELECT id, arg_min(manifest_id, loaded_at) AS manifest_id, arg_min(l, loaded_at) AS l, arg_min(w, loaded_at) AS w, arg_min(h, loaded_at) AS h FROM (SELECT id, manifest_id, coalesce(l, -1) AS l, coalesce(w, -1) AS w, coalesce(h, -1) AS h, loaded_at FROM placed_items) GROUP BY id),
m AS (SELECT DISTINCT manifest_id FROM i WHERE manifest_id IS NOT NULL)
SELECT CAST(manifest_id AS VARCHAR) AS sheet_id, skipped, count(*) AS n FROM (
  SELECT manifest_id, 'totals' AS skipped FROM m UNION ALL SELECT manifest_id, 'blank' FROM m UNION ALL SELECT manifest_id, 'no dimensions' FROM m WHERE manifest_id % 4 = 0
  UNION ALL SELECT manifest_id, 'no dimensions' FROM i WHERE manifest_id IS NOT NULL AND l <= 0 AND w <= 0 AND (h <= 0 OR manifest_id % 2 = 1)) GROUP BY 1, 2
""",
)
def grid_skips(spark: SparkSession, d: str) -> DataFrame:
    """Rows left out of the items, by reason."""
    return gr.parse_items(manifest_cells(spark, d)).where("skipped is not null").groupBy("sheet_id", "skipped").agg(F.count("*").alias("n"))


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as page elements: two columns, headings in a larger font, a margin of line numbers."""
    c = chunks(spark, d, "document_id", "position", "title").where("document_id is not null")
    body = c.select(
        F.col("document_id").alias("doc_id"), F.floor(F.col("position") / 20).cast("int").alias("page"), F.coalesce("title", F.lit("text")).alias("text"),
        F.when(F.col("position") % 20 < 10, 60.0).otherwise(320.0).alias("x"), (F.col("position") % 10 * 12.0 + F.col("id") % 3).alias("y"), F.when(F.col("position") % 20 == 0, 14.0).otherwise(10.0).alias("size"), F.lit(False).alias("is_bold"),
    )
    margin = c.select(F.col("document_id").alias("doc_id"), F.floor(F.col("position") / 20).cast("int").alias("page"), (F.col("position") % 900 + 1).cast("string").alias("text"), F.lit(20.0).alias("x"), (F.col("position") * 12.0).alias("y"), F.lit(8.0).alias("size"), F.lit(False).alias("is_bold"))
    return body.unionByName(margin)


@query(
    "body_sizes",
    f"""
WITH s AS (SELECT document_id AS doc_id, round((8 + length(coalesce(title, '')) % 5 * 0.3) * 2) / 2 AS s, count(*) AS n FROM {_CHUNKS} WHERE document_id IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, CAST(s AS DOUBLE) AS body_size FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) = 1
""",
)
def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The commonest size of elements whose size depends on their text."""
    c = chunks(spark, d, "document_id", "title").where("document_id is not null")
    return la.body_size(c.select(F.col("document_id").alias("doc_id"), (8 + F.char_length(F.coalesce("title", F.lit(""))) % 5 * 0.3).alias("size")))


@query("column_splits")
def column_splits(spark: SparkSession, d: str) -> DataFrame:
    return la.column_split(elements(spark, d))


@query("margin_columns")
def margin_columns(spark: SparkSession, d: str) -> DataFrame:
    return la.margin_numbers(elements(spark, d))


@query("heading_chunks")
def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d)
    pages = e.select("doc_id", "page").distinct().withColumn("height", F.lit(800.0))
    return la.heading_chunks(la.global_axis(e, pages)).select("doc_id", "chunk", "title", "lines")


@query("text_lines")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return la.text_lines(elements(spark, d))


@query(
    "markdown_documents",
    f"""
SELECT document_id, CAST((k - 1) // 1000 AS INT) AS block, string_agg('## ' || coalesce(title, 'Untitled') || chr(10) || chr(10) || coalesce(body, ''), chr(10) || chr(10) ORDER BY id) AS body
FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS k FROM {_CHUNKS} WHERE document_id IS NOT NULL) GROUP BY 1, 2
""",
)
def markdown_documents(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown(chunks(spark, d, "document_id", "title", "body").where("document_id is not null"), "document_id", "id")


@query("usage_windows", "SELECT event_type, date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end, count(*) AS requests, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def usage_windows(spark: SparkSession, d: str) -> DataFrame:
    """The batch run of the streaming window aggregate."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = streams.usage_windows(e, "ts", "event_type", "value")
    return w.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "requests", F.round("total", 4).alias("total"))


@query("stream_usage", query.sql["usage_windows"])
def stream_usage(spark: SparkSession, d: str) -> DataFrame:
    """The same windows from a stream of the table's file, drained."""
    e = streams.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = streams.drain(streams.usage_windows(e, "ts", "event_type", "value"), "stream_usage", "complete")
    return w.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "requests", F.round("total", 4).alias("total"))


@query("stream_quota", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests, count(*) >= 3 AS exhausted FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_quota(spark: SparkSession, d: str) -> DataFrame:
    e = streams.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.drain(streams.daily_quota(e, "ts", "user_id", 3), "stream_quota", "complete")


@query("stream_waits")
def stream_waits(spark: SparkSession, d: str) -> DataFrame:
    """Waits under a limit of 150 tokens an hour and user."""
    e = streams.table_stream(spark, d, "events").withColumn("tokens", F.get_json_object("props", "$.k").try_cast("long"))
    return streams.drain(streams.limit_rate(e, "user_id", "ts", "tokens", 150, 3600), "stream_waits")


@query(
    "task_sessions",
    """
WITH g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 600 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE ts IS NOT NULL))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 600 SECOND AS end, count(*) AS events, bool_or(event_type = 'done') AS done FROM g GROUP BY user_id, s
""",
)
def task_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = streams.progress_sessions(e, "ts", "user_id")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events", "done")


@query("chunk_embeddings")
def chunk_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embedding of every chunk's body, one row per id."""
    return streams.embed_batches(spread(chunks(spark, d, "body"), "id"), "id", "body", streams.hashed_embedding)
