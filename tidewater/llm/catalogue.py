"""Queries of the operators on training text and item lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import conversations, garbling, leakage, packing, scans, splitting, stuffing, tokenizing
from tidewater.queries.registry import Query, Registry
from tidewater.sources.tables import table

query = Registry()


def queries() -> dict[str, Query]:
    return dict(query.queries)


def sql() -> dict[str, str]:
    return dict(query.sql)


@query("p7_found", "SELECT DISTINCT id AS chunk_id FROM document_chunks WHERE length(body) > 4000")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "document_chunks")).select("chunk_id").distinct()


@query("p7_pieces")
def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "document_chunks"))


@query(
    "p7_bodies",
    "SELECT DISTINCT id AS chunk_id, md5(body) AS body, true AS fits FROM document_chunks WHERE length(body) > 4000",
)
def p7_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies put together again from their pieces less the overlaps, and whether all pieces keep the limits."""
    p = splitting.split_oversized(table(spark, d, "document_chunks"))
    own = F.expr("substring(piece, overlap_chars + 1)")
    fits = (F.char_length("piece") <= splitting.LIMIT) & (F.col("overlap_chars") <= splitting.OVERLAP)
    g = p.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("part", own.alias("x")))).alias("v"), F.min(fits).alias("fits"))
    return g.select("chunk_id", F.md5(F.array_join(F.transform("v", lambda e: e["x"]), "")).alias("body"), "fits")


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.encode_corpus(table(spark, d, "documents"))


_ROLE = "CASE regexp_replace(lower(coalesce(role, '')), '^\\s+|\\s+$', '', 'g') WHEN 'human' THEN 'user' WHEN 'bot' THEN 'assistant' ELSE regexp_replace(lower(coalesce(role, '')), '^\\s+|\\s+$', '', 'g') END"
_SESSIONS_SQL = f"""
WITH m AS (SELECT DISTINCT session_id, {_ROLE} AS role, position, content FROM chat_messages WHERE session_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY session_id, role IN ('user', 'assistant') ORDER BY position) AS k,
        count(*) OVER (PARTITION BY session_id, role IN ('user', 'assistant')) AS n FROM m),
s AS (SELECT session_id,
        sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) > 0
        AND bool_and(role IN ('user', 'assistant', 'system'))
        AND bool_and(content IS NOT NULL AND trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> '')
        AND count(DISTINCT position) = count(*) AND min(position) = 0 AND max(position) = count(*) - 1
        AND bool_and(role NOT IN ('user', 'assistant') OR role = CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END)
        AND bool_and(role NOT IN ('user', 'assistant') OR n % 2 = 0) AS whole
      FROM t GROUP BY session_id),
i AS (SELECT id AS session_id FROM chat_sessions UNION SELECT session_id FROM chat_messages WHERE session_id IS NOT NULL)
"""


@query("p6_found", _SESSIONS_SQL + "SELECT i.session_id FROM i LEFT JOIN s USING (session_id) WHERE NOT coalesce(s.whole, false)")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    judged = conversations.judge_sessions(table(spark, d, "chat_messages"), table(spark, d, "chat_sessions"))
    return judged.where("reason is not null").select("session_id")


@query(
    "p6_turns",
    _SESSIONS_SQL + "SELECT t.session_id, t.k - 1 AS turn, t.role, t.content FROM t JOIN s USING (session_id) WHERE s.whole AND t.role IN ('user', 'assistant')",
)
def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "chat_messages"), table(spark, d, "chat_sessions"))


@query(
    "p6_sessions",
    _SESSIONS_SQL
    + """
, c AS (SELECT session_id, count(*) AS rows, count(*) FILTER (role IN ('user', 'assistant')) AS turns FROM m GROUP BY 1)
SELECT i.session_id, coalesce(c.rows, 0) AS rows, coalesce(c.turns, 0) AS turns, coalesce(s.whole, false) AS whole FROM i LEFT JOIN c USING (session_id) LEFT JOIN s USING (session_id)
""",
)
def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every session with its distinct rows and turns, and whether it is whole."""
    judged = conversations.judge_sessions(table(spark, d, "chat_messages"), table(spark, d, "chat_sessions"))
    return judged.select("session_id", "rows", "turns", F.col("reason").isNull().alias("whole"))


@query("p6_threads")
def p6_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads of the sessions whose positions do not give their order."""
    return conversations.threads(table(spark, d, "chat_messages")).drop("at")


def packed_items(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_items(table(spark, d, "placed_items"), table(spark, d, "cargo_bins"))


@query(
    "p2_found",
    """
SELECT DISTINCT i.id AS item_row_id FROM placed_items i JOIN cargo_bins b USING (bin_type)
WHERE i.weight_kg > b.max_weight_kg OR i.h > b.height
   OR (i.l IS NOT NULL AND i.w IS NOT NULL AND NOT ((i.l <= b.length AND i.w <= b.width) OR (i.w <= b.length AND i.l <= b.width)))
""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized_items(packed_items(spark, d))


@query("p2_containers")
def p2_containers(spark: SparkSession, d: str) -> DataFrame:
    return packed_items(spark, d)


_PACKED_SQL = """
WITH i AS (SELECT id, arg_min(struct_pack(m := manifest_id, b := bin_type, l := l, w := w, h := h, kg := weight_kg), loaded_at) AS r FROM placed_items GROUP BY id),
b AS (SELECT bin_type, max(length) AS length, max(width) AS width, max(height) AS height, max(max_weight_kg) AS most FROM cargo_bins GROUP BY 1)
"""


@query(
    "p2_items",
    _PACKED_SQL + "SELECT r.m AS manifest_id, count(*) AS items, round(sum(greatest(coalesce(r.kg, 0), 0)), 3) AS weight_kg, true AS within FROM i JOIN b ON b.bin_type = r.b WHERE r.m IS NOT NULL GROUP BY 1",
)
def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """Packed items and weight of each manifest, and whether every container keeps its weight and volume."""
    p = packed_items(spark, d)
    within = p.groupBy("manifest_id", "container").agg(F.max("fill").alias("fill")).groupBy("manifest_id").agg((F.max("fill") <= 1 + 1e-6).alias("within"))
    g = p.groupBy("manifest_id").agg(F.countDistinct("item_row_id").alias("items"), F.round(F.sum("weight_kg"), 3).alias("weight_kg"))
    return g.join(within, "manifest_id")


@query("p2_usage")
def p2_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers and mean used share per manifest and container type, beside the least number that volume and weight allow."""
    p = packed_items(spark, d).withColumn("bin_type", F.substring_index("container", "/", 1))
    b = table(spark, d, "cargo_bins").groupBy("bin_type").agg((F.max("length") * F.max("width") * F.max("height")).alias("_v"), F.max("max_weight_kg").alias("_kg"))
    boxes = p.groupBy("manifest_id", "bin_type", "container").agg(F.max("fill").alias("fill"), F.count("*").alias("pieces"), F.sum(F.col("l") * F.col("w") * F.col("h")).alias("v"), F.sum("weight_kg").alias("kg"))
    g = boxes.groupBy("manifest_id", "bin_type").agg(F.count("*").alias("containers"), F.round(F.avg("fill"), 6).alias("mean_fill"), F.sum("pieces").alias("pieces"), F.sum("v").alias("v"), F.sum("kg").alias("kg"))
    least = F.greatest(F.lit(1), F.ceil(F.col("v") / F.col("_v") - 1e-9), F.ceil(F.col("kg") / F.col("_kg") - 1e-9))
    return g.join(b, "bin_type").select("manifest_id", "bin_type", "containers", least.cast("long").alias("least"), "mean_fill", "pieces")


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return garbling.repair(table(spark, d, "document_chunks")).select("chunk_id").distinct()


@query("p5_restored")
def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbling.repair(table(spark, d, "document_chunks")).dropDuplicates(["chunk_id"])


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents")).select("doc_id").distinct()


@query("p10_measures")
def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.measure_pages(table(spark, d, "documents"))


_RUNS_SQL = """
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM iw WHERE len(w) > 11)),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM dw WHERE len(w) > 11))
"""


@query("p9_found", _RUNS_SQL + "SELECT DISTINCT doc_id, item_id FROM ig JOIN dg USING (g)")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@query("p9_leaks", _RUNS_SQL + "SELECT item_id, count(DISTINCT doc_id) AS documents FROM ig JOIN dg USING (g) GROUP BY 1")
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it."""
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


@query("p9_answers")
def p9_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item's longest run, and in how many documents its answer stands too."""
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.max("run").alias("longest_run"), F.count_if("answer").alias("with_answer"))


@query("p9_paraphrases")
def p9_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold most of an item's words in order without a run of them."""
    found = leakage.find_paraphrases(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("common").alias("common"), F.max("answer").alias("answer"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_rows(table(spark, d, "document_chunks")).select("chunk_id")


@query("p4_repaired")
def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_scans(table(spark, d, "document_chunks"))
