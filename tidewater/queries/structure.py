"""Structure, lookup and hold queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.operators import cargo as cg
from tidewater.operators import structure as so
from tidewater.queries.registry import Registry
from tidewater.queries.texts import _CHUNKS, _SLUG, chunks
from tidewater.queries.usage import _FILES, current_files
from tidewater.sources.tables import first_rows, table

query = Registry()

_VESSELS = "(SELECT * FROM vessels QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"


def vessels(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_rows(table(spark, d, "vessels"), "id", list(columns)).drop("first_loaded")


#: Headings of the documents that open parts (fixed values).
PARTS = [(r"^\d+\.\s+(?:DEMURRAGE|LAYDAYS|OVERTIME)$", "time"), (r"^\d+\.\s+(?:HOLD CLEANING|DECK STRENGTH|LIFTING GEAR|CARGO EXCLUSIONS)$", "cargo"), (r"^\d+\.\s+[A-Z /&-]+$", "other")]
_PARTS_SQL = """
SELECT doc_id, k - 1 AS line_no, line, CASE WHEN regexp_matches(trim(line), '(?i)^[0-9]+\\.\\s+(?:DEMURRAGE|LAYDAYS|OVERTIME)$') THEN 'time'
    WHEN regexp_matches(trim(line), '(?i)^[0-9]+\\.\\s+(?:HOLD CLEANING|DECK STRENGTH|LIFTING GEAR|CARGO EXCLUSIONS)$') THEN 'cargo'
    WHEN regexp_matches(trim(line), '(?i)^[0-9]+\\.\\s+[A-Z /&-]+$') THEN 'other' END AS part
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL)
"""
_FILLED_SQL = f"SELECT doc_id, line_no, line, p.part AS part, p.start AS start FROM (SELECT *, last_value(CASE WHEN part IS NOT NULL THEN struct_pack(part := part, start := line_no) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM ({_PARTS_SQL}))"


@query("document_parts", f"SELECT doc_id, line_no, part FROM ({_FILLED_SQL}) WHERE part IS NOT NULL")
def document_parts(spark: SparkSession, d: str) -> DataFrame:
    lines = so.text_rows(table(spark, d, "documents"), "doc_id", "text")
    return so.assign_parts(lines, "doc_id", PARTS).where("part is not null").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "part")


@query(
    "part_bodies",
    f"""
WITH f AS (SELECT * FROM ({_FILLED_SQL}) WHERE part IS NOT NULL AND line_no > start AND trim(line, ' ') <> '')
SELECT doc_id, part, string_agg(line, chr(10) ORDER BY line_no) AS body FROM f JOIN (SELECT doc_id, part, max(start) AS start FROM f GROUP BY 1, 2) USING (doc_id, part, start) GROUP BY 1, 2
""",
)
def part_bodies(spark: SparkSession, d: str) -> DataFrame:
    lines = so.text_rows(table(spark, d, "documents"), "doc_id", "text")
    return so.part_bodies(so.assign_parts(lines, "doc_id", PARTS), "doc_id")


@query(
    "backfilled_files",
    f"""
SELECT f.id, coalesce(f.vessel_id, v.id) AS vessel_id FROM {_FILES} f
LEFT JOIN (SELECT client_id, name, min(id) AS id FROM {_VESSELS} GROUP BY 1, 2) v ON v.client_id = f.client_id AND v.name = f.group_name
""",
)
def backfilled_files(spark: SparkSession, d: str) -> DataFrame:
    """Files without a vessel take the first one of their client and group name."""
    v = vessels(spark, d, "client_id", "name").select("client_id", F.col("name").alias("group_name"), F.col("id").alias("_vid"))
    return so.first_match_backfill(current_files(spark, d), v, ["client_id", "group_name"], "vessel_id", "_vid", "_vid").select("id", "vessel_id")


@query(
    "preferred_vessels",
    f"""
SELECT slug, id, name FROM (SELECT {_SLUG.format("trim(name)")} AS slug, id, name, row_number() OVER (PARTITION BY {_SLUG.format("trim(name)")} ORDER BY CASE WHEN holds_json IS NOT NULL THEN 0 ELSE 1 END, name, id) AS k FROM {_VESSELS}) WHERE k = 1
""",
)
def preferred_vessels(spark: SparkSession, d: str) -> DataFrame:
    """One vessel per slug: with holds if there is one, then by name and id."""
    v = vessels(spark, d, "name", "holds_json")
    p = so.preferred(v, tx.slug(F.col("name")), F.col("holds_json").isNotNull(), ["name", "id"])
    return p.select(F.col("_k").alias("slug"), "id", "name")


_HOLDS = f"""
SELECT v.id AS vessel_id, coalesce(CAST(json_extract(h, '$.id') AS INT), 0) AS id, CAST(json_extract(h, '$.length') AS DOUBLE) AS length, CAST(json_extract(h, '$.breadth') AS DOUBLE) AS breadth, CAST(json_extract(h, '$.height') AS DOUBLE) AS height
FROM (SELECT id, unnest(CAST(holds_json AS JSON[])) AS h FROM {_VESSELS} WHERE holds_json IS NOT NULL AND json_valid(holds_json)) v
"""


def holds(spark: SparkSession, d: str) -> DataFrame:
    return so.parse_holds(vessels(spark, d, "holds_json").withColumnRenamed("id", "vessel_id"), "vessel_id", "holds_json")


@query("vessel_holds", f"SELECT vessel_id, id, length, breadth, height FROM ({_HOLDS}) WHERE length > 0 AND breadth > 0 AND height > 0")
def vessel_holds(spark: SparkSession, d: str) -> DataFrame:
    return holds(spark, d).select("vessel_id", "id", "length", "breadth", "height")


@query(
    "vessel_bins",
    f"""
WITH h AS (SELECT *, length * breadth * height AS v FROM ({_HOLDS}) WHERE length > 0 AND breadth > 0 AND height > 0),
w AS (SELECT id AS vessel_id, CASE WHEN t < 100000 THEN t * 1000 ELSE t END AS kg FROM (SELECT id, TRY_CAST(nullif(regexp_extract(replace(lower(dwat), ',', ''), '([0-9.]+)', 1), '') AS DOUBLE) AS t FROM {_VESSELS}))
SELECT vessel_id, id AS hold_id, CAST(id AS VARCHAR) AS bin_id, v AS volume_m3, round(CASE WHEN kg > 0 THEN kg * 0.95 * v / sum(v) OVER (PARTITION BY vessel_id) ELSE v * 700.0 END, 4) AS max_weight_kg FROM h LEFT JOIN w USING (vessel_id)
""",
)
def vessel_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins of every vessel's holds; its deadweight, where it is known, is their ceiling."""
    w = vessels(spark, d, "dwat").select(F.col("id").alias("vessel_id"), cg.parse_deadweight_kg(F.col("dwat")).alias("kg"))
    b = cg.hold_bins(holds(spark, d).join(w, "vessel_id", "left"), "kg")
    return b.select("vessel_id", "hold_id", "bin_id", "volume_m3", F.round("max_weight_kg", 4).alias("max_weight_kg"))


@query(
    "hold_capacity_check",
    f"""
SELECT v.id, v.hold_capacity_m3 AS stated, round(sum(h.length * h.breadth * h.height), 4) AS summed FROM {_VESSELS} v JOIN ({_HOLDS}) h ON h.vessel_id = v.id
WHERE v.hold_capacity_m3 IS NOT NULL AND h.length > 0 AND h.breadth > 0 AND h.height > 0 GROUP BY 1, 2
""",
)
def hold_capacity_check(spark: SparkSession, d: str) -> DataFrame:
    """Stated hold capacity against the holds' volumes."""
    g = holds(spark, d).groupBy("vessel_id").agg(F.round(F.sum(F.col("length") * F.col("breadth") * F.col("height")), 4).alias("summed"))
    v = vessels(spark, d, "hold_capacity_m3").where("hold_capacity_m3 is not null")
    return v.join(g, F.col("id") == F.col("vessel_id")).select("id", F.col("hold_capacity_m3").alias("stated"), "summed")


@query(
    "file_classes",
    f"SELECT client_id, CASE WHEN regexp_matches(lower(filename), '\\.(docx|pdf)$') THEN 'vessel' WHEN regexp_matches(lower(filename), '\\.xlsx?$') THEN 'agency' ELSE 'vessel' END AS kind, count(*) AS n FROM (SELECT id, arg_min(client_id, loaded_at) AS client_id, arg_min(filename, loaded_at) AS filename FROM document_files GROUP BY id) GROUP BY 1, 2",
)
def file_classes(spark: SparkSession, d: str) -> DataFrame:
    f = first_rows(table(spark, d, "document_files"), "id", ["client_id", "filename"])
    return f.select("client_id", so.file_class(F.col("filename"), F.lit("")).alias("kind")).groupBy("client_id", "kind").agg(F.count("*").alias("n"))


@query(
    "object_keys",
    f"SELECT id, 'files/' || {_SLUG.format('client_id')} || '/' || {_SLUG.format(chr(39).join(['regexp_replace(filename, ', chr(92) + '.[^.]*$', ', ', '', ')']))} || lower(regexp_extract(filename, '(\\.[A-Za-z0-9]+)$', 1)) AS key FROM (SELECT id, arg_min(client_id, loaded_at) AS client_id, arg_min(filename, loaded_at) AS filename FROM document_files GROUP BY id)",
)
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    f = first_rows(table(spark, d, "document_files"), "id", ["client_id", "filename"])
    return f.select("id", so.object_key("files", F.col("client_id"), F.col("filename")).alias("key"))


@query("valid_history", "SELECT id, trim(content, ' ') AS content FROM (SELECT id, arg_min(role, loaded_at) AS role, arg_min(content, loaded_at) AS content FROM chat_messages GROUP BY id) WHERE role IN ('user', 'assistant') AND content IS NOT NULL AND trim(content, ' ') <> ''")
def valid_history(spark: SparkSession, d: str) -> DataFrame:
    m = first_rows(table(spark, d, "chat_messages").where("role is not null"), "id", ["role", "content"])
    return so.valid_history(m).select("id", "content")


@query(
    "moved_items",
    """
SELECT id, CASE WHEN id % 9 = 0 THEN coalesce(x, 0) + 1 ELSE x END AS x, y FROM (SELECT * FROM placed_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) WHERE hold_id IS NOT NULL
""",
)
def moved_items(spark: SparkSession, d: str) -> DataFrame:
    """Proposed moves laid over the stored layout."""
    p = first_rows(table(spark, d, "placed_items"), "id", ["hold_id", "x", "y"]).drop("first_loaded").where("hold_id is not null")
    moves = p.where("id % 9 = 0").select("id", (F.coalesce("x", F.lit(0.0)) + 1).alias("x"), F.lit(None).cast("double").alias("y"))
    return so.overlay(p, moves, "id", ["x", "y"])[0].select("id", "x", "y")


@query(
    "manifest_colours",
    "SELECT manifest_id, ['red', 'green', 'blue'][CAST((row_number() OVER (ORDER BY manifest_id) - 1) % 3 + 1 AS INT)] AS colour FROM (SELECT DISTINCT manifest_id FROM placed_items)",
)
def manifest_colours(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "placed_items").select("manifest_id").distinct()
    ranked = cg.global_positions(m.withColumn("_b", F.floor(F.col("manifest_id") / 1000)), ["_b", "manifest_id"])
    return ranked.select("manifest_id", so.palette(F.col("position"), ["red", "green", "blue"]).alias("colour"))


@query("chunk_metadata")
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata and enriched text of every chunk."""
    c = chunks(spark, d, "document_id", "position", "title", "body")
    f = first_rows(table(spark, d, "document_files"), "id", ["group_name", "document_category"]).select(F.col("id").alias("document_id"), "group_name", "document_category")
    j = c.join(f, "document_id", "left")
    kind = tx.clause_type(F.col("title"), F.col("body"))
    words = tx.keywords(F.col("body"), ["hire", "bunkers", "laytime", "demurrage"], [r"\b([a-z]{2}-\d{5})\b"])
    meta = so.metadata({"vessel": F.col("group_name"), "section": F.col("document_category"), "title": F.col("title"), "clause_type": kind, "struck": F.contains("body", F.lit("~~"))})
    return j.select("id", meta.alias("metadata"), so.enriched_text({"Vessel": F.col("group_name"), "Section": F.col("title")}, F.col("body"), words).alias("text"))


@query(
    "document_particulars",
    "SELECT o_custkey, field, arg_min(value, o_orderkey) AS value FROM (SELECT o_custkey, o_orderkey, unnest(['gross_tonnage', 'imo_number', 'flag_state']) AS field, unnest([CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END, CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 7, '9') END, o_orderstatus]) AS value FROM orders) WHERE value IS NOT NULL GROUP BY 1, 2",
)
def document_particulars(spark: SparkSession, d: str) -> DataFrame:
    """Particulars in texts made from orders, the first of each customer."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("Flag state: "), F.col("o_orderstatus"), F.lit(" | "), F.when(k % 2 == 0, F.concat(F.lit("Gross tonnage (int.): "), k.cast("string"), F.lit("\n"))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("IMO no. "), F.lpad(k.cast("string"), 7, "9"))).otherwise("")
    )
    return so.particulars(table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit("Tonnage").alias("t"), text.alias("b")), "o_custkey", "o_orderkey", "t", "b")


#: Phrases that make two texts more alike (fixed values).
PHRASES = ["speed", "consumption", "fuel", "knots", "lifting", "equipment", "crane"]


@query("best_sections")
def best_sections(spark: SparkSession, d: str) -> DataFrame:
    """For every item of the held-out sets the most similar one of the same suite with a higher id."""
    e = table(spark, d, "eval_items")
    left = e.select("suite", F.col("item_id").alias("section_id"), F.col("text").alias("section_text"))
    right = e.select("suite", F.col("item_id").alias("table_id"), F.col("text").alias("table_text"))
    score = tx.phrase_score(F.col("section_text"), F.col("table_text"), PHRASES)
    return so.best_match(left, right, ["suite"], "section_id", "table_id", score, 0.0, F.col("table_id") > F.col("section_id"))


@query("titled_share", f"SELECT document_id, count(*) AS chunks, count(*) FILTER (title IS NOT NULL AND title <> '') AS titled FROM {_CHUNKS} WHERE document_id IS NOT NULL GROUP BY 1")
def titled_share(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "title").where("document_id is not null")
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("title").isNotNull() & (F.col("title") != "")).alias("titled"))
