"""Text queries on document_chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.queries.registry import Registry
from tidewater.sources.tables import first_rows, table

query = Registry()

_CHUNKS = "(SELECT * FROM document_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per chunk id with the needed columns only."""
    return first_rows(table(spark, d, "document_chunks"), "id", list(columns)).drop("first_loaded")


_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(
    "text_counts",
    f"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> ''))::INT AS words, len(string_split(coalesce(text, ''), chr(10)))::INT AS lines, coalesce(length(text), 0)::INT AS chars FROM documents",
)
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", tx.word_count(F.col("text")).alias("words"), tx.line_count(F.col("text")).alias("lines"), F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"))


@query(
    "content_hashes",
    f"SELECT id, substr(md5(trim(regexp_replace(lower(body), '{_WS}', ' ', 'g'))), 1, 12) AS hash FROM {_CHUNKS}",
)
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "body").select("id", tx.content_hash(F.col("body")).alias("hash"))


_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


_BARE_TITLE = r"regexp_replace(trim(coalesce(title, '')), '^[0-9]+[.—\s-]+', '')"


@query("title_slugs", f"SELECT id, substr({_SLUG.format(_BARE_TITLE)}, 1, 40) AS slug FROM {_CHUNKS}")
def title_slugs(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "title").select("id", tx.slug(F.col("title"), 40, True).alias("slug"))


@query("vessel_slugs", f"SELECT id, {_SLUG.format('trim(name)')} AS slug FROM (SELECT id, arg_min(name, loaded_at) AS name FROM vessels GROUP BY id)")
def vessel_slugs(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "vessels"), "id", ["name"]).select("id", tx.slug(F.col("name")).alias("slug"))


@query("vessel_names")
def vessel_names(spark: SparkSession, d: str) -> DataFrame:
    v = first_rows(table(spark, d, "vessels"), "id", ["name"])
    return v.select("id", tx.display_name(tx.slug(F.col("name"))).alias("name"), tx.ascii_id(F.col("name")).alias("ascii_id"), tx.key_hash(F.col("name")).alias("key"))


def _rules_sql(rules: list, column: str, other: str) -> str:
    whens = " ".join("WHEN " + " AND ".join([f"contains({column}, '{w}')" for w in need] + [f"NOT contains({column}, '{w}')" for w in bar]) + f" THEN '{n}'" for n, need, bar in rules)
    return f"CASE {whens} ELSE {other} END"


_TYPE = _rules_sql(tx.TITLE_RULES, "lower(coalesce(title, ''))", _rules_sql(tx.CONTENT_RULES, "lower(coalesce(body, ''))", "'general'"))


@query("clause_types", f"SELECT kind, count(*) AS n FROM (SELECT {_TYPE} AS kind FROM {_CHUNKS}) GROUP BY 1")
def clause_types(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "title", "body")
    return c.select(tx.clause_type(F.col("title"), F.col("body")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "clause_headings",
    f"""
SELECT id, CASE WHEN regexp_matches(t, '^[0-9]{{1,3}}\\.\\s+.+$') THEN CAST(regexp_extract(t, '^([0-9]{{1,3}})\\.', 1) AS INT) END AS number,
  CASE WHEN regexp_matches(t, '^[0-9]{{1,3}}\\.\\s+.+$') THEN trim(regexp_extract(t, '^[0-9]{{1,3}}\\.\\s+(.+)$', 1)) END AS heading
FROM (SELECT id, trim(title) AS t FROM {_CHUNKS})
""",
)
def clause_headings(spark: SparkSession, d: str) -> DataFrame:
    number, title = tx.clause_heading(F.col("title"))
    return chunks(spark, d, "title").select("id", number.alias("number"), title.alias("heading"))


@query("title_frequency", f"SELECT title, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM {_CHUNKS} WHERE title IS NOT NULL AND trim(title) <> '' GROUP BY 1")
def title_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each clause title occurs, and in how many documents."""
    c = chunks(spark, d, "title", "document_id").where("title is not null and trim(title) <> ''")
    g = c.groupBy("title", "document_id").agg(F.count("*").alias("n"))
    return g.groupBy("title").agg(F.sum("n").alias("chunks"), F.count("document_id").alias("documents"))


@query(
    "significant_words",
    "SELECT item_id, list_transform(regexp_extract_all(regexp_replace(text, '^[0-9]+[.)]\\s*', ''), '\\b([a-zA-Z]{4,})\\b', 1), lambda x: lower(x)) AS words FROM eval_items",
)
def significant_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", tx.significant_words(F.col("text")).alias("words"))


@query(
    "junk_bodies",
    f"""
SELECT id FROM (SELECT id, body, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM {_CHUNKS})
WHERE len(ls) = 0 OR len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) < 3 OR len(list_filter(ls, lambda x: length(x) <= 2)) * 1.0 / len(ls) > 0.6
""",
)
def junk_bodies(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "body").where(tx.is_junk(F.col("body"))).select("id")


@query(
    "session_labels",
    "SELECT id, CASE WHEN length(content) > 60 THEN substr(content, 1, 60) || '…' ELSE content END AS label FROM (SELECT id, arg_min(content, loaded_at) AS content FROM chat_messages GROUP BY id)",
)
def session_labels(spark: SparkSession, d: str) -> DataFrame:
    m = first_rows(table(spark, d, "chat_messages"), "id", ["content"])
    return m.select("id", tx.shorten(F.col("content")).alias("label"))


@query(
    "prefixed_titles",
    f"SELECT id, CASE WHEN starts_with(coalesce(title, ''), 'Recap') THEN title WHEN trim(coalesce(title, '')) = '' THEN 'Recap' ELSE 'Recap - ' || title END AS title FROM {_CHUNKS}",
)
def prefixed_titles(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "title").select("id", tx.prefixed_title(F.col("title"), F.lit("Recap")).alias("title"))


@query(
    "port_matches",
    """
WITH q AS (SELECT n_nationkey, n_name, lower(trim(regexp_replace(regexp_replace(n_name, '[^A-Za-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM nation),
c AS (SELECT s_suppkey, s_name, lower(trim(regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS t, s_nationkey FROM supplier)
SELECT s_suppkey, n_name, CASE WHEN c.t = q.t THEN 'exact' WHEN starts_with(c.t, q.t) THEN 'prefix' WHEN list_has_all(string_split(c.t, ' '), string_split(q.t, ' ')) THEN 'token-subset' END AS how
FROM c JOIN q ON c.s_nationkey = q.n_nationkey
""",
)
def port_matches(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("s_suppkey", "n_name", tx.port_match(F.col("n_name"), F.col("s_name")).alias("how"))


@query("call_signs", "SELECT id, imo_number, regexp_matches(coalesce(call_sign, ''), '^[A-Z0-9]{4,7}$') AS plain_call_sign FROM (SELECT id, arg_min(imo_number, loaded_at) AS imo_number, arg_min(call_sign, loaded_at) AS call_sign FROM vessels GROUP BY id)")
def call_signs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vessels").where("id is not null").groupBy("id").agg(F.min_by("imo_number", "loaded_at").alias("imo_number"), F.min_by("call_sign", "loaded_at").alias("call_sign"))
    return v.select("id", "imo_number", F.coalesce(F.col("call_sign").rlike("^[A-Z0-9]{4,7}$"), F.lit(False)).alias("plain_call_sign"))


@query("ligature_repair")
def ligature_repair(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text the ligature repair changes."""
    t = table(spark, d, "documents").where("text is not null")
    r = t.select("doc_id", "text", tx.repair_ligatures(F.col("text")).alias("repaired"))
    return r.where("text <> repaired").select("doc_id", "repaired")


@query("vector_ids")
def vector_ids(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "title", "position", "document_id")
    f = first_rows(table(spark, d, "document_files"), "id", ["client_id", "group_name", "document_category"]).withColumnRenamed("id", "document_id").drop("first_loaded")
    j = c.join(f, "document_id")
    legacy, unique = tx.vector_id(F.col("client_id"), F.col("group_name"), F.lit(0), F.col("document_category"), F.col("title"), F.col("position"))
    return j.select("id", legacy.alias("legacy_id"), unique.alias("vector_id"))


def _first(text: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '{p}', 1), '')" for p in patterns) + ")"


_INITCAP = "list_aggregate(list_transform(string_split({0}, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ')"
_PORT, _SHIP, _DATE = _first("q", ["port\\s+(\\w+)", "in\\s+(\\w+)\\s+port", "(\\w+)\\s+port"]), _first("q", ["ship\\s+(\\w+)", "(\\w+)\\s+ship"]), _first("q", ["(\\d{4}-\\d{2}-\\d{2})", "(\\d{2}/\\d{2}/\\d{4})", "(\\d{2}-\\d{2}-\\d{4})"])


@query(
    "question_parameters",
    f"SELECT id, {_INITCAP.format(_PORT)} AS port, CASE WHEN NOT contains(q, 'vessel') THEN {_INITCAP.format(_SHIP)} END AS vessel, {_DATE} AS date FROM (SELECT id, lower(trim(arg_min(coalesce(content, ''), loaded_at))) AS q FROM chat_messages GROUP BY id)",
)
def question_parameters(spark: SparkSession, d: str) -> DataFrame:
    m = first_rows(table(spark, d, "chat_messages"), "id", ["content"])
    return m.select("id", tx.query_parameters(F.col("content")).alias("p")).select("id", "p.*")
