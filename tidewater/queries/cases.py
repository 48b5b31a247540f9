"""Operators on inputs made from the provided tables by expressions that both engines read, so that every branch occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.operators import analytics as an
from tidewater.operators import cargo as cg
from tidewater.operators import chunksets as cs
from tidewater.operators import classify as cl
from tidewater.operators import costs as co
from tidewater.operators import grids as gr
from tidewater.operators import layout as la
from tidewater.operators import sections as se
from tidewater.operators import segments as sg
from tidewater.operators import structure as so
from tidewater.plans import joint
from tidewater.queries.registry import Registry
from tidewater.queries.texts import _CHUNKS, chunks
from tidewater.queries.usage import _FILES, current_files
from tidewater.sources.tables import first_rows, table

query = Registry()

_FIRST_FILES = "(SELECT id, arg_min(filename, loaded_at) AS filename, arg_min(group_name, loaded_at) AS group_name FROM document_files GROUP BY id)"


def first_files(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "document_files"), "id", ["filename", "group_name"]).drop("first_loaded")


# Predicates and references.


@query("scoped_files", f"SELECT id FROM {_FILES} WHERE client_id = (SELECT min(client_id) FROM document_files)")
def scoped_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of one tenant."""
    first = table(spark, d, "document_files").agg(F.min("client_id")).first()[0]
    return an.scoped(current_files(spark, d), first).select("id")


@query("other_files", f"SELECT id FROM {_FIRST_FILES} WHERE NOT contains(lower(coalesce(filename, '')), 'willow') AND NOT contains(lower(coalesce(group_name, '')), 'willow')")
def other_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that neither by name nor by group are about one word."""
    return first_files(spark, d).where(tx.not_about("willow", F.col("filename"), F.col("group_name"))).select("id")


_ETA = "CASE WHEN o_orderkey % 7 = 0 THEN 'TBA' WHEN o_orderkey % 11 = 0 THEN NULL ELSE substr(cast(o_orderdate as varchar(40)), 1, 10) END"


@query("due_orders", f"SELECT o_orderkey FROM (SELECT o_orderkey, {_ETA} AS eta FROM orders) WHERE coalesce(year(TRY_CAST(eta AS DATE)) BETWEEN 1995 AND 1996, true)")
def due_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders due within two years; texts that are no dates pass."""
    o = table(spark, d, "orders").selectExpr("o_orderkey", _ETA.replace("varchar(40)", "string") + " as eta")
    return o.where(tx.year_within(F.col("eta"), 1995, 1996)).select("o_orderkey")


_REF = "CASE o_orderkey % 5 WHEN 0 THEN ' ab–' || lpad(cast(o_orderkey as varchar(20)), 6, '0') WHEN 1 THEN 'ABC-' || lpad(cast(o_orderkey as varchar(20)), 7, '0') || '—2' WHEN 2 THEN 'x-12' WHEN 3 THEN NULL ELSE 'AB' || cast(o_orderkey as varchar(20)) END"


@query(
    "references",
    f"SELECT o_orderkey, upper(trim(replace(replace(r, '–', '-'), '—', '-'))) AS reference, coalesce(regexp_full_match(upper(trim(replace(replace(r, '–', '-'), '—', '-'))), '[A-Z]{{2,3}}-[0-9]{{6,7}}(-[0-9]+)?'), false) AS valid FROM (SELECT o_orderkey, {_REF} AS r FROM orders)",
)
def references(spark: SparkSession, d: str) -> DataFrame:
    """References in their normal form, and whether they are any."""
    o = table(spark, d, "orders").selectExpr("o_orderkey", _REF.replace("varchar(20)", "string") + " as r")
    n = tx.normal_reference(F.col("r"))
    return o.select("o_orderkey", n.alias("reference"), tx.is_reference(n).alias("valid"))


@query("alternative_keys", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS known FROM orders")
def alternative_keys(spark: SparkSession, d: str) -> DataFrame:
    """One field under different names of a record."""
    k = F.col("o_orderkey") % 3
    record = F.create_map(F.when(k == 0, "reference").when(k == 1, "ref").otherwise("other"), F.when(k == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")), F.lit("referenceNumber"), F.lit(None).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", co.first_known(record, ["reference", "referenceNumber", "ref"]).alias("known"))


_PAIRS = [(5.0, 6.0), (10.0, 12.0), (20.0, 22.0)]


@query(
    "nearest_pairs",
    "SELECT p_partkey, arg_min(lo, (abs(lo + hi - p_size), lo)) AS lower FROM part CROSS JOIN (VALUES (5.0::DOUBLE, 6.0), (10.0, 12.0), (20.0, 22.0)) v(lo, hi) GROUP BY p_partkey",
)
def nearest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of fixed pairs the one whose sum is nearest to a part's size."""
    pairs = F.array(*[F.struct(F.lit(a).alias("lower"), F.lit(b).alias("upper")) for a, b in _PAIRS])
    return table(spark, d, "part").select("p_partkey", so.nearest_pair(pairs, F.col("p_size").cast("double"))["lower"].alias("lower"))


_TYPED_FILES = "(SELECT id, arg_min(client_id, loaded_at) AS client_id, arg_min(file_type, loaded_at) AS file_type FROM document_files GROUP BY id)"


@query(
    "set_operations",
    f"SELECT client_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, len(list_filter(a, lambda x: list_contains(b, x))) AS both_, len(list_distinct(list_concat(a, b))) AS any_ FROM (SELECT client_id, list(DISTINCT file_type) FILTER (id % 2 = 0 AND file_type IS NOT NULL) AS a, list(DISTINCT file_type) FILTER (id % 3 = 0 AND file_type IS NOT NULL) AS b FROM {_TYPED_FILES} GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL",
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """File types of two sets of files: difference, intersection and union."""
    f = first_rows(table(spark, d, "document_files"), "id", ["client_id", "file_type"])
    g = f.groupBy("client_id").agg(F.collect_set(F.when(F.col("id") % 2 == 0, F.col("file_type"))).alias("a"), F.collect_set(F.when(F.col("id") % 3 == 0, F.col("file_type"))).alias("b")).where("size(a) > 0 and size(b) > 0")
    n = lambda c: F.size(c).cast("long")
    return g.select("client_id", n(F.array_except("a", "b")).alias("only_a"), n(F.array_intersect("a", "b")).alias("both_"), n(F.array_union("a", "b")).alias("any_"))


@query("new_names", "SELECT DISTINCT s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0")
def new_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that are found but not known yet."""
    s = table(spark, d, "supplier")
    return so.unknown_keys(s.select(F.col("s_name").alias("name")), s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name")), "name")


@query("order_pages", "SELECT count(*) AS rows, greatest(1, CAST(ceil(count(*) / 20.0) AS INT)) AS pages FROM orders WHERE o_orderstatus = 'P'")
def order_pages(spark: SparkSession, d: str) -> DataFrame:
    return so.page_count(table(spark, d, "orders").where("o_orderstatus = 'P'"), 20)


@query("order_page", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def order_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page."""
    return so.page_rows(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, 20).select("o_orderkey")


@query("call_activities", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Loading' WHEN 1 THEN 'Discharging' WHEN 2 THEN 'Bunkering' END AS activity FROM orders")
def call_activities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    acts = F.when(k == 0, arr("Bunkering", "Discharging", "Loading")).when(k == 1, arr("Bunkering", "Discharging")).when(k == 2, arr("Bunkering", "Repairs")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select("o_orderkey", so.main_activity(acts).alias("activity"))


@query(
    "blank_categories",
    "WITH v AS (SELECT CASE WHEN l_linenumber = 1 THEN ' ' WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS c, CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS a FROM lineitem) SELECT coalesce(nullif(trim(c), ''), '—') AS category, sum(TRY_CAST(a AS DOUBLE)) AS total FROM v WHERE TRY_CAST(a AS DOUBLE) IS NOT NULL GROUP BY 1 UNION ALL SELECT 'TOTAL', sum(TRY_CAST(a AS DOUBLE)) FROM v",
)
def blank_categories(spark: SparkSession, d: str) -> DataFrame:
    """Totals with blank and missing categories and amounts that are no numbers."""
    n = F.col("l_linenumber")
    li = table(spark, d, "lineitem").select(F.when(n == 1, " ").when(n == 2, F.lit(None)).otherwise(F.col("l_returnflag")).alias("c"), F.when(n == 3, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("a"))
    return an.category_totals(li, "c", "a")


# Texts.

_LINES = "CASE o_orderkey % 8 WHEN 0 THEN 'Clause 47. The owners reserve' WHEN 1 THEN 'Clause 14 - Hire' WHEN 2 THEN '12.' WHEN 3 THEN '**CHAPTER 4**' WHEN 4 THEN 'clause 9' WHEN 5 THEN '14 — Lien' WHEN 6 THEN '6.438 m' END"


@query(
    "line_kinds",
    f"SELECT o_orderkey, line, coalesce(o_orderkey % 8 = 0, false) AND line IS NOT NULL AS citation, o_orderkey % 8 IN (2, 3, 4) AS bare, o_orderkey % 8 IN (1, 5) AS header FROM (SELECT o_orderkey, {_LINES} AS line FROM orders)",
)
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Citations, bare markers and headers among lines."""
    o = table(spark, d, "orders").selectExpr("o_orderkey", f"{_LINES} as line")
    no = F.lit(False)
    return o.select("o_orderkey", "line", F.coalesce(tx.is_citation(F.col("line")), no).alias("citation"), tx.bare_marker(F.col("line")).alias("bare"), F.coalesce(tx.is_clause_header(F.col("line")), no).alias("header"))


@query(
    "promoted_titles",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '46. BIMCO Piracy Clause' WHEN 1 THEN 'Clause 7 - Clause for Time Charter' WHEN 2 THEN '46.' ELSE '46. Hire' END AS title, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN '(a) BIMCO is cited' || chr(10) || o_orderpriority ELSE 'BIMCO Piracy Clause' || chr(10) || o_orderpriority END AS body FROM orders",
)
def promoted_titles(spark: SparkSession, d: str) -> DataFrame:
    """Subtitles of rider clauses moved into titles that are bare markers."""
    k = F.col("o_orderkey") % 4
    first = F.when(k == 1, "Clause for Time Charter").when(k == 2, "(a) BIMCO is cited").otherwise("BIMCO Piracy Clause")
    o = table(spark, d, "orders").select("o_orderkey", F.when(k == 1, "Clause 7").when(k == 3, "46. Hire").otherwise("46.").alias("t"), F.concat(first, F.lit("\n"), "o_orderpriority").alias("b"))
    title, body = tx.promote_subtitle(F.col("t"), F.col("b"))
    return o.select("o_orderkey", title.alias("title"), body.alias("body"))


@query("parsed_answers", "SELECT item_id, CASE WHEN item_id % 4 < 3 THEN suite END AS title, CASE WHEN item_id % 4 < 3 THEN text END AS body FROM eval_items")
def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Chunks read back from a model's answers: fenced, as an object, as an array, and none."""
    k = F.col("item_id") % 4
    js = F.to_json(F.array(F.struct(F.col("suite").alias("title"), F.col("text").alias("body"))))
    answer = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), js, F.lit("\n```\n"))).when(k == 1, F.concat(F.lit('{"chunks": '), js, F.lit("}"))).when(k == 2, js).otherwise("There is no chunk.")
    e = table(spark, d, "eval_items").select("item_id", F.get(so.parse_enriched(answer), F.lit(0)).alias("c"))
    return e.select("item_id", "c.title", "c.body")


@query(
    "guarded_bodies",
    "SELECT item_id AS key, CASE WHEN item_id % 3 = 0 THEN text || ' more' ELSE text END AS body FROM eval_items",
)
def guarded_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Enriched bodies that lost too many words give way to the raw ones."""
    k = F.col("item_id") % 3
    enriched = F.when(k == 0, F.concat("text", F.lit(" more"))).when(k == 1, F.substring_index("text", " ", 5))
    return cs.guard_enrichment(table(spark, d, "eval_items").select(F.col("item_id").alias("key"), F.col("text").alias("raw"), enriched.alias("enriched")))


@query("fitted_words", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> ''))::BIGINT AS words, true AS fits FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', '', 'g')) <> ''")
def fitted_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of all pieces of each text under a limit of 60 words: none is lost, and pieces of several sentences keep the limit."""
    cut = sg.fold(table(spark, d, "documents"), "doc_id", "text", lambda t: [(None, p) for p in sg.fit_pieces(t, 60, lambda x: len(x.split()))])
    n = tx.word_count(F.col("body"))
    single = F.size(F.split(F.trim("body"), r"(?<=[.!?])\s+|\n")) == 1
    return cut.groupBy("doc_id").agg(F.sum(n).alias("words"), F.min((n <= 60) | single).alias("fits")).where("words > 0")


_KINDS = {"recap": ["vessel", "hire", "delivery"], "notice": ["laytime", "tendered", "berth"]}
_KINDS_SQL = "CASE " + " ".join(f"WHEN {' + '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})::INT' for w in ws)} >= 2 THEN '{k}'" for k, ws in _KINDS.items()) + " END"


@query("document_kinds", f"SELECT doc_id, {_KINDS_SQL} AS kind FROM documents")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each text by two of its indicators."""
    return table(spark, d, "documents").select("doc_id", sg.document_kind(F.col("text"), _KINDS).alias("kind"))


@query("name_keys", "SELECT id, md5(lower(trim(name))) AS key FROM (SELECT id, arg_min(name, loaded_at) AS name FROM vessels GROUP BY id)")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "vessels"), "id", ["name"]).select("id", tx.key_hash(F.col("name")).alias("key"))


@query(
    "identity_numbers",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 7, '9') END AS imo_number, CASE o_orderkey % 3 WHEN 1 THEN 'PEVT' || (o_orderkey % 10) END AS call_sign FROM orders",
)
def identity_numbers(spark: SparkSession, d: str) -> DataFrame:
    """IMO numbers and call signs in texts."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("The IMO No: "), F.lpad(F.col("o_orderkey").cast("string"), 7, "9"), F.lit(" is hers"))).when(k == 1, F.concat(F.lit("Call sign: PEVT"), (F.col("o_orderkey") % 10).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", tx.first_match(text, tx.IMO).alias("imo_number"), tx.first_match(text, tx.CALL_SIGN).alias("call_sign"))


@query("sorted_keywords", "SELECT item_id, list_sort(list_distinct(list_concat(list_filter(['hire', 'crane', 'tonnes', 'laytime'], lambda k: contains(lower(text), k)), regexp_extract_all(lower(text), '\\b([a-z]{2}-[0-9]{5})\\b', 1)))) AS words FROM eval_items")
def sorted_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", tx.keywords(F.col("text"), ["hire", "crane", "tonnes", "laytime"], [r"\b([a-z]{2}-\d{5})\b"]).alias("words"))


@query("kept_links", "SELECT o_orderkey, 'https://x.test/a' || CASE o_orderkey % 3 WHEN 0 THEN '?p=' || o_orderkey || '&page=2' WHEN 1 THEN '' ELSE '' END AS kept FROM orders")
def kept_links(spark: SparkSession, d: str) -> DataFrame:
    """Links with only the query parameters of one prefix."""
    k = F.col("o_orderkey") % 3
    url = F.when(k == 0, F.concat(F.lit("https://x.test/a?p="), F.col("o_orderkey").cast("string"), F.lit("&utm=1&page=2"))).when(k == 1, "https://x.test/a?utm=1").otherwise("https://x.test/a")
    return table(spark, d, "orders").select("o_orderkey", tx.kept_parameters(url, "p").alias("kept"))


@query("metadata_keys", "SELECT o_orderkey, list_sort(list_filter(['status', CASE WHEN o_orderkey % 2 = 0 THEN 'even' END, CASE WHEN o_totalprice > 100000 THEN 'large' END], lambda x: x IS NOT NULL)) AS keys FROM orders")
def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of metadata that are neither null nor empty."""
    fields = {"status": F.col("o_orderstatus"), "even": F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise(""), "large": F.when(F.col("o_totalprice") > 100000, True), "none": F.lit(None).cast("string")}
    return table(spark, d, "orders").select("o_orderkey", F.array_sort(F.map_keys(so.metadata(fields))).alias("keys"))


# Classes.


def _terms_sql(table: cl.Terms, column: str, other: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in table.items()) + f" ELSE {other} END"


@query("clause_classes", f"SELECT kind, count(*) AS n FROM (SELECT coalesce({_terms_sql(cl.CLAUSE_TERMS, 'h', 'NULL')}, {_terms_sql(cl.CLAUSE_TERMS, 'b', 'NULL')}, 'general') AS kind FROM (SELECT lower(coalesce(title, '')) AS h, lower(coalesce(substr(body, 1, 500), '')) AS b FROM {_CHUNKS})) GROUP BY 1")
def clause_classes(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "title", "body").select(cl.clause_class(F.col("title"), F.col("body")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("spec_classes", f"SELECT kind, count(*) AS n FROM (SELECT {_terms_sql(cl.SPEC_TERMS, 'lower(coalesce(text, ' + chr(39) * 2 + '))', chr(39) + 'general' + chr(39))} AS kind FROM documents) GROUP BY 1")
def spec_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(cl.spec_class(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("file_labels", f"SELECT id, {_terms_sql(cl.FILE_TERMS, 'lower(coalesce(filename, ' + chr(39) * 2 + '))', chr(39) + 'Maritime Document' + chr(39))} AS label FROM {_FIRST_FILES}")
def file_labels(spark: SparkSession, d: str) -> DataFrame:
    return first_files(spark, d).select("id", cl.file_label(F.col("filename")).alias("label"))


_HEAD = "replace(lower(coalesce(filename, '')), '_', ' ')"
_FAMILIES_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(h, '{w}')" for w in openers) + f" THEN {_terms_sql(members, 'h', chr(39) + own + chr(39))}" for openers, members, own in cl.HEADING_FAMILIES) + " ELSE 'general' END"


@query("heading_classes", f"SELECT id, {_FAMILIES_SQL} AS kind FROM (SELECT id, {_HEAD} AS h FROM {_FIRST_FILES})")
def heading_classes(spark: SparkSession, d: str) -> DataFrame:
    """Content types of headings, here the words of file names."""
    return first_files(spark, d).select("id", cl.heading_class(F.expr(_HEAD)).alias("kind"))


_SECTION_LINE = "CASE o_orderkey % 9 WHEN 0 THEN 'Vessel Specifications - Amber' WHEN 1 THEN 'Fixture recap - 4. Trading Limits:' WHEN 2 THEN 'Charter Party – Clause 12 - Hire, Payment' WHEN 3 THEN 'BIMCO War Risks' WHEN 4 THEN 'BIMCO Ice Risk Clause 2' WHEN 5 THEN 'Addendum 2' WHEN 6 THEN '3. Bunker Price' WHEN 7 THEN 'the daily hire in USD' ELSE 'nothing' END"


@query(
    "section_kinds",
    "SELECT o_orderkey, ['vessel_specifications', 'fixture_recap', 'charter_party', 'charter_party', 'charter_party', 'addendum', 'other', 'hire', 'other'][CAST(o_orderkey % 9 + 1 AS INT)] AS section, ['all_specifications', 'trading_limits', 'hire_payment', 'war_risks', 'ice_risk', 'general', 'bunker_price', 'general', 'general'][CAST(o_orderkey % 9 + 1 AS INT)] AS part, CASE WHEN o_orderkey % 9 < 7 THEN 'pattern_match' WHEN o_orderkey % 9 = 7 THEN 'content_match' ELSE 'content_fallback' END AS how FROM orders",
)
def section_kinds(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("o_orderkey", f"{_SECTION_LINE} as t")
    return o.select("o_orderkey", cl.section_of(F.concat("t", F.lit("\nmore"))).alias("s")).select("o_orderkey", "s.*")


@query(
    "document_names",
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'MV LONG WILLOW' WHEN 1 THEN 'MV AMBER QUERN' WHEN 2 THEN 'MV GREY HERON' WHEN 3 THEN 'DOC ' || o_orderkey ELSE 'MV BLUE STAR' END AS name FROM orders",
)
def document_names(spark: SparkSession, d: str) -> DataFrame:
    """Names behind a label, in the line after one, in a line of their own, in the file's name."""
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "Vessel details\nVessel name: Long Willow").when(k == 1, "x\nVessel Name:\nAmber Quern\ny").when(k == 2, F.concat(F.repeat(F.lit("line\n"), 120), F.lit("MV Grey Heron"))).otherwise("")
    name = F.when(k == 3, F.concat(F.lit("Doc "), F.col("o_orderkey").cast("string"), F.lit(".pdf"))).when(k == 4, "MV_Blue_Star_final.docx")
    o = table(spark, d, "orders").select("o_orderkey", text.alias("t"), F.translate(name, "_", " ").alias("f"))
    return cl.document_names(o, "o_orderkey", "t", "f")


@query(
    "misplaced_headers",
    "SELECT o_orderkey, number, title, body FROM (SELECT o_orderkey, 1 AS number, '1. Hire' AS title, 'paid in advance' AS body FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT o_orderkey, CAST(o_orderkey % 5 + 2 AS INT), (o_orderkey % 5 + 2) || ') Notices', 'two days' FROM orders WHERE o_orderkey % 3 <> 2)",
)
def misplaced_headers(spark: SparkSession, d: str) -> DataFrame:
    """Clause headers found inside another clause; a number that is taken stays text."""
    no = F.when(F.col("o_orderkey") % 3 == 2, F.lit(1)).otherwise(F.col("o_orderkey") % 5 + 2).cast("string")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("1. Hire\npaid in advance\n"), no, F.lit(") Notices\ntwo days")).alias("t"))
    return se.misplaced_headers(o, "o_orderkey", "t")


def _routed(d: str) -> str:
    return "SELECT CASE WHEN document_category = 'charter_party' THEN 'presplit' WHEN document_category IN (" + ", ".join(f"'{c}'" for c in se.RAW) + ") THEN 'raw' ELSE 'font' END AS route, count(*) AS documents FROM documents WHERE " + d + " GROUP BY 1"


@query("routes", _routed("text IS NOT NULL"))
def routes(spark: SparkSession, d: str) -> DataFrame:
    """Texts per route of their category."""
    return table(spark, d, "documents").where("text is not null").groupBy(se.route(F.col("document_category")).alias("route")).agg(F.count("*").alias("documents"))


@query("routed_chunks")
def routed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return se.routed_chunks(table(spark, d, "documents"), "doc_id", "text", "document_category")


_SCORE = f"""
0.3 * greatest(0.0, 100.0 - least(abs(t.item_id * 3 - s.item_id * 3 - 2), abs(t.item_id * 3 + 1 - s.item_id * 3)))
+ 0.4 * least(100.0, 100.0 * len(list_intersect(s.w, t.w)) / len(list_distinct(list_concat(s.w, t.w))) + {' + '.join(f"CASE WHEN contains(s.x, '{p}') AND contains(t.x, '{p}') THEN 20.0 ELSE 0.0 END" for p in se.PHRASES)})
+ 0.4 * CASE {' '.join('WHEN (' + ' OR '.join(f"contains(s.x, '{a}')" for a in heads) + ') AND (' + ' OR '.join(f"contains(t.x, '{b}')" for b in words) + ') THEN 80.0' for heads, words in se.PAIRED)} ELSE 0.0 END
- 0.6 * CASE WHEN ({' OR '.join(f"contains(s.x, '{a}')" for a in se.LEGAL)}) AND ({' OR '.join(f"contains(t.x, '{a}')" for a in se.TECHNICAL)}) AND NOT ({' OR '.join(f"contains(s.x, '{a}')" for a in se.ABOUT)}) THEN 100.0 ELSE 0.0 END
"""


@query(
    "attached_tables",
    f"""
WITH e AS (SELECT suite, item_id, lower(text) AS x, list_distinct(regexp_extract_all(lower(text), '\\b(\\w{{3,}})\\b', 1)) AS w FROM eval_items),
j AS (SELECT s.suite, s.item_id AS section_id, t.item_id AS table_id, {_SCORE} AS score FROM (SELECT * FROM e WHERE item_id % 2 = 0) s JOIN (SELECT * FROM e WHERE item_id % 2 = 1) t USING (suite))
SELECT suite, section_id, table_id, round(score, 6) AS score FROM j WHERE score > 50 QUALIFY row_number() OVER (PARTITION BY suite, section_id ORDER BY score DESC, table_id) = 1
""",
)
def attached_tables(spark: SparkSession, d: str) -> DataFrame:
    """Items of even number as sections, of odd number as tables, three lines each; the best table of each section."""
    e = table(spark, d, "eval_items").select("suite", "item_id", "text", (F.col("item_id") * 3).alias("start"))
    s = e.where("item_id % 2 = 0").select("suite", F.col("item_id").alias("section_id"), "text", "start", (F.col("start") + 2).alias("end"))
    t = e.where("item_id % 2 = 1").select("suite", F.col("item_id").alias("table_id"), "text", "start", (F.col("start") + 1).alias("end"))
    return se.attach_tables(s, t, "suite").withColumn("score", F.round("score", 6))


# Grids, layout and runs.


_UNIQUE_LINES = "(SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY 1, 2)"


def unique_lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per order and line number."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))


@query(
    "merged_cells",
    f"""
WITH l AS (SELECT * FROM {_UNIQUE_LINES} WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2))
SELECT CAST(l.l_orderkey AS VARCHAR) AS sheet_id, l.l_linenumber AS r, CAST(c AS INT) AS c, CASE WHEN l.l_linenumber <= 2 THEN o.f WHEN c = 0 THEN l.f ELSE l.s END AS value
FROM l CROSS JOIN (VALUES (0), (1)) v(c) JOIN l o ON o.l_orderkey = l.l_orderkey AND o.l_linenumber = 1
""",
)
def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a region of two rows and columns take its first value."""
    li = unique_lines(spark, d)
    for k in (1, 2):
        li = li.join(table(spark, d, "lineitem").where(f"l_linenumber = {k}").select("l_orderkey"), "l_orderkey", "left_semi")
    li = li.select(F.col("l_orderkey").cast("string").alias("sheet_id"), F.col("l_linenumber").alias("r"), F.array("f", "s").alias("v"))
    cells = li.select("sheet_id", "r", F.posexplode("v").alias("c", "value"))
    regions = li.where("r = 1").select("sheet_id", F.lit(1).alias("r1"), F.lit(2).alias("r2"), F.lit(0).alias("c1"), F.lit(1).alias("c2"))
    return gr.fill_merged(cells, regions)


_MAIN, _SUB = "CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE ' ' END", "CASE WHEN n_nationkey % 2 = 0 THEN 'sub' || cast(n_nationkey as varchar(9)) END"


@query(
    "sheet_headers",
    f"SELECT CAST(n_regionkey AS VARCHAR) AS sheet_id, n_nationkey AS c, CASE WHEN m IS NOT NULL AND s IS NOT NULL THEN m || ' (' || s || ')' ELSE coalesce(m, s) END AS header FROM (SELECT n_regionkey, n_nationkey, {_SUB} AS s, last_value(nullif(trim({_MAIN}), '') IGNORE NULLS) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM nation)",
)
def sheet_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers of two rows, the upper carried to the right."""
    n = table(spark, d, "nation")
    row = lambda e: n.selectExpr("cast(n_regionkey as string) as sheet_id", "n_nationkey as c", e.replace("varchar(9)", "string") + " as value")
    return gr.two_row_headers(row(_MAIN), row(_SUB))


@query(
    "marked_runs",
    f"""
WITH g AS (SELECT l_orderkey, l_linenumber, f || l_linenumber AS t, s = 'O' AS s, sum(CASE WHEN p IS NULL OR p <> s THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM (SELECT *, lag(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM {_UNIQUE_LINES})),
r AS (SELECT l_orderkey, i, s, string_agg(t, '' ORDER BY l_linenumber) AS t FROM g GROUP BY 1, 2, 3)
SELECT l_orderkey, string_agg(CASE WHEN s THEN '~~' || t || '~~' ELSE t END, '' ORDER BY i) AS text FROM r GROUP BY 1
""",
)
def marked_runs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring struck runs in one pair of marks."""
    li = unique_lines(spark, d).select("l_orderkey", "l_linenumber", F.concat("f", F.col("l_linenumber").cast("string")).alias("text"), (F.col("s") == "O").alias("struck"))
    return la.mark_runs(li, ["l_orderkey"], "l_linenumber")


@query(
    "struck_places",
    """
WITH g AS (SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS glyph_id, l_linenumber * 10.0 AS x0, l_linenumber * 10.0 + 8 AS x1, (l_linenumber % 3) * 50.0 AS y0, (l_linenumber % 3) * 50.0 + 8 AS y1 FROM lineitem),
b AS (SELECT l_orderkey AS doc_id, l_linenumber * 10.0 + l_quantity % 6 AS x0, l_linenumber * 10.0 + 30 AS x1, (l_linenumber % 3) * 50.0 + l_quantity % 8 AS y0, (l_linenumber % 3) * 50.0 + l_quantity % 8 + 1 AS y1 FROM lineitem WHERE l_linenumber < 4)
SELECT DISTINCT g.doc_id, g.page, g.glyph_id FROM g JOIN b USING (doc_id) WHERE (least(g.x1, b.x1) - greatest(g.x0, b.x0)) / 8.0 >= 0.52 AND (b.y0 + b.y1) / 2 BETWEEN g.y0 + 2 AND g.y1 - 2
""",
)
def struck_places(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs that a strike band crosses."""
    li = table(spark, d, "lineitem").withColumn("y", (F.col("l_linenumber") % 3) * 50.0).withColumn("x", F.col("l_linenumber") * 10.0)
    g = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("glyph_id"), F.col("x").alias("x0"), (F.col("x") + 8).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 8).alias("y1"))
    at = F.col("y") + F.col("l_quantity") % 8
    b = li.where("l_linenumber < 4").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("x") + F.col("l_quantity") % 6).alias("x0"), (F.col("x") + 30).alias("x1"), at.alias("y0"), (at + 1).alias("y1"))
    return la.struck_glyphs(g, b)


@query(
    "snapped_rows",
    "WITH RECURSIVE y AS (SELECT DISTINCT l_orderkey, l_quantity AS v FROM lineitem), a AS (SELECT l_orderkey, min(v) AS v FROM y GROUP BY 1 UNION ALL SELECT a.l_orderkey, (SELECT min(y.v) FROM y WHERE y.l_orderkey = a.l_orderkey AND y.v > a.v + 3) AS v FROM a WHERE a.v IS NOT NULL) SELECT doc_id, \"row\", count(*) AS elements FROM (SELECT l.l_orderkey AS doc_id, CAST((SELECT count(*) FROM a WHERE a.l_orderkey = l.l_orderkey AND a.v <= l.l_quantity) - 1 AS INT) AS \"row\" FROM (SELECT l_orderkey, l_quantity FROM lineitem UNION ALL SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 1) l) GROUP BY 1, 2",
)
def snapped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of page elements by their start; equal elements count as often as they stand."""
    li = table(spark, d, "lineitem")
    e = li.unionByName(li.where("l_linenumber = 1")).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_quantity").cast("double").alias("y"), F.lit("t").alias("text"))
    return la.snap_rows(e).groupBy("doc_id", "row").agg(F.count("*").alias("elements"))


# Holds and cargo.


@query(
    "hold_texts",
    "SELECT s_suppkey, CAST(80 + s_suppkey % 50 AS DOUBLE) AS loa, 16.5::DOUBLE AS breadth, CAST(s_suppkey % 3 AS INT) AS asked, CASE WHEN s_suppkey % 3 > 1 THEN 2 ELSE 1 END AS holds_count, s_suppkey % 2 = 0 AS has_tween, CASE WHEN s_suppkey % 4 = 0 THEN 13.5::DOUBLE ELSE CAST(14.0 AS DOUBLE) END AS width FROM supplier",
)
def hold_texts(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions of holds read from prose, partly stated."""
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit("Length over all: abt. "), (80 + k % 50).cast("string"), F.lit(",0 m\nBreadth moulded: 16,5 m\nNumber of holds/hatches: "), (k % 3).cast("string"), F.when(k % 2 == 0, "\nTween deck pontoons").otherwise(""),
        F.when(k % 4 == 0, "\nHold dims: abt 40,5 x 13,5 x 8,2 m").otherwise(""),
    )
    s = table(spark, d, "supplier").select("s_suppkey", text.alias("t"))
    return so.hold_text(s, "s_suppkey", "t").select("s_suppkey", "loa", "breadth", (F.col("s_suppkey") % 3).cast("int").alias("asked"), "holds_count", "has_tween", "width")


_HOLD = "cast(s_suppkey % 10 + 5 as double)"


@query(
    "tween_heights",
    f"SELECT s_suppkey, s_suppkey % 3 > 0 AS has_tween, CAST(CASE s_suppkey % 3 WHEN 0 THEN h WHEN 1 THEN greatest(h - 2.0, h * 0.45) ELSE 3.0 END AS DOUBLE) AS lower_height, CAST(CASE s_suppkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 2.0 ELSE greatest(h - 3.0, h * 0.55) END AS DOUBLE) AS upper_height FROM (SELECT s_suppkey, {_HOLD} AS h FROM supplier)",
)
def tween_heights(spark: SparkSession, d: str) -> DataFrame:
    """Heights of tween-decked holds of which one level is missing."""
    k = F.col("s_suppkey")
    js = F.concat(F.lit('[{"id": 1, "length": 20, "breadth": 10, "height": '), F.expr(_HOLD).cast("string"), F.when(k % 3 == 1, ', "upper_height": 2').when(k % 3 == 2, ', "lower_height": 3, "has_tween": true').otherwise(""), F.lit("}]"))
    return so.parse_holds(table(spark, d, "supplier").select("s_suppkey", js.alias("j")), "s_suppkey", "j").select("s_suppkey", "has_tween", "lower_height", "upper_height")


@query(
    "hold_defaults",
    "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 99.0 ELSE round((20 + s_suppkey % 7) * 1.6, 1) END AS DOUBLE) AS loa, CAST(10.5 AS DOUBLE) AS breadth, CAST(8.8 AS DOUBLE) AS depth, 2 AS holds_count, false AS has_tween FROM supplier",
)
def hold_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions of vessels from their greatest hold where they are missing or zero."""
    s = table(spark, d, "supplier")
    v = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, 99.0).otherwise(0.0).alias("loa"), F.lit(None).cast("double").alias("breadth"), F.lit(0.0).alias("depth"))
    h = s.select("s_suppkey", F.explode(F.array(F.lit(0.0), (F.col("s_suppkey") % 7).cast("double"))).alias("x")).select("s_suppkey", (F.col("x") + 20).alias("length"), F.lit(10.0).alias("breadth"), F.lit(8.0).alias("height"), F.lit(False).alias("has_tween"))
    return so.hold_defaults(v, h, "s_suppkey")


@query(
    "level_heights",
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 4 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 3.0 ELSE 8.0 END WHEN l_orderkey % 2 = 1 THEN 8.0 WHEN l_linenumber % 4 = 1 THEN 3.0 WHEN l_linenumber % 4 = 2 THEN 4.5 END AS DOUBLE) AS height FROM lineitem",
)
def level_heights(spark: SparkSession, d: str) -> DataFrame:
    """Usable heights of levels in holds with and without a tween deck, and of levels that do not exist."""
    k = F.col("l_linenumber") % 4
    level = F.when(k == 1, "lower").when(k == 2, "tween").when(k == 3, "upper")
    h = cg.level_height(level, F.col("l_orderkey") % 2 == 0, F.lit(3.0), F.lit(4.5), F.lit(8.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", h.alias("height"))


@query(
    "read_numbers",
    "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 1234.5 WHEN 1 THEN l_quantity + 0.5 WHEN 2 THEN l_quantity WHEN 3 THEN NULL ELSE 12.0 END AS value, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 1000 WHEN l_quantity > 30 THEN l_quantity / 1000 ELSE l_quantity END AS metres, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 1000 ELSE l_quantity END AS kilograms, l_linenumber % 3 = 0 AS dangerous FROM lineitem",
)
def read_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Figures, dimensions, weights and flags of sheet cells."""
    k, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    text = F.when(k % 5 == 0, "1,234.5 kg").when(k % 5 == 1, F.concat(q, F.lit(",5"))).when(k % 5 == 2, F.concat(q, F.lit(" mm"))).when(k % 5 == 3, "n/a").otherwise(" 12 ")
    head = F.when(k % 2 == 0, "Length (mm)")
    weight = F.when(k % 2 == 0, "Weight t").otherwise("Weight kg")
    value = F.col("l_quantity").cast("double")
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", cg.flexible_number(text).alias("value"), cg.metres(value, head).alias("metres"), cg.kilograms(value, weight).alias("kilograms"), cg.flagged(F.when(k % 3 == 0, " yes ").otherwise("no")).alias("dangerous"))


@query("groups_without_targets", "SELECT manifest_id, CAST(CASE WHEN manifest_id % 2 = 0 THEN 50.0 ELSE 100.0 END AS DOUBLE) AS balance FROM (SELECT DISTINCT manifest_id FROM placed_items WHERE manifest_id IS NOT NULL)")
def groups_without_targets(spark: SparkSession, d: str) -> DataFrame:
    """Balance of groups of which every second has targets: one hold met, one missed."""
    m = table(spark, d, "placed_items").select("manifest_id").where("manifest_id is not null").distinct()
    targets = m.where("manifest_id % 2 = 0").select("manifest_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("hold_id"), F.lit(10.0).alias("target_kg"))
    return cg.balance_scores(targets, m.select("manifest_id", F.lit(1).alias("hold_id"), F.lit(10.0).alias("weight_kg")), "manifest_id")


@query("shared_footprints", "SELECT l_orderkey, l_linenumber, greatest(0.0, least(4.0, l_quantity + 3) - greatest(0.0, l_quantity)) * greatest(0.0, least(5.0, l_linenumber + 2.0) - greatest(0.0, l_linenumber)) AS area FROM lineitem")
def shared_footprints(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "0d as a_x", "0d as a_z", "4d as a_l", "5d as a_w", "cast(l_quantity as double) as b_x", "cast(l_linenumber as double) as b_z", "3d as b_l", "2d as b_w")
    return li.select("l_orderkey", "l_linenumber", cg.footprint_overlap("a_", "b_").alias("area"))


_ONE = "(SELECT * FROM placed_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"


@query("patched_items", f"SELECT id, CASE WHEN id % 4 = 0 THEN 2.0 ELSE l END AS l, w, h, CASE WHEN id % 4 = 0 THEN 2.0 * w * h ELSE 1.0 END AS volume_m3 FROM {_ONE}")
def patched_items(spark: SparkSession, d: str) -> DataFrame:
    """Measures of every fourth item patched, its volume computed again; fields that may not be patched stay."""
    it = first_rows(table(spark, d, "placed_items"), "id", ["l", "w", "h"]).drop("first_loaded").withColumn("volume_m3", F.lit(1.0))
    patches = it.where("id % 4 = 0").select("id", F.lit(2.0).alias("l"), F.lit(9.0).alias("w"))
    return so.patch_items(it, patches, "id", ["l"])


def joint_layout(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Eight manifests a vessel, three containers of one type as its holds, stored pins kept."""
    cols = ["manifest_id", "item_position", "bin_type", "hold_id", "x", "y", "z", "l", "w", "h", "rotation_deg", "weight_kg", "can_stack", "is_pinned"]
    it = first_rows(table(spark, d, "placed_items"), "id", cols).drop("first_loaded").where("manifest_id is not null")
    vessel = F.floor(F.col("manifest_id") / 8).cast("long")
    m = it.select(vessel.alias("vessel_id"), "manifest_id").distinct()
    kinds = it.groupBy(vessel.alias("vessel_id")).agg(F.min("bin_type").alias("bin_type"))
    b = kinds.join(F.broadcast(table(spark, d, "cargo_bins")), "bin_type").select("vessel_id", F.explode(F.array(*[F.lit(f"hold {i}") for i in (1, 2, 3)])).alias("bin_id"), "length", "width", "height", (F.col("length") * F.col("width") * F.col("height")).alias("volume_m3"), "max_weight_kg")
    pinned = F.coalesce("is_pinned", F.lit(False)) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & F.col("hold_id").isNotNull()
    own = it.select("manifest_id", "id", F.col("item_position").alias("position"), "l", "w", "h", "weight_kg", "can_stack", F.lit(True).alias("can_rotate"), pinned.alias("pinned"), F.concat(F.lit("hold "), (F.pmod("hold_id", F.lit(3)) + 1).cast("string")).alias("bin_id"), "x", "y", "z", "rotation_deg")
    return joint.joint_stowage(m, own, b), b


@query(
    "joint_manifests",
    f"SELECT manifest_id // 8 AS vessel_id, manifest_id, count(*) AS items, count(*) FILTER (coalesce(is_pinned, false) AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND hold_id IS NOT NULL) AS pinned FROM {_ONE} WHERE manifest_id IS NOT NULL GROUP BY 1, 2",
)
def joint_manifests(spark: SparkSession, d: str) -> DataFrame:
    """The joint layout handed back: each manifest has all its items again, and its pins."""
    s = joint.manifest_summary(joint_layout(spark, d)[0])
    return s.select("vessel_id", "manifest_id", (F.col("placed") + F.col("unplaced")).alias("items"), "pinned")


@query("joint_vessels")
def joint_vessels(spark: SparkSession, d: str) -> DataFrame:
    """Placed and unplaced items, weight and balance of every vessel."""
    layout, bins = joint_layout(spark, d)
    return joint.vessel_summary(layout, bins)


# Trees and windows.

_TREE = '{"ch": {"content": [], "tables": [[["a", ""], ["b", "c"]]], "sub_chapters": {"s": {"content": ["x", "y"], "clauses": {"1": {"title": "Hire", "content": ["p", "q"]}, "2": {"title": "Off", "content": []}}, "rider_clauses": {"9": {"title": "War", "content": ["r"]}}, "rider_content": [" "]}}}}'


@query(
    "flattened_trees",
    "SELECT r_regionkey, kind, number, title, body, line_count FROM region CROSS JOIN (VALUES ('chapter', NULL, NULL, 'a | N/A' || chr(10) || 'b | c', 2), ('clause', '1', 'Hire', 'p' || chr(10) || 'q', 2), ('rider', '9', 'War', 'r', 1), ('text', NULL, NULL, 'x' || chr(10) || 'y', 2)) v(kind, number, title, body, line_count)",
)
def flattened_trees(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "region").select("r_regionkey", F.from_json(F.lit(_TREE), so.TREE).alias("tree"))
    return so.flatten_tree(t, "r_regionkey", "tree").select("r_regionkey", "kind", "number", "title", "body", "line_count")


@query("chapter_counts", "SELECT r_regionkey, 'ch/s' AS chapter, 3 AS clauses FROM region")
def chapter_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "region").select("r_regionkey", F.from_json(F.lit(_TREE), so.TREE).alias("tree"))
    return so.chapter_counts(t, "r_regionkey", "tree").select("r_regionkey", F.explode("counts").alias("chapter", "clauses"))


@query(
    "message_windows",
    """
WITH m AS (SELECT id, arg_min(session_id, loaded_at) AS session_id, arg_min(role, loaded_at) AS role, arg_min(content, loaded_at) AS content, arg_min(position, loaded_at) AS position FROM chat_messages GROUP BY id),
l AS (SELECT * FROM m WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY position DESC, id DESC) <= 6)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY position, id) AS INT) AS seq, role, content FROM l UNION ALL SELECT DISTINCT session_id, 0, 'system', 'Answer from the context.' FROM l
""",
)
def message_windows(spark: SparkSession, d: str) -> DataFrame:
    """The system line and the last three turns of every session."""
    m = first_rows(table(spark, d, "chat_messages"), "id", ["session_id", "role", "content", "position"]).where("session_id is not null")
    return cs.message_window(m, "Answer from the context.", 3)
