"""Segmentation, chunk-set, state, search and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import chunksets as cs
from tidewater.operators import segments as sg
from tidewater.queries.registry import Registry
from tidewater.queries.texts import _CHUNKS, chunks
from tidewater.sources.tables import first_rows, latest_rows, table

query = Registry()


@query("clause_chunks")
def clause_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sg.clause_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("organised_clauses")
def organised_clauses(spark: SparkSession, d: str) -> DataFrame:
    return sg.organised(table(spark, d, "documents"), "doc_id", "text", "clause")


@query("sanitised_texts")
def sanitised_texts(spark: SparkSession, d: str) -> DataFrame:
    return sg.sanitise(table(spark, d, "documents"), "doc_id", "text")


_W = "list_filter(regexp_split_to_array(body, '[\\s\\x{A0}]+'), lambda x: x <> '')"


@query(
    "word_chunks",
    f"""
SELECT id, part::INT AS part, CASE WHEN n > 1 THEN trim(coalesce(title, CASE WHEN part > 1 THEN 'Continued' ELSE '' END) || ' (part ' || part || ')') ELSE title END AS title,
  CASE WHEN n > 1 THEN array_to_string(w[(part - 1) * 200 + 1 : part * 200], ' ') ELSE body END AS body
FROM (SELECT id, title, body, {_W} AS w, greatest(1, CAST(ceil(len({_W}) / 200.0) AS INT)) AS n FROM {_CHUNKS} WHERE body IS NOT NULL), LATERAL (SELECT unnest(generate_series(1, n)) AS part)
""",
)
def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Bodies in parts of at most 200 words."""
    return sg.word_chunks(chunks(spark, d, "title", "body"), "id", "title", "body", 200)


@query(
    "dedup_chunks",
    f"""
SELECT document_id, id, score, copies FROM (
  SELECT document_id, id, s AS score, count(*) OVER w AS copies, row_number() OVER (PARTITION BY document_id, h ORDER BY s DESC, id) AS k FROM (
    SELECT document_id, id, md5(trim(regexp_replace(lower(body), '[\\s\\x{{A0}}]+', ' ', 'g'))) AS h,
      CASE WHEN title IS NOT NULL AND title <> '' THEN 2.0 ELSE 0.0 END + least(length(body), 1000) / 1000.0 AS s FROM {_CHUNKS} WHERE document_id IS NOT NULL)
  WINDOW w AS (PARTITION BY document_id, h)) WHERE k = 1
""",
)
def dedup_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "title", "body").where("document_id is not null")
    return cs.dedup(c, "document_id", "body", F.col("title").isNotNull() & (F.col("title") != ""), F.lit(False), "id")


@query(
    "consolidated_documents",
    f"""
SELECT document_id, CAST(floor((k - 1) / 1000) AS INT) AS block, string_agg(body, chr(10) || chr(10) ORDER BY id) AS body
FROM (SELECT document_id, id, body, row_number() OVER (PARTITION BY document_id ORDER BY id) AS k FROM {_CHUNKS} WHERE document_id IS NOT NULL) GROUP BY 1, 2
""",
)
def consolidated_documents(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "body").where("document_id is not null")
    return cs.consolidate(c, ["document_id"], "id", "body")


@query(
    "title_runs",
    f"""
SELECT document_id, run, title, min(id) AS first, max(id) AS last, count(*) AS n FROM (
  SELECT document_id, id, title, CAST(sum(c) OVER (PARTITION BY document_id ORDER BY id) AS BIGINT) AS run FROM (
    SELECT document_id, id, title, CASE WHEN row_number() OVER w = 1 OR title IS DISTINCT FROM lag(title) OVER w THEN 1 ELSE 0 END AS c
    FROM {_CHUNKS} WHERE document_id IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY id))) GROUP BY 1, 2, 3
""",
)
def title_runs(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "title").where("document_id is not null")
    return cs.type_runs(c, ["document_id"], "id", "title")


@query(
    "filled_titles",
    f"SELECT id, last_value(nullif(title, '') IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM {_CHUNKS} WHERE document_id IS NOT NULL",
)
def filled_titles(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "title").where("document_id is not null").withColumn("title", F.nullif("title", F.lit("")))
    return sg.forward_fill(c, ["document_id"], "id", "title", "section").select("id", "section")


@query(
    "edited_chunks",
    f"""
SELECT id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY position, id) - 1 AS INT) AS position, title, document_id
FROM (SELECT id, position, document_id, body, CASE WHEN id % 5 = 0 THEN 'Edited' ELSE title END AS title FROM {_CHUNKS} WHERE document_id IS NOT NULL AND id % 7 <> 0) WHERE trim(body) <> ''
""",
)
def edited_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after a review that renames some and deletes others."""
    c = chunks(spark, d, "document_id", "position", "title", "body").where("document_id is not null")
    edits = c.where("id % 5 = 0 or id % 7 = 0").select("id", F.when(F.col("id") % 5 == 0, "Edited").alias("title"), F.lit(None).cast("string").alias("body"), (F.col("id") % 7 == 0).alias("deleted"))
    return sg.apply_edits(c, edits).select("id", "position", "title", "document_id")


@query(
    "position_inversions",
    f"""
SELECT document_id, coalesce(avg(CASE WHEN p IS NOT NULL THEN CAST(position < p AS DOUBLE) END), 0.0) AS inverted
FROM (SELECT document_id, position, lag(position) OVER (PARTITION BY document_id ORDER BY id) AS p FROM {_CHUNKS} WHERE document_id IS NOT NULL) GROUP BY 1
""",
)
def position_inversions(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "position").where("document_id is not null")
    return sg.inversions(c, ["document_id"], "id", "position")


@query(
    "id_gaps",
    f"""
SELECT document_id, count(*) AS n, max(id) - min(id) AS span, count(DISTINCT id) * 1.0 / (max(id) - min(id) + 1) AS density,
  list_sort(list(g) FILTER (g IS NOT NULL))[CAST(floor(count(g) / 2) AS INT) + 1] AS median_gap
FROM (SELECT document_id, id, id - lag(id) OVER (PARTITION BY document_id ORDER BY id) AS g FROM {_CHUNKS} WHERE document_id IS NOT NULL) GROUP BY 1
""",
)
def id_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id").where("document_id is not null")
    return sg.gap_statistics(c, ["document_id"], "id")


@query(
    "untitled_runs",
    f"""
SELECT document_id, start, length FROM (
  SELECT document_id, min(position) AS start, count(*) AS length, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, min(position)) AS k FROM (
    SELECT document_id, position, position - row_number() OVER (PARTITION BY document_id ORDER BY position) AS i
    FROM (SELECT document_id, position, bool_and(title IS NULL) AS f FROM {_CHUNKS} WHERE document_id IS NOT NULL GROUP BY 1, 2) WHERE f) GROUP BY document_id, i) WHERE k = 1
""",
)
def untitled_runs(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of positions without a title, per document."""
    c = chunks(spark, d, "document_id", "position", "title").where("document_id is not null")
    p = c.groupBy("document_id", "position").agg(F.bool_and(F.col("title").isNull()).alias("flag"))
    return sg.longest_run(p, ["document_id"], "position", "flag")


@query("chunk_batches")
def chunk_batches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in batches of at most 2,000 estimated tokens per document."""
    c = chunks(spark, d, "document_id", "position", "body").where("document_id is not null")
    s = c.select("document_id", "id", "position", sg.token_estimate(F.col("body")).alias("tokens"))
    return sg.batches(s, ["document_id"], ["position", "id"], "tokens", 2000)


_HASH = "md5(coalesce(status, '') || '|' || coalesce(filename, '') || '|' || chunk_count)"


def digests(df: DataFrame) -> DataFrame:
    return df.select("id", F.md5(F.concat_ws("|", F.coalesce("status", F.lit("")), F.coalesce("filename", F.lit("")), F.col("chunk_count").cast("string"))).alias("digest"))


@query(
    "state_diff",
    f"""
WITH s AS (SELECT id, arg_min({_HASH}, loaded_at) AS digest FROM document_files WHERE id % 11 <> 0 GROUP BY id),
c AS (SELECT id, arg_max({_HASH}, loaded_at) AS digest FROM document_files WHERE id % 13 <> 0 GROUP BY id)
SELECT coalesce(c.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'removed' WHEN c.digest = s.digest THEN 'same' ELSE 'changed' END AS change FROM c FULL JOIN s ON c.id = s.id
""",
)
def state_diff(spark: SparkSession, d: str) -> DataFrame:
    """First versions as the stored state against the latest versions; some files removed, some new."""
    t = table(spark, d, "document_files")
    cols = ["status", "filename", "chunk_count"]
    state = digests(first_rows(t.where("id % 11 <> 0"), "id", cols))
    now = digests(latest_rows(t.where("id % 13 <> 0"), "id", cols))
    return cs.state_diff(now, state, "id", "digest")


@query(
    "upserted_files",
    f"""
WITH o AS (SELECT id, arg_min({_HASH}, loaded_at) AS digest FROM document_files GROUP BY id),
n AS (SELECT id, arg_max({_HASH}, loaded_at) AS digest FROM document_files WHERE deleted_at IS NULL GROUP BY id)
SELECT id, digest FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, digest FROM n
""",
)
def upserted_files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "document_files")
    cols = ["status", "filename", "chunk_count"]
    return cs.upsert(digests(first_rows(t, "id", cols)), digests(latest_rows(t.where("deleted_at is null"), "id", cols)), "id")


@query(
    "top_matches",
    """
SELECT query_id, vec_id, score, rank::INT AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON v.label = q.label WHERE q.vec_id % 50 = 0) WHERE rank <= 8
""",
)
def top_matches(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest vectors of the query's label, for every 50th id as query."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))
    return cs.top_matches(q, v, 8, "wanted")


_MESSAGES = "(SELECT m.id, m.content, m.position, m.session_id, s.client_id FROM (SELECT * FROM chat_messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) m JOIN (SELECT id, arg_min(client_id, loaded_at) AS client_id FROM chat_sessions GROUP BY id) s ON s.id = m.session_id)"


@query(
    "resolved_vessels",
    f"""
WITH v AS (SELECT id, client_id, lower(name) AS n, list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: length(x) >= 3) AS w FROM (SELECT id, arg_min(name, loaded_at) AS name, arg_min(client_id, loaded_at) AS client_id FROM vessels GROUP BY id)),
m AS (SELECT id, client_id, lower(content) AS c, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: length(x) >= 3) AS w FROM {_MESSAGES}),
p AS (SELECT m.id, v.id AS vid FROM m JOIN v USING (client_id) WHERE len(list_filter(v.w, lambda x: contains(m.c, x))) > 0 OR len(list_filter(m.w, lambda x: contains(v.n, x))) > 0)
SELECT m.id AS message_id, u.vid AS entity_id FROM m LEFT JOIN (SELECT id, min(vid) AS vid FROM p GROUP BY id HAVING count(*) = 1) u ON u.id = m.id
""",
)
def resolved_vessels(spark: SparkSession, d: str) -> DataFrame:
    s = first_rows(table(spark, d, "chat_sessions"), "id", ["client_id"]).select(F.col("id").alias("session_id"), "client_id")
    m = first_rows(table(spark, d, "chat_messages"), "id", ["session_id", "content"]).join(s, "session_id").select(F.col("id").alias("message_id"), "client_id", "content")
    v = first_rows(table(spark, d, "vessels"), "id", ["client_id", "name"]).select("client_id", F.col("id").alias("entity_id"), "name")
    return cs.resolve_entities(m, v)


@query("last_turns", f"SELECT id, session_id FROM {_MESSAGES} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY position DESC, id DESC) <= 4")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    s = first_rows(table(spark, d, "chat_sessions"), "id", ["client_id"]).select(F.col("id").alias("session_id"))
    m = first_rows(table(spark, d, "chat_messages"), "id", ["session_id", "position"]).join(s, "session_id")
    return cs.last_turns(m, 2).select("id", "session_id")


@query("appended_messages", "SELECT session_id, role, content, CAST(p + k AS INT) AS position FROM (SELECT session_id, max(position) AS p FROM chat_messages WHERE session_id IS NOT NULL GROUP BY 1) CROSS JOIN (VALUES (1, 'user', 'next'), (2, 'assistant', 'reply')) v(k, role, content) WHERE k = 1 OR session_id % 2 = 0 UNION ALL SELECT -1, 'user', 'first', 0")
def appended_messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").where("session_id is not null")
    ids = m.select("session_id").distinct()
    turn = lambda df, seq, role, text: df.select("session_id", F.lit(seq).alias("seq"), F.lit(role).alias("role"), F.lit(text).alias("content"))
    new = turn(ids, 3, "user", "next").unionByName(turn(ids.where("session_id % 2 = 0"), 7, "assistant", "reply")).unionByName(turn(spark.range(1).select(F.lit(-1).cast("long").alias("session_id")), 0, "user", "first"))
    return cs.append_messages(m, new)


@query(
    "chunk_audit",
    f"""
WITH e AS (SELECT f.id AS doc_id, unnest(generate_series(0, f.n - 1)) AS number FROM (SELECT id, arg_max(chunk_count, loaded_at) AS n FROM document_files GROUP BY id) f WHERE f.n > 0),
g AS (SELECT document_id AS doc_id, position AS number, arg_max(body, id) AS body FROM {_CHUNKS} WHERE document_id IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, count(*) FILTER (body IS NULL) AS missing, count(*) FILTER (body IS NOT NULL AND trim(body) = '') AS empty,
  CASE WHEN count(*) FILTER (body IS NULL) = 0 AND count(*) FILTER (body IS NOT NULL AND trim(body) = '') = 0 THEN 'OK' ELSE 'ISSUES FOUND' END AS status
FROM e LEFT JOIN g USING (doc_id, number) GROUP BY 1
""",
)
def chunk_audit(spark: SparkSession, d: str) -> DataFrame:
    """Announced chunk numbers against the chunks that are there."""
    f = latest_rows(table(spark, d, "document_files"), "id", ["chunk_count"]).where("chunk_count > 0")
    expected = f.select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("number"))
    c = chunks(spark, d, "document_id", "position", "body").where("document_id is not null")
    return cs.audit(expected, c.select(F.col("document_id").alias("doc_id"), F.col("position").alias("number"), "body", F.col("id").alias("position")))


@query("audit_summary", "SELECT status, count(*) AS documents FROM (" + query.sql["chunk_audit"] + ") GROUP BY 1")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return chunk_audit(spark, d).groupBy("status").agg(F.count("*").alias("documents"))


@query("coverage_audit")
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Words and headings kept per document: all chunks as raw, titled ones as final."""
    c = chunks(spark, d, "document_id", "title", "body").where("document_id is not null").withColumnRenamed("document_id", "doc_id")
    final = c.where("title is not null")
    source = c.groupBy("doc_id").agg(F.sum(F.size(F.split("body", " "))).alias("words"))
    return cs.coverage(c, final, source, c.where("title is not null").select("doc_id", F.col("title").alias("heading")).distinct())
