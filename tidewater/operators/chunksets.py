"""Chunk sets: exact duplicates, consolidation, collections in step with their sources, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions import text as tx
from tidewater.operators import ordered as od


def dedup(df: DataFrame, scope: str, content: str, titled: Column, sectioned: Column, key: str) -> DataFrame:
    """The richest row of each scope and content: titled 2, sectioned 1, length up to 1; of equals the smallest key.

    Contents compare without case and white-space differences. The winner is an
    aggregate, so copies shrink before the shuffle and a hot text needs no sort.
    """
    score = F.when(titled, 2.0).otherwise(0.0) + F.when(sectioned, 1.0).otherwise(0.0) + F.least(F.char_length(content), F.lit(1000)) / 1000
    h = F.md5(tx.squeeze(F.lower(F.coalesce(content, F.lit("")))))
    best = df.select(F.col(scope).alias("_s"), h.alias("_h"), F.struct(score.alias("score"), (-F.col(key)).alias("neg")).alias("_r")).groupBy("_s", "_h").agg(F.max("_r").alias("_r"), F.count("*").alias("copies"))
    return best.select(F.col("_s").alias(scope), (-F.col("_r.neg")).alias(key), F.col("_r.score").alias("score"), "copies")


def consolidate(df: DataFrame, group: list[str], order: str, content: str, block: int = 1000, glue: str = "\n\n") -> DataFrame:
    """(group, block, body): contents joined in order, in blocks of at most ``block`` rows so that no group is gathered whole."""
    r = od.numbered(df, group, [order], "_n").withColumn("block", F.floor((F.col("_n") - 1) / block).cast("int"))
    g = r.groupBy(*group, "block").agg(F.sort_array(F.collect_list(F.struct(order, content))).alias("_c"))
    return g.select(*group, "block", F.array_join(F.transform("_c", lambda x: x[content]), glue).alias("body"))


def type_runs(df: DataFrame, group: list[str], order: str, kind: str) -> DataFrame:
    """(group, run, kind, first, last, n): stretches of equal kinds in order."""
    wrapped = df.withColumn("_w", F.struct(F.col(kind).alias("k")))
    r = od.lagged(wrapped, group, [order], "_w", "_p")
    r = r.withColumn("_new", (F.col("_p").isNull() | ~F.col("_p.k").eqNullSafe(F.col(kind))).cast("int"))
    r = od.running_sum(r, group, [order], "_new", "run")
    return r.groupBy(*group, "run", kind).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def state_diff(current: DataFrame, state: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): ``new``, ``changed``, ``same`` or ``removed``; a full outer join on the key."""
    c, s = current.select(key, F.col(digest).alias("_c")), state.select(key, F.col(digest).alias("_s"))
    j = c.withColumn("_inc", F.lit(True)).join(s.withColumn("_ins", F.lit(True)), key, "full_outer")
    change = F.when(F.col("_ins").isNull(), "new").when(F.col("_inc").isNull(), "removed").when(F.col("_c").eqNullSafe(F.col("_s")), "same").otherwise("changed")
    return j.select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key does not come anew, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def next_state(state: DataFrame, current: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The state after a run: only keys whose work is ``done`` take their new digest; failed ones stay as they were and are retried."""
    fresh = current.join(done.select(key), key, "left_semi")
    return upsert(state, fresh, key).join(current.select(key), key, "left_semi")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def top_matches(queries: DataFrame, vectors: DataFrame, k: int, wanted: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest vectors of each query by cosine, ties to the smaller id.

    ``queries``: query_id, embedding and, where filtered, ``wanted``, which must
    equal the vectors' ``label``; a query whose filter leaves nothing is answered
    unfiltered. The stated query set is compared with all rows by Arrow batches:
    one matrix product per batch, ``k`` candidates per query and batch leave it.
    The queries are taken in blocks of ``QUERY_BLOCK``, so what is broadcast is bounded.
    """
    spark = vectors.sparkSession
    cols = ["query_id", "embedding", *([wanted] if wanted else [])]
    rows, out = [], None
    for r in queries.select(*cols).toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            part = _search(vectors, rows, k, wanted)
            out = part if out is None else out.unionByName(part)
            rows = []
    if rows or out is None:
        part = _search(vectors, rows, k, wanted) if rows else spark.createDataFrame([], "query_id long, vec_id long, score double, filtered boolean")
        out = part if out is None else out.unionByName(part)
    hit = out.groupBy("query_id").agg(F.max("filtered").alias("_any"))
    j = out.join(hit, "query_id").where(F.col("filtered") == F.col("_any"))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


#: Queries compared with all vectors at once.
QUERY_BLOCK = 2000


def _search(vectors: DataFrame, rows: list, k: int, wanted: str | None) -> DataFrame:
    import numpy as np
    import pandas as pd

    ids = np.array([r["query_id"] for r in rows], np.int64)
    q = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    labels = [r[wanted] for r in rows] if wanted else [None] * len(rows)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q, labels))

    def best(scores: np.ndarray, vec: np.ndarray, filtered: bool, qid: int) -> pd.DataFrame:
        order = np.lexsort((vec, -scores))[:k]
        return pd.DataFrame({"query_id": qid, "vec_id": vec[order], "score": scores[order], "filtered": filtered})

    def run(batches):
        qids, qs, want = shared.value
        for b in batches:
            b = b[b.embedding.notna()]
            if b.empty:
                continue
            m = np.stack(b.embedding.to_numpy()).astype(np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            s, vec, label = qs @ m.T, b.vec_id.to_numpy(), b.label.to_numpy()
            parts = []
            for i, qid in enumerate(qids):
                if wanted and want[i] is not None:
                    ok = label == want[i]
                    if ok.any():
                        parts.append(best(s[i][ok], vec[ok], True, int(qid)))
                parts.append(best(s[i], vec, not wanted or want[i] is None, int(qid)))
            yield pd.concat(parts, ignore_index=True)

    return vectors.select("vec_id", "embedding", "label").mapInPandas(run, "query_id long, vec_id long, score double, filtered boolean")


def resolve_entities(messages: DataFrame, entities: DataFrame) -> DataFrame:
    """(message_id, entity_id): the one entity of the message's tenant that it names, else null.

    An entity is named if one of its words of three letters and more is part of a
    word of the message, or the other way round; its whole name in the message
    implies that. Words meet through three-letter keys, and per tenant and word
    only the smallest and largest entity are kept, so a word that all entities
    share forms no pairs of messages and entities. Ambiguous messages stay null.
    """
    long = lambda c: F.array_distinct(F.filter(tx.words(F.lower(F.coalesce(c, F.lit("")))), lambda w: F.char_length(w) >= 3))
    thirds = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    e = entities.select("client_id", "entity_id", F.explode(long(F.col("name"))).alias("_e")).groupBy("client_id", "_e").agg(F.min("entity_id").alias("_lo"), F.max("entity_id").alias("_hi"))
    said = messages.select("message_id", "client_id", F.explode(long(F.col("content"))).alias("_m"))
    m = said.select("client_id", "_m").distinct()
    wide = m.select("*", F.explode(thirds(F.col("_m"))).alias("_k")).join(e.withColumn("_k", F.substring("_e", 1, 3)), ["client_id", "_k"]).where(F.contains("_m", F.col("_e")))
    narrow = m.withColumn("_k", F.substring("_m", 1, 3)).join(e.select("*", F.explode(thirds(F.col("_e"))).alias("_k")), ["client_id", "_k"]).where(F.contains("_e", F.col("_m")))
    cols = ["client_id", "_m", "_lo", "_hi"]
    words = wide.select(*cols).unionByName(narrow.select(*cols)).groupBy("client_id", "_m").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    one = said.join(words, ["client_id", "_m"]).groupBy("message_id").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).where("_lo = _hi")
    return messages.select("message_id").join(one.select("message_id", F.col("_lo").alias("entity_id")), "message_id", "left")


def context_blocks(matches: DataFrame) -> DataFrame:
    """(query_id, context): matches (query_id, rank, header, content, score) as one numbered text; blank contents are skipped."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("header", F.concat(F.lit("Chunk "), F.col("rank").cast("string"))), F.lit(" (relevance: "), F.format_string("%.2f", "score"), F.lit(")\n"), F.col("content"))
    m = matches.where("content is not null and trim(content) <> ''").select("query_id", "rank", part.alias("p"))
    g = m.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "p"))).alias("_p"))
    return g.select("query_id", F.array_join(F.transform("_p", lambda x: x["p"]), "\n\n---\n\n").alias("context"))


def last_turns(messages: DataFrame, turns: int) -> DataFrame:
    """The last ``2 * turns`` messages of each session; 0 keeps all."""
    if turns == 0:
        return messages
    return od.top_rows(messages, ["session_id"], [F.col("position").desc(), F.col("id").desc()], 2 * turns, F.col("id"))


def message_window(messages: DataFrame, system: str, turns: int) -> DataFrame:
    """(session_id, seq, role, content): the system line first, then each session's last turns in order."""
    last = last_turns(messages, turns)
    rank = F.row_number().over(W.partitionBy("session_id").orderBy("position", "id"))
    rows = last.select("session_id", rank.alias("seq"), "role", "content")
    head = last.select("session_id").distinct().select("session_id", F.lit(0).alias("seq"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    return head.unionByName(rows)


def append_messages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New messages (session_id, seq, role, content) with positions that go on from the session's last."""
    last = existing.groupBy("session_id").agg(F.max("position").alias("_last"))
    j = od.numbered(new, ["session_id"], ["seq"], "_n").join(last, "session_id", "left")
    return j.select("session_id", "role", "content", (F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_n") - 1).cast("int").alias("position"))


#: Titles of a document that one array holds, about.
TITLES = 500


def coverage(raw: DataFrame, final: DataFrame, source: DataFrame, headings: DataFrame) -> DataFrame:
    """Audit of what extraction kept, per document.

    ``raw`` and ``final``: (doc_id, title, body) before and after enrichment;
    ``source``: (doc_id, words); ``headings``: (doc_id, heading) that should be
    found among the final titles. Ratios are null where their base is 0; the
    coverage is the truncated per cent of headings, else of words, 100 at most.
    A heading listed twice counts once. Titles are met in blocks of ``TITLES``.
    """
    total = lambda df, name: df.groupBy("doc_id").agg(F.sum(tx.word_count(F.col("body"))).alias(name))
    words = F.transform(tx.significant_words(F.col("heading")), lambda w: w)
    distinct = final.where("title is not null").select("doc_id", F.lower("title").alias("_title")).distinct()
    part = F.pmod(F.xxhash64("_title"), F.lit(1 << 30))
    sized = distinct.join(distinct.groupBy("doc_id").agg(F.count("*").alias("_all")), "doc_id")
    titles = sized.groupBy("doc_id", (part % F.ceil(F.col("_all") / TITLES)).alias("_block")).agg(F.collect_list("_title").alias("_titles"))
    h = headings.join(titles, "doc_id", "left").select("doc_id", "heading", words.alias("_w"), F.coalesce("_titles", F.array().cast("array<string>")).alias("_titles"))
    need = F.greatest(F.lit(1), F.ceil(F.size("_w") / 2))
    covered = F.exists("_titles", lambda t: F.size(F.filter("_w", lambda w: F.contains(t, w))) >= need) | (F.size("_w") == 0)
    met = h.groupBy("doc_id", "heading").agg(F.max(covered).alias("_met"), F.count("*").alias("_blocks"))
    hs = met.groupBy("doc_id").agg(F.count("*").alias("headings"), F.count_if("_met").alias("covered"))
    j = source.join(total(raw, "raw_words"), "doc_id", "left").join(total(final, "final_words"), "doc_id", "left").join(hs, "doc_id", "left")
    j = j.select("doc_id", F.col("words").alias("source_words"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_words", "final_words", "headings", "covered")])
    enrichment = F.col("final_words") / F.nullif("raw_words", F.lit(0))
    extraction = F.col("raw_words") / F.nullif("source_words", F.lit(0))
    pct = F.when(F.col("headings") > 0, (F.col("covered") * 100 / F.col("headings")).cast("int")).otherwise(F.least(F.lit(100), F.coalesce((extraction * 100).cast("int"), F.lit(100))))
    heading_pct = F.when(F.col("headings") > 0, (F.col("covered") * 100 / F.col("headings")).cast("int"))
    issues = F.array_compact(F.array(F.when(enrichment < 0.85, F.lit("enrichment lost words")), F.when(extraction < 0.80, F.lit("extraction lost words")), F.when(heading_pct < 80, F.lit("headings missing"))))
    return j.select("*", F.round(enrichment, 3).alias("enrichment_ratio"), F.round(extraction, 3).alias("extraction_ratio"), pct.alias("coverage_pct"), issues.alias("issues"))


def guard_enrichment(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(key, body): the enriched body unless it lost too many words of the raw one."""
    ratio = tx.word_count(F.col("enriched")) / F.nullif(tx.word_count(F.col("raw")), F.lit(0))
    return pairs.select("key", F.when(F.col("enriched").isNull() | (ratio < least), F.col("raw")).otherwise(F.col("enriched")).alias("body"))


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, missing, empty, status): expected (doc_id, number) against found (doc_id, number, body); of repeated numbers the last found counts."""
    f = found.groupBy("doc_id", "number").agg(F.max_by("body", "position").alias("body"))
    j = expected.distinct().join(f.withColumn("_hit", F.lit(True)), ["doc_id", "number"], "left")
    g = j.groupBy("doc_id").agg(F.count_if(F.col("_hit").isNull()).alias("missing"), F.count_if(F.col("_hit") & (F.trim(F.coalesce("body", F.lit(""))) == "")).alias("empty"))
    return g.withColumn("status", F.when((F.col("missing") == 0) & (F.col("empty") == 0), "OK").otherwise("ISSUES FOUND"))
