"""State, search, entity and audit operators."""

from pyspark.sql import functions as F

from tidewater.operators import chunksets as cs


def test_state_diff_partitions_the_outer_set(frame):
    c = frame([("a", "1"), ("b", "2"), ("d", None)], "k string, h string")
    s = frame([("a", "1"), ("b", "9"), ("c", "3"), ("d", None)], "k string, h string")
    assert {r.k: r.change for r in cs.state_diff(c, s, "k", "h").collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "same"}


def test_failed_work_is_retried(frame):
    s = frame([("a", "1"), ("x", "0")], "k string, h string")
    c = frame([("a", "2"), ("b", "5")], "k string, h string")
    done = frame([("b",)], "k string")
    assert {r.k: r.h for r in cs.next_state(s, c, done, "k").collect()} == {"a": "1", "b": "5"}


def test_dedup_is_idempotent_and_keeps_the_richest(frame):
    rows = [(1, "v", None, "Same  text"), (2, "v", "T", "same text"), (3, "v", "T", "SAME TEXT"), (4, "w", None, "same text"), (5, "v", None, None), (6, "v", None, "")]
    d = frame(rows, "id long, scope string, title string, body string")
    got = {r.id: r.copies for r in cs.dedup(d, "scope", "body", F.col("title").isNotNull(), F.lit(False), "id").collect()}
    assert got == {2: 3, 4: 1, 5: 2} or got == {2: 3, 4: 1, 6: 2}


def test_top_matches_falls_back(frame):
    v = frame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [1.0, 1.0], 1), (4, None, 1)], "vec_id long, embedding array<float>, label int")
    q = frame([(10, [1.0, 0.1], 1), (11, [0.0, 1.0], 7)], "query_id long, embedding array<float>, wanted int")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in cs.top_matches(q, v, 2, "wanted").orderBy("query_id", "rank").collect()]
    assert got == [(10, 1, 1), (10, 3, 2), (11, 2, 1), (11, 3, 2)]
    assert cs.top_matches(q.where("false"), v, 2, "wanted").count() == 0


def test_resolve(frame):
    m = frame([(1, "c", "Where is the Amber Quern now?"), (2, "c", "Amber or Violet"), (3, "c", "hello"), (4, "z", "Amber"), (5, "c", None)], "message_id long, client_id string, content string")
    e = frame([("c", 7, "Amber Quern"), ("c", 8, "Violet Heron"), ("c", 9, None)], "client_id string, entity_id long, name string")
    assert {r.message_id: r.entity_id for r in cs.resolve_entities(m, e).collect()} == {1: 7, 2: None, 3: None, 4: None, 5: None}


def test_context_and_turns(frame):
    m = frame([(1, 1, None, "text", 0.5), (1, 2, "h", " ", 0.4), (1, 3, "h", "more", 0.25)], "query_id long, rank int, header string, content string, score double")
    assert cs.context_blocks(m).first().context == "[1] Chunk 1 (relevance: 0.50)\ntext\n\n---\n\n[3] h (relevance: 0.25)\nmore"
    t = frame([(i, 1, i) for i in range(7)], "id long, session_id long, position int")
    assert sorted(r.id for r in cs.last_turns(t, 2).collect()) == [3, 4, 5, 6] and cs.last_turns(t, 0).count() == 7


def test_audit_and_coverage(frame):
    e = frame([(1, 1), (1, 2), (1, 3)], "doc_id long, number int")
    f = frame([(1, 1, "x", 1), (1, 1, "", 2), (1, 2, "y", 3)], "doc_id long, number int, body string, position int")
    r = cs.audit(e, f).first()
    assert (r.missing, r.empty, r.status) == (1, 1, "ISSUES FOUND")
    raw = frame([(1, "1. Hire payment", "a b c d e f g h i j")], "doc_id long, title string, body string")
    src = frame([(1, 20), (2, 0)], "doc_id long, words long")
    heads = frame([(1, "Hire Payment"), (1, "Arbitration")], "doc_id long, heading string")
    got = {x.doc_id: x for x in cs.coverage(raw, raw, src, heads).collect()}
    assert got[1].coverage_pct == 50 and "extraction lost words" in got[1].issues and got[2].coverage_pct == 100


def test_every_chunk_has_one_embedding(spark, sf):
    from tidewater.queries import catalogue

    got = [r.id for r in catalogue.queries()["chunk_embeddings"](spark, sf).select("id").collect()]
    ids = {r.id for r in spark.read.parquet(f"{sf}/document_chunks.parquet").select("id").where("id is not null").collect()}
    assert len(got) == len(ids) and set(got) == ids
