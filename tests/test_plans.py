"""The composed plans on small fixtures."""

from tests.test_sources import docx
from tidewater.plans.pipelines import answer_context, audit_chunks, build_chunks
from tidewater.sources.files import discover


def test_folder_to_audited_chunks(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(docx())
    (tmp_path / "c.txt").write_text("1. Hire\npaid monthly in advance\n2. Off-hire\nnone at all " + "word " * 12)
    (tmp_path / "n.txt").write_text("just a note")
    (tmp_path / "e.txt").write_text("")
    f = discover(spark, str(tmp_path))
    c = build_chunks(f, 10)
    got = {}
    for r in c.orderBy("path", "position").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.position, r.title, len(r.body.split())))
    assert got["n.txt"] == [(0, None, 3)] and "e.txt" not in got
    assert got["c.txt"] == [(0, "1. Hire", 4), (1, "2. Off-hire (part 1)", 10), (2, "2. Off-hire (part 2)", 5)]
    assert [t for _, t, _ in got["x.docx"]] == ["Holds", "Holds / Deep", "Next"]
    audit = {r.doc_id.rsplit("/", 1)[1]: r for r in audit_chunks(f, c).collect()}
    assert audit["x.docx"].headings == 3 and audit["n.txt"].coverage_pct == 100


def test_answer_context(frame):
    v = frame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    q = frame([(5, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = frame([(1, "Hire", "paid monthly"), (2, None, "other")], "vec_id long, title string, body string")
    assert answer_context(q, v, c, 2).first().context == "[1] Hire (relevance: 1.00)\npaid monthly\n\n---\n\n[2] Chunk 2 (relevance: 0.00)\nother"
