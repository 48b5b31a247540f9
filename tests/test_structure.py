"""Parts, trees, particulars, holds and lookups."""

from pyspark.sql import functions as F

from tidewater.operators import classify as cl
from tidewater.operators import sections as se
from tidewater.operators import structure as so

PATTERNS = [(r"^1[.)]\s*Vessel", "vessel"), (r"^2[.)]\s*Contract", "contract"), (r"^3[.)]\s*Delivery", "delivery")]


def test_parts_replace_and_join(frame):
    t = frame([(1, "intro\n1. Vessel Details\na\n2. Contract\ncharter party\n3. Delivery\nx\n1. Vessel Details\nb"), (2, None), (3, "")], "k long, t string")
    parts = so.assign_parts(so.text_rows(t, "k", "t"), "k", PATTERNS, ("delivery", "charter party", 200))
    got = {(r.k, r.part): r.body for r in so.part_bodies(parts, "k").collect()}
    assert got == {(1, "vessel"): "b", (1, "contract"): "charter party\n3. Delivery\nx"}
    assert {(r.k, r.part): r.body for r in so.part_bodies(parts, "k", "join").collect()}[1, "vessel"] == "a\nb"


def test_flatten(spark):
    j = '{"t": {"2_contract": {"content": [], "tables": [[["a", null], ["b", " c "]]], "sub_chapters": {"cp": {"content": ["free"], "clauses": {"1": {"title": "Hire", "content": ["x", "y"]}, "2": {"title": "Nil", "content": []}}, "rider_clauses": {"1": {"title": "R", "content": ["z"]}}}}}}}'
    d = spark.createDataFrame([(1, j), (2, None)], "k long, j string").select("k", F.from_json("j", f"t {so.TREE}")["t"].alias("t"))
    got = {(r.kind, r.number): (r.body, r.line_count) for r in so.flatten_tree(d, "k", "t").collect()}
    assert got == {("chapter", None): ("a | N/A\nb | c", 2), ("clause", "1"): ("x\ny", 2), ("rider", "1"): ("z", 1), ("text", None): ("free", 1)}


def test_misplaced_headers():
    one = {1: ("1. Hire", ["paid", "7) Speed and Consumption", "fast", "9. Dangerous Goods", "none", "9) BIMCO Ice Clause", "x"]), 3: ("3. Off", ["y", "1) Notices", "z"]), 4: ("4. Empty", [])}
    got = se.split_misplaced(one)
    assert got == {1: ("1. Hire", ["paid"]), 7: ("7) Speed and Consumption", ["fast"]), 9: ("9) Dangerous Goods", ["none", "9) BIMCO Ice Clause", "x"]), 3: ("3. Off", ["y", "1) Notices", "z"]), 4: ("4. Empty", [])}
    assert se.split_misplaced({2: ("2. A", ["4) Notices", "b"]), 4: ("4. Empty", [])})[4] == ("4) Notices", ["b"])
    assert se.header_inside("10. Rate of Hire; all. in") is None and se.header_inside("5. x (including y) z") and se.header_inside("5. x. War Clause") == (5, "x. War Clause") and se.split_misplaced({}) == {}


def test_routes():
    text = "first page words here\f \fthird page"
    assert se.page_batches(["a b c", "d e", "f g h i j k"], 5) == [("Pages 1-2", "a b c\n\nd e"), ("Page 3", "f g h i j"), ("Page 3", "k")]
    assert se.route_text(text, "raw") == [(None, "first page words here\n\nthird page")] and se.route_text(text, "font") == [("Section 1", "first page words here third page")]
    assert [t for t, _ in se.route_text("1. Hire\npaid\f2. Off\nnot", "presplit")] == ["1. Hire", "2. Off"] and se.route_text(" \f ", "raw") == [] == se.route_text("", "font")
    assert se.fixed_chunks("a b c", 2) == [("Section 1", "a b"), ("Section 2", "c")]


def test_marked_pages(spark):
    df = spark.createDataFrame([("a\f \fb",), (None,), ("",)], "t string")
    assert [r.m for r in df.select(se.marked_pages(F.col("t")).alias("m")).collect()] == ["--- PAGE 1 ---\na\n\n--- PAGE 3 ---\nb", None, ""]


def test_far_tables_need_words(frame):
    s = frame([("d", 1, "Lifting\nx", 0, 2), ("d", 2, "zzz", 500, 502), (None, 3, "Lifting", 0, 1)], "doc string, section_id int, text string, start int, end int")
    t = frame([("d", 1, "capacity 5", 5, 6), ("d", 2, "capacity 6", 5, 6), ("d", 3, " ", 2, 3), ("d", 4, None, 2, 3), ("e", 5, "lifting", 0, 1)], "doc string, table_id int, text string, start int, end int")
    assert [(r.section_id, r.table_id) for r in se.attach_tables(s, t, "doc").collect()] == [(1, 1)]
    assert se.attach_tables(s.where("false"), t, "doc").count() == 0


def test_names():
    assert cl.name_of_document(None, None) == "" and cl.name_of_document("Ship name: MV Blue", "x.pdf") == "MV BLUE"
    assert cl.name_of_document("", "folder/MV_Grey Heron final.pdf") in ("MV_GREY HERON", "MV GREY HERON")
    assert cl.name_of_document("nothing\nMV Amber Quern\n", "x.pdf") == "MV AMBER QUERN" and cl.name_of_document("x", "Doc 7.pdf") == "DOC 7"


def test_enriched(spark):
    rows = ['```json\n[{"title": "a", "body": "b"}]\n```', '{"chunks": [{"title": null, "body": "c"}]}', "no json", None, '[{"title": "a"']
    got = [r.e for r in spark.createDataFrame([(x,) for x in rows], "a string").select(so.parse_enriched(F.col("a")).alias("e")).collect()]
    assert got[0][0].body == "b" and got[1][0].body == "c" and not got[2] and not got[3] and not (got[4] and got[4][0].body)


def test_particulars(frame):
    c = frame([(1, 2, "Tonnage", "Gross tonnage: 12,345."), (1, 1, "General information", "IMO no. 9123456 | Call sign: PEVT\nFlag state: Malta | x"), (1, 3, "Tonnage", "Gross tonnage 9"), (1, 4, None, None)], "k long, o int, t string, b string")
    got = {r.field: r.value for r in so.particulars(c, "k", "o", "t", "b").collect()}
    assert got == {"gross_tonnage": "12,345", "imo_number": "9123456", "call_sign": "PEVT", "flag_state": "Malta"}
    r = frame([(1, "old", None, "n"), (2, None, "", "n")], "k long, imo_number string, call_sign string, name string")
    full = {x.k: (x.imo_number, x.call_sign) for x in so.fill_missing(r, so.particulars(c, "k", "o", "t", "b"), "k", ["imo_number", "call_sign"]).collect()}
    assert full == {1: ("old", "PEVT"), 2: (None, None)}


def test_holds(frame):
    v = frame([(1, '[{"id": 7, "length": 10, "breadth": 5, "height": 4, "upper_height": 1.5}, {"length": 0, "breadth": 1, "height": 1}, {"length": 2, "breadth": 2, "height": 2}]'), (2, None), (3, "nonsense")], "v long, j string")
    got = {r.id: (r.has_tween, r.lower_height, r.upper_height) for r in so.parse_holds(v, "v", "j").collect()}
    assert got == {7: (True, 2.5, 1.5), 3: (False, 2.0, 0.0)}
    t = frame([(1, "Length over all: abt. 100,5 m\nNumber of holds/hatches: 2\nTween deck: yes\nBreadth: 16 m"), (2, "no data"), (3, None)], "k long, t string")
    r = so.hold_text(t, "k", "t").collect()
    assert len(r) == 1 and (r[0].loa, r[0].holds_count, r[0].has_tween, r[0].estimated, r[0].length) == (100.5, 2, True, True, 27.1)
    p = frame([(5.0,)], "t double").select(so.nearest_pair(F.from_json(F.lit('[{"lower": 1, "upper": 2}, {"lower": 3, "upper": 2.5}]'), "array<struct<lower: double, upper: double>>"), F.col("t")).alias("p")).first().p
    assert (p.lower, p.upper) == (3.0, 2.5)


def test_lookups(frame):
    d = frame([(1, "c", "A", None), (2, "c", "A", 5), (3, "c", "B", None), (4, None, "A", None)], "id long, client string, name string, v long")
    look = frame([("c", "A", 9), ("c", "A", 7)], "client string, name string, vid long")
    assert {r.id: r.v for r in so.first_match_backfill(d, look, ["client", "name"], "v", "vid", "vid").collect()} == {1: 7, 2: 5, 3: None, 4: None}
    b, unknown = so.overlay(frame([(1, 1.0), (2, None)], "id long, x double"), frame([(1, None), (2, 3.0), (9, 1.0)], "id long, x double"), "id", ["x"])
    assert {r.id: r.x for r in b.collect()} == {1: 1.0, 2: 3.0} and [r.id for r in unknown.collect()] == [9]
    f = frame([("a.PDF", None), ("b.xls", ""), ("agent.txt", None), ("x.txt", "My Agencies"), (None, None)], "n string, d string")
    assert [r.c for r in f.select(so.file_class(F.col("n"), F.col("d")).alias("c")).collect()] == ["vessel", "agency", "agency", "agency", "vessel"]


def test_best_sections_asks_for_every_item(spark, sf):
    """Each item but the last of its suite has an answer: the one of a higher id with the best score, of equals the smallest id."""
    import re

    from tidewater.queries import catalogue, structure

    items = {}
    for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect():
        items.setdefault(r.suite, []).append((r.item_id, r.text.lower(), set(re.findall(r"\b\w{3,}\b", r.text.lower()))))
    want = {}
    for suite, rows in items.items():
        for i, t, a in rows:
            scored = [(min(100.0, len(a & b) / len(a | b) * 100 + sum(20 for p in structure.PHRASES if p in t and p in u)), -j) for j, u, b in rows if j > i and a & b]
            if scored:
                want[suite, i] = (-max(scored)[1], round(max(scored)[0], 6))
    got = {(r.suite, r.section_id): (r.table_id, round(r.score, 6)) for r in catalogue.queries()["best_sections"](spark, sf).collect()}
    assert got == want and len(got) == 237


def test_patch_and_pages(frame):
    items = frame([(1, 1.0, 2.0, 3.0, 9.0), (2, None, 2.0, 3.0, 9.0)], "id long, l double, w double, h double, volume_m3 double")
    p = frame([(1, 5.0, 7.0), (2, None, 7.0), (9, 1.0, 1.0)], "id long, l double, w double")
    assert {r.id: (r.l, r.w, r.volume_m3) for r in so.patch_items(items, p, "id", ["l"]).collect()} == {1: (5.0, 2.0, 30.0), 2: (None, 2.0, 9.0)}
    assert so.page_count(items.where("false"), 20).first() == (0, 1) and so.page_count(items, 1).first() == (2, 2)
