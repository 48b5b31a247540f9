"""Text expressions and segmentation."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.operators import segments as sg


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"), [("no ti ce", "notice"), ("Dura tion", "Duration"), ("par ti es", "parties"), ("ﬁnal", "final"), (None, None), ("", ""), ("addi ti onal", "additional"), ("draf t ing of fi nal tti x", "draf t ing offinal tti x"), ("Instruc tions\nti me", "Instructions\ntime"), ("a tion", "a tion")]
)
def test_ligatures(spark, text, want):
    assert one(spark, text, tx.repair_ligatures) == want


@pytest.mark.parametrize(("text", "want"), [("1. Vessel / Owners", "vessel_owners"), ("14 — Lien", "lien"), (None, ""), ("Ärger!", "rger")])
def test_slug(spark, text, want):
    assert one(spark, text, lambda c: tx.slug(c, 40, True)) == want


def test_names_and_labels(spark):
    assert one(spark, "ara-rotterdam_2nd", tx.display_name) == "Ara-Rotterdam 2Nd"
    assert one(spark, "General Information:", tx.is_section_label)
    assert not one(spark, "Call Sign: PEVT", tx.is_section_label)
    assert not one(spark, "conditions:", tx.is_section_label)
    assert one(spark, "Crème (brûlée) - 2", tx.ascii_id) == "Creme_brulee_2"


@pytest.mark.parametrize(
    ("line", "want"),
    [("**46. BIMCO Clause**", (46, "BIMCO Clause")), ("Clause 46 - Hire", (46, "Hire")), ("47 Charter Party - SEE APPENDIX", (47, "Charter Party - SEE APPENDIX")), ("Clause 59.", (59, "")), ("1.1 Sub", (None, None)), (None, (None, None))],
)
def test_heading_forms(spark, line, want):
    n, t = tx.clause_heading(F.col("v"))
    r = spark.createDataFrame([(line,)], "v string").select(n.alias("n"), t.alias("t")).first()
    assert (r.n, r.t) == want
    if line:
        got = sg.heading_of(line)
        assert (got or (None, None)) == want


def test_citations(spark):
    assert one(spark, "Clause 47. The owners reserve", tx.is_citation)
    assert not one(spark, "Clause 14 - Hire", tx.is_citation)
    assert one(spark, "14 — Lien", tx.is_clause_header)
    assert not one(spark, "6.438 m", tx.is_clause_header)


def test_split_clauses():
    text = "Preamble\n1.\nDuration\nbody one\n2. Hire\nbody two\n1. the vessel shall\nmore\n47. the owners reserve the right\n3. Off-hire\nbody three\nAPPENDIX A\n1. Holds\nx\n~~APPENDIX B~~\ny"
    got = sg.split_clauses(text)
    assert [t for t, _ in got] == [None, "1. Duration", "2. Hire", "3. Off-hire", "1. Holds"]
    assert "47. the owners" in got[2][1] and "1. the vessel" in got[2][1] and "~~APPENDIX B~~" in got[4][1]
    assert sg.split_clauses("no clause here") == [] and sg.split_clauses("") == []


def test_split_conserves_words():
    body = " ".join(map(str, range(3701)))
    parts = sg.split_words("T", body, 1500)
    assert " ".join(b for _, b in parts) == body and [t for t, _ in parts] == ["T (part 1)", "T (part 2)", "T (part 3)"]
    assert [t for t, _ in sg.split_words(None, body, 2000)] == ["(part 1)", "Continued (part 2)"]


def test_margin_numbers():
    lines = [f"{i} some words here" for i in range(1, 30)]
    assert sg.strip_prefix_numbers(lines) == ["some words here"] * 29
    assert sg.strip_prefix_numbers(lines[:5]) == lines[:5]
    rows = [x for i in range(1, 40) for x in ("prose line", str(i))]
    assert sg.strip_number_rows(rows) == ["prose line"] * 39
    assert sg.strip_number_rows(["12", "a", "900"]) == ["12", "a", "900"]
    assert sg.strip_trailing_numbers(["The charterers shall have the liberty to sublet; 12"]) == ["The charterers shall have the liberty to sublet"]


def test_organise_duplicates():
    text = "head\n1. Hire\na\n2. Off\nb\n1. Hire again\nc"
    assert dict(sg.organise(text, "c"))["c_1"] == "Hire\na"
    assert dict(sg.organise(text, "c", sg.KEEP_LAST))["c_1"] == "Hire again\nc"


def test_batches_respect_limit(spark, frame):
    df = frame([(1, i, s) for i, s in enumerate([5, 5, 1, 20, 1, None, 9])] + [(2, 0, 3)], "g int, i int, size int")
    got = sg.batches(df, ["g"], ["i"], "size", 10).collect()
    load = {}
    for r in got:
        load.setdefault((r.g, r.block, r.batch), []).append(r["size"] or 0)
    assert all(sum(v) <= 10 or len(v) == 1 for v in load.values()) and len(got) == 8


def test_fit_pieces():
    size = lambda t: len(t.split())
    text = "a b c. d e f.\ng h\n\ni j k l. m n."
    got = sg.fit_pieces(text, 4, size)
    assert all(size(p) <= 4 for p in got) and " ".join(got).split() == text.split()


def test_port_match(spark):
    df = spark.createDataFrame([("Rotterdam", "ROTTERDAM"), ("Ras", "Ras Umbara"), ("Umbara Ras", "Ras Umbara Port"), ("X", "Y"), (None, "Y"), ("!!", "a")], "q string, c string")
    assert [r.m for r in df.select(tx.port_match(F.col("q"), F.col("c")).alias("m")).collect()] == ["exact", "prefix", "token-subset", None, None, None]


def test_footers_and_stamp(spark):
    text = "1. Hire\nCP ID: 123\nCP Date: 1 May\nVessel: Amber\nPage 2 of 35 - AMBER 1\nPage 3 of 9\nWORKING COPY\nVessel speed: 12\nPage two of\nend  CP ID: 5 CP Date: 2 May Vessel: X Page 1 of 3 WORKING COPY go on"
    assert one(spark, text, sg.drop_footers) == "1. Hire\nVessel speed: 12\nPage two of\nend go on"
    assert one(spark, "Chain id: 77\nx", lambda c: sg.drop_footers(c, ("cp id", "chain id"))) == "x" and one(spark, None, sg.drop_footers) is None
    assert one(spark, "the ~~W~~ ORKING COPY owners WORKING COPY - shall", sg.drop_watermark) == "the owners shall"
    assert one(spark, "networking copyist", sg.drop_watermark) == "networking copyist"


@pytest.mark.parametrize(
    ("title", "body", "want"),
    [("46.", "BIMCO Piracy Clause\n(a) text", ("46. BIMCO Piracy Clause", "(a) text")), ("Clause 7", "War Clause for Time  Charter\nx", ("Clause 7 - War Clause for Time  Charter", "x")), ("46.", "(a) BIMCO is cited\nx", None), ("46.", "12.1 BIMCO is cited", None), ("46. Hire", "BIMCO Piracy Clause", None), ("46.", "BIMCO", None), (None, "BIMCO Piracy Clause", None), ("46.", None, None)],
)
def test_promoted_subtitles(spark, title, body, want):
    t, b = tx.promote_subtitle(F.col("t"), F.col("b"))
    r = spark.createDataFrame([(title, body)], "t string, b string").select(t.alias("t"), b.alias("b")).first()
    assert (r.t, r.b) == (want or (title, body))


def test_header_fields(spark):
    from tidewater.operators.grids import header_field, header_words

    want = {"PL N°": "item_id", "NR. PLIST": "item_id", "Item No.": "item_id", "Box Description": "description", "COMM.": "description", "Type of packing": "packing_type", "Length (mm)": "length_m", "L": "length_m", "W [mm]": "width_m", "Dimensions [m] H": "height_m", "Volume m3": "volume_m3", "N.W.": "net_weight_kg", "GROSS WEIGHT": "gross_weight_kg", "IMO (Y/N)": "imo_flag", "Remarks": None, "": None}
    got = {r.v: r.f for r in spark.createDataFrame([(k,) for k in want], "v string").select("v", header_field(header_words(F.col("v"))).alias("f")).collect()}
    assert got == want
