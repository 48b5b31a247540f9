"""File readers, grids, layout, costs and streams on small fixtures."""

import io
import zipfile

from pyspark.sql import functions as F

from tidewater.operators import costs as co
from tidewater.operators import grids as gr
from tidewater.operators import layout as la
from tidewater.sources import files as fs
from tidewater.sources import sinks
from tidewater.streaming import streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx() -> bytes:
    p = lambda t, ppr="", rpr="": f"<w:p><w:pPr>{ppr}</w:pPr><w:r><w:rPr>{rpr}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    num = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr>'
    body = p("Intro") + p("Holds", '<w:pStyle w:val="Heading1"/>') + p("first", num) + p("second", num, "<w:strike/>") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>" + p("Deep", '<w:pStyle w:val="Heading2"/>') + p("deep text") + p("Next", '<w:pStyle w:val="Heading1"/>') + p("last")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return buf.getvalue()


def xlsx() -> bytes:
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = [["Packing list"], ["PL N°", "Description", "Length (mm)", "Width (mm)", "Height (mm)", "Gross weight (t)", "IMO"], ["A1", "box", "1200", "800", "500", "1,5", "Y"], [], ["", "crate", "1000", "1000", "1000", "2", ""], ["Total", "", "", "", "", "3,5", ""], ["B", "flat", "0", "", "", "1", ""]]
    xml = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{xml}</sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>')
    return buf.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.docx").write_bytes(docx())
    (tmp_path / "y.xlsx").write_bytes(xlsx())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "~$x.docx").write_bytes(b"lock")
    (tmp_path / "t.txt").write_bytes("Größe – ok\nzwei".encode("cp1252"))
    (tmp_path / "r.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par caf\'e9}")
    (tmp_path / "c.csv").write_text("a;b\n1;2\n")
    f = fs.discover(spark, str(tmp_path))
    assert f.count() == 6
    d = fs.read_docx(f)
    assert [(r.kind, r.text) for r in d.orderBy("position").collect()] == [("paragraph", "Intro"), ("heading", "Holds"), ("paragraph", "1. first"), ("paragraph", "2. ~~second~~"), ("table", "a | b"), ("heading", "Deep"), ("paragraph", "deep text"), ("heading", "Next"), ("paragraph", "last")]
    paths = {r.text: list(r.headings) for r in fs.heading_paths(d).collect()}
    assert paths == {"1. first": ["Holds"], "2. ~~second~~": ["Holds"], "a | b": ["Holds"], "deep text": ["Holds", "Deep"], "last": ["Next"]}
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in fs.read_texts(f).collect()}
    assert texts == {"t.txt": "Größe – ok\nzwei", "r.rtf": "Hello\ncafé"}
    assert [list(r.cells) for r in fs.read_csv(f).orderBy("r").collect()] == [["a", "b"], ["1", "2"]]
    cells = fs.read_cells(f).select(F.col("path").alias("sheet_id"), "r", "c", "value")
    h = gr.find_headers(cells).first()
    assert h.header_row == 1 and h.score == 7 + 3 + 1
    items = {r.r: r for r in gr.parse_items(cells).collect()}
    assert items[2].item_id == "A1" and items[2].length_m == 1.2 and items[2].gross_weight_kg == 1500.0 and items[2].imo_flag
    assert items[4].item_id == "ITEM-002" and items[4].volume_m3 == 1.0 and items[5].skipped == "totals" and items[6].skipped == "no dimensions"
    merged = fs.read_merged(f).select(F.col("path").alias("sheet_id"), "r1", "r2", "c1", "c2")
    full = {(r.r, r.c): r.value for r in gr.fill_merged(cells, merged).collect()}
    assert full[0, 1] == full[0, 2] == "Packing list"
    assert {r.path.rsplit("/", 1)[1] for r in fs.unreadable(f, d, fs.read_cells(f), fs.read_texts(f), fs.read_csv(f)).collect()} == {"bad.docx"}


def test_landed_pages(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page-00{i}.jsonl").write_text("".join(f'{{"id": {i * 2 + k}}}\n' for k in range(2)))
    got, left = fs.landed_pages(spark, str(tmp_path), 2)
    assert sorted((r.page, r.record) for r in got.collect()) == [(0, '{"id": 0}'), (0, '{"id": 1}'), (1, '{"id": 2}'), (1, '{"id": 3}')]
    assert [(r.page, r.records) for r in left.collect()] == [(2, 2)]
    details = spark.createDataFrame([(0, "a"), (2, "b"), (3, "c")], "id long, d string")
    found = fs.joined_details(spark.range(5), details, "id", "id")
    assert sorted((r.id, r.d) for r in found.collect()) == [(0, "a"), (1, None), (2, "b")]


def test_sinks(spark, frame, tmp_path):
    d = frame([(1, [("t", "b"), (None, "c")]), (2, None)], "doc long, chunks array<struct<title: string, body: string>>")
    rows = sinks.with_positions(d)
    assert [(r.doc, r.position, r.body) for r in rows.orderBy("position").collect()] == [(1, 0, "b"), (1, 1, "c")]
    p = str(tmp_path / "t")
    sinks.replace_partitions(frame([(1, "a"), (2, "b")], "k int, v string"), p, "k")
    sinks.replace_partitions(frame([(2, "c")], "k int, v string"), p, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "c")]
    old, new = frame([(1, "x"), (2, "y")], "k int, v string"), frame([(2, "z"), (3, "w")], "k int, v string")
    assert sinks.publish(old, new, str(tmp_path / "u"), "k") == 2
    assert sinks.markdown(rows, "doc", "position").first().body == "## t\n\nb\n\n## Untitled\n\nc"


def test_costs(spark):
    j = spark.createDataFrame([(1, "USD", '{"categories": [{"name": "Port", "items": [{"name": "Tug", "costs": [{"stage": "PDA", "persona": "OPERATOR", "amount": 5}, {"stage": "PDA", "persona": "OPERATOR", "amount": 7}]}, {"costs": [{"stage": "FDA", "persona": "OPERATOR", "amount": 3}]}, {"name": "Nil", "costs": [{"stage": "X", "persona": "Y"}], "comments": [{"text": "hm"}]}]}]}'), (2, "EUR", None)], "statement_id long, currency string, j string")
    s = j.select("statement_id", "currency", F.from_json("j", co.STATEMENT)["categories"].alias("categories"))
    b = co.breakdown(s)
    assert {r.item: r.amount for r in b.collect()} == {"Tug": 7.0, "Unknown": 3.0, "Nil": 0.0}
    assert {r.item: r.content_score for r in co.meaningful(b).collect()} == {"Tug": 1, "Unknown": 1, "Nil": 10}
    assert [(r.statement_id, r.total, r.currency) for r in co.statement_totals(b).collect()] == [(1, 10.0, "USD")]
    assert co.notes(b).first().note == "- Port: 10.00"


def test_layout(frame):
    schema = "doc_id long, page int, text string, x double, y double, size double, is_bold boolean"
    rows = [(1, 0, "TITLE", 50.0, 10.0, 16.0, False), (1, 0, "a", 50.0, 20.0, 10.0, False), (1, 0, "b", 90.0, 22.0, 10.0, False), (1, 0, "c", 50.0, 24.5, 10.0, False), (1, 0, "Bold", 50.0, 40.0, 10.0, True), (1, 0, "d", 50.0, 50.0, 10.0, False)]
    e = frame(rows, schema)
    assert la.body_size(e).first().body_size == 10.0
    got = la.heading_chunks(e, "y").orderBy("chunk").collect()
    assert [(r.title, r.body) for r in got] == [("TITLE", "a\nb\nc"), ("Bold", "d")]
    assert [r.line for r in la.text_lines(e).orderBy("row").collect()] == ["TITLE", "a b", "c", "Bold", "d"]
    m = frame([(1, 0, str(i), 12.0, i * 10.0, 8.0, False) for i in range(1, 25)] + [(1, 0, "words", 300.0, i * 10.0, 10.0, False) for i in range(20)], schema)
    assert la.margin_numbers(m).first().n == 24 and la.margin_numbers(e).count() == 0
    runs = frame([(1, 0, "a ", False), (1, 1, "b", True), (1, 2, "c", True), (1, 3, " d", None)], "p long, o int, text string, struck boolean")
    assert la.mark_runs(runs, ["p"], "o").first().text == "a ~~bc~~ d"


def test_streams(spark, sf, tmp_path):
    e = streams.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = streams.drain(streams.usage_windows(e, "ts", "event_type", "value"), "w", "complete")
    want = streams.usage_windows(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    assert got.count() == want.count() and got.agg(F.sum("requests")).first() == want.agg(F.sum("requests")).first()
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.txt").write_text("x")
    seen = []
    for _ in range(2):
        streams.ingest(spark, str(land), str(tmp_path / "cp"), lambda df, _: seen.extend(r.path for r in df.select("path").collect()), "txt")
    assert len(seen) == 1
    assert [streams.backoff(n) for n in (0, 3, 9)] == [1.0, 8.0, 60.0]


def test_deletes_and_logs(spark, frame, tmp_path):
    d = frame([(1, "a"), (2, None), (3, "b")], "k int, v string")
    assert sorted(r.k for r in sinks.delete_where(d, "v = 'a'").collect()) == [2, 3] and sinks.cleared(d).count() == 0 and sinks.cleared(d).schema == d.schema
    from datetime import datetime

    rows = frame([(1, datetime(2024, 1, 1, 5)), (2, None)], "n int, ts timestamp_ntz")
    for _ in range(2):
        sinks.append_usage(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert sorted(r.json for r in sinks.as_json(d, "k").collect()) == ['{"k":1,"v":"a"}', '{"k":2}', '{"k":3,"v":"b"}']


def test_waits_do_not_depend_on_arrival(spark, tmp_path):
    """Requests of one trigger wait alike, however many batches and files bring them in whatever order."""
    from datetime import datetime, timedelta

    from tidewater.streaming import streams

    t = datetime(2024, 1, 1)
    rows = [("u", t + timedelta(seconds=s), 60) for s in (0, 1000, 2000, 9000)]
    got = []
    for name, order in (("one", rows), ("two", rows[::-1])):
        at = str(tmp_path / name)
        for i, r in enumerate(order):
            spark.createDataFrame([r], "user string, ts timestamp_ntz, n long").write.mode("append").parquet(at)
        s = spark.readStream.schema("user string, ts timestamp_ntz, n long").parquet(at)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1" if name == "two" else "4000")
        got.append(sorted((r.ts, r.wait_seconds) for r in streams.drain(streams.limit_rate(s, "user", "ts", "n", 100, 3600), name).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and [w for _, w in got[0]] == [0.0, 2600.0, 5200.0, 1800.0]
