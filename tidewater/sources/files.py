"""File sources: discovery, DOCX, XLSX, text, RTF, CSV and JSON trees.

Files are read by ``binaryFile``, so a folder of any size is spread over tasks;
office files are unpacked with the standard library inside the batches. A file
that cannot be read gives no rows, and one row in ``unreadable``.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Extensions that have a reader.
READERS = ("docx", "xlsx", "txt", "rtf", "csv", "json", "pdf", "xls")
#: Encodings tried in order.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = READERS) -> DataFrame:
    """(path, name, extension, length, modified, digest, content) of the files below a folder; lock and dot files are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    g = f.select("path", name.alias("name"), ext.alias("extension"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"), "content")
    return g.where(~F.col("name").startswith("~$") & ~F.col("name").startswith(".") & F.col("extension").isin(*extensions))


def decode(data: bytes) -> str:
    """Text in the first encoding that fits."""
    for e in ENCODINGS:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def rtf_text(data: bytes) -> str:
    """Plain text of an RTF file: groups without text and control words removed."""
    s = data.decode("latin-1")
    s = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", s)
    s = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m.group(1)) % 65536), s)
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m.group(1), 16)]).decode("cp1252", "replace"), s)
    s = re.sub(r"\\(?:par|line)\b ?", "\n", s)
    s = re.sub(r"\\tab\b ?", "\t", s)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", s).strip()


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_rows(data: bytes) -> list[tuple[int, str, int | None, str]]:
    """(position, kind, heading level, text) of paragraphs and tables in document order.

    Runs struck through are wrapped in ``~~``; list paragraphs carry their number
    (a counter per list and level); a table is one row, cells joined by bars.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    counters: Counter = Counter()

    def runs(p: ET.Element) -> str:
        parts: list[tuple[bool, str]] = []
        for r in p.iter(f"{_WORD}r"):
            flag = r.find(f"{_WORD}rPr/{_WORD}strike")
            struck = flag is not None and flag.get(f"{_WORD}val", "true") not in ("0", "false")
            t = "".join((e.text or "") if e.tag == f"{_WORD}t" else "\t" if e.tag == f"{_WORD}tab" else "\n" if e.tag == f"{_WORD}br" else "" for e in r)
            if t and parts and parts[-1][0] == struck:
                parts[-1] = (struck, parts[-1][1] + t)
            elif t:
                parts.append((struck, t))
        return "".join(f"~~{t}~~" if s and t.strip() else t for s, t in parts)

    def number(p: ET.Element) -> str:
        n = p.find(f"{_WORD}pPr/{_WORD}numPr")
        if n is None:
            return ""
        get = lambda k: (e.get(f"{_WORD}val") if (e := n.find(f"{_WORD}{k}")) is not None else "0")
        key = (get("numId"), get("ilvl"))
        counters[key] += 1
        return f"{counters[key]}. "

    out: list[tuple[int, str, int | None, str]] = []
    for e in body if body is not None else ():
        if e.tag == f"{_WORD}p":
            text = runs(e).strip()
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            m = re.match(r"(?i)heading\s*(\d)", style.get(f"{_WORD}val", "")) if style is not None else None
            if text:
                out.append((len(out), "heading" if m else "paragraph", int(m.group(1)) if m else None, number(e) + text))
        elif e.tag == f"{_WORD}tbl":
            lines = []
            for row in e.iter(f"{_WORD}tr"):
                cells = [" ".join(runs(p).strip() for p in c.iter(f"{_WORD}p")).strip() for c in row.iter(f"{_WORD}tc")]
                if any(cells):
                    lines.append(" | ".join(cells))
            if lines:
                out.append((len(out), "table", None, "\n".join(lines)))
    return out


def xlsx_cells(data: bytes) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, int, int, int, int]]]:
    """(cells (sheet, row, column, value), merged regions (sheet, r1, r2, c1, c2)), counted from 0."""
    def place(ref: str) -> tuple[int, int]:
        m = re.match(r"([A-Z]+)(\d+)", ref)
        col = 0
        for c in m.group(1):
            col = col * 26 + ord(c) - 64
        return int(m.group(2)) - 1, col - 1

    cells, merged = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            path = links[s.get(f"{_REL}id")].lstrip("/")
            root = ET.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            for c in root.iter(f"{_SHEET}c"):
                v = c.find(f"{_SHEET}v")
                kind = c.get("t")
                value = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if kind == "inlineStr" else v.text if v is not None else None
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                if value is not None:
                    cells.append((s.get("name"), *place(c.get("r")), value))
            for m in root.iter(f"{_SHEET}mergeCell"):
                a, b = m.get("ref").split(":") if ":" in m.get("ref") else (m.get("ref"), m.get("ref"))
                (r1, c1), (r2, c2) = place(a), place(b)
                merged.append((s.get("name"), r1, r2, c1, c2))
    return cells, merged


def _unpack(files: DataFrame, extensions: tuple[str, ...], reader, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in b.itertuples(index=False, name=None):
                try:
                    rows += [(path, *r) for r in reader(data)]
                except (KeyError, ValueError, zipfile.BadZipFile, ET.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("extension").isin(*extensions)).select("path", "content").mapInPandas(run, schema)


def read_docx(files: DataFrame) -> DataFrame:
    return _unpack(files, ("docx",), docx_rows, "path string, position int, kind string, level int, text string")


def read_cells(files: DataFrame) -> DataFrame:
    return _unpack(files, ("xlsx",), lambda d: xlsx_cells(d)[0], "path string, sheet string, r int, c int, value string")


def read_merged(files: DataFrame) -> DataFrame:
    return _unpack(files, ("xlsx",), lambda d: xlsx_cells(d)[1], "path string, sheet string, r1 int, r2 int, c1 int, c2 int")


def read_texts(files: DataFrame) -> DataFrame:
    """(path, text, words, lines) of plain and rich text files."""
    plain = _unpack(files, ("txt",), lambda d: [(decode(d),)], "path string, text string")
    rich = _unpack(files, ("rtf",), lambda d: [(rtf_text(d),)], "path string, text string")
    t = plain.unionByName(rich)
    return t.select("path", "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"), F.size(F.split("text", "\n")).alias("lines"))


def _csv_rows(data: bytes) -> list[tuple[int, list[str]]]:
    text = decode(data)
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    return list(enumerate(csv.reader(io.StringIO(text), dialect)))


def read_csv(files: DataFrame) -> DataFrame:
    """(path, r, cells) with the delimiter of each file found from its start."""
    return _unpack(files, ("csv",), _csv_rows, "path string, r int, cells array<string>")


def unreadable(files: DataFrame, *read: DataFrame) -> DataFrame:
    """Files of which no reader gave a row."""
    seen = read[0].select("path")
    for r in read[1:]:
        seen = seen.unionByName(r.select("path"))
    return files.select("path", "extension").join(seen.distinct(), "path", "left_anti")


def read_json_tree(spark: SparkSession, folder: str, schema: str, pattern: str = "*_data.json") -> DataFrame:
    """JSON documents below a folder, by file name pattern and an explicit schema."""
    return spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").json(folder)


def heading_paths(rows: DataFrame) -> DataFrame:
    """(path, position, headings, text): each paragraph with the headings above it; text before any heading and empty headings are left out."""
    w = W.partitionBy("path").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    r = rows
    for k in range(1, 7):
        at = F.last(F.when(F.col("level") == k, F.struct("position", "text")), True).over(w)
        r = r.withColumn(f"_h{k}", at)
    for k in range(2, 7):
        above = F.greatest(*[F.coalesce(f"_h{j}.position", F.lit(-1)) for j in range(1, k)], F.lit(-1))
        r = r.withColumn(f"_h{k}", F.when(F.col(f"_h{k}.position") > above, F.col(f"_h{k}")))
    path = F.array_compact(F.array(*[F.col(f"_h{k}.text") for k in range(1, 7)]))
    return r.where("kind <> 'heading'").select("path", "position", path.alias("headings"), "text").where(F.size("headings") > 0)


def landed_pages(spark: SparkSession, folder: str, pages: int = 20) -> tuple[DataFrame, DataFrame]:
    """Pages of a search API landed as JSON lines ``page-000.jsonl``, ...: (records (page, record) of the first ``pages`` pages, pages (page, records) beyond them).

    The page is the number in the file's name; blank lines are no records. Files
    are listed and read by the engine, from any file system.
    """
    f = spark.read.option("pathGlobFilter", "page-*.jsonl").text(folder).select(F.col("value").alias("record"), F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.jsonl$", 1).try_cast("int").alias("page"))
    rows = f.where("trim(record) <> ''").select("page", "record")
    return rows.where(F.col("page") < pages), rows.where(F.col("page") >= pages).groupBy("page").agg(F.count("*").alias("records"))


def joined_details(results: DataFrame, details: DataFrame, key: str, order: str, most: int = 3) -> DataFrame:
    """The first ``most`` search results by order, each with its details; a result without details keeps nulls."""
    return results.orderBy(order, key).limit(most).join(details, key, "left")
