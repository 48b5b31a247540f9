"""Routes from pages to chunks by document category, misplaced clause headers, and tables that belong to sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.operators import segments as sg

# Routes.

#: Categories whose texts are cut at clauses with struck words kept, and those cut at clauses or kept whole; all others by their fonts (fixed values).
PRESPLIT = ("charter_party",)
RAW = ("fixture_recap", "addendum", "delivery_details", "vessel_specifications", "vessel_owners_details", "speed_consumption")
#: Words up to which a text without clauses stays one chunk; beyond, pages are batched up to as many.
WHOLE = 6000
#: What separates the pages of a text.
PAGE = "\f"


def route(category: Column) -> Column:
    """``presplit``, ``raw`` or ``font``; unknown and null categories go by fonts."""
    return F.when(category.isin(*PRESPLIT), "presplit").when(category.isin(*RAW), "raw").otherwise("font")


def marked_pages(text: Column) -> Column:
    """A text with a mark before each of its pages that is not blank, numbered as in the file."""
    pages = F.transform(F.split(text, PAGE), lambda p, i: F.when(F.trim(p) != "", F.concat(F.lit("--- PAGE "), (i + 1).cast("string"), F.lit(" ---\n"), p)))
    return F.array_join(F.array_compact(pages), "\n\n")


def page_batches(pages: list[str], limit: int = WHOLE) -> list[tuple[str | None, str]]:
    """(title, body): pages joined in order as long as they hold ``limit`` words together; a longer page is cut. A single batch has no title."""
    out: list[list] = []
    size = 0
    for no, page in enumerate(pages, 1):
        for _, part in sg.split_words(None, page, limit):
            n = len(part.split())
            if not n:
                continue
            if not out or size + n > limit:
                out.append([no, no, []])
                size = 0
            out[-1][1] = no
            out[-1][2].append(part)
            size += n
    if len(out) == 1:
        return [(None, "\n\n".join(out[0][2]))]
    return [(f"Pages {a}-{b}" if a < b else f"Page {a}", "\n\n".join(parts)) for a, b, parts in out]


def fixed_chunks(text: str, limit: int = sg.CHUNK_WORDS) -> list[tuple[str | None, str]]:
    """``Section n`` of ``limit`` words each: what is left where a text has no structure."""
    ws = text.split()
    return [(f"Section {i // limit + 1}", " ".join(ws[i : i + limit])) for i in range(0, len(ws), limit)]


def route_text(text: str, how: str) -> list[tuple[str | None, str]]:
    """(title, body) of a text by its route: clauses first, then whole or page batches; by fonts, without them, fixed chunks."""
    pages = [p.strip() for p in text.split(PAGE) if p.strip()]
    full = "\n\n".join(pages)
    if how != "font":
        lines = full.split("\n")
        full = "\n".join(sg.strip_number_rows(sg.strip_prefix_numbers(sg.strip_trailing_numbers(lines))))
    found = sg.split_clauses(full)
    return found or (page_batches(pages) if how != "font" else fixed_chunks(full))


def routed_chunks(df: DataFrame, key: str, text: str, category: str) -> DataFrame:
    """(key, route, position, title, body) of every text; null and blank texts give none. Map-only; pages are separated by form feeds.

    Footers and stamps go first. Texts of the ``font`` route come without fonts here
    and take its fallbacks; elements with fonts go through ``layout.heading_chunks``.
    """
    kind = df.schema[key].dataType.simpleString()
    pre = df.where(F.col(text).isNotNull()).select(key, route(F.col(category)).alias("route"), sg.drop_watermark(sg.drop_footers(F.col(text))).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, how, i, t, body) for k, how, x in b.itertuples(index=False, name=None) for i, (t, body) in enumerate(route_text(x, how))]
            yield pd.DataFrame(rows, columns=[key, "route", "position", "title", "body"])

    return pre.mapInPandas(run, f"`{key}` {kind}, route string, position int, title string, body string")


# Misplaced headers.

#: Titles of clauses that are found inside others: by their start, by words they hold, by their end (fixed values, lower case).
OPENS = ("rate of hire", "speed and consumption", "notices")
HOLDS = (
    "isps code", "mtsa", "maritime transportation security", "solid bulk cargoes", "dangerous goods", "war cancellation", "fueleu maritime", "eu ets", "reefer container", "charterers to provide", "owners to provide", "high risk area",
    "canadian clause paramount", "conwartime", "bill of lading identifier", "c-tpat", "customs-trade", "additional information", "owners responsibility", "tweendeck", "grain bulkhead", "stowaway", "(including",
)
ENDS = (" clause",)


def header_inside(line: str) -> tuple[int, str] | None:
    """(number, title) of a line that is a numbered header with a known title and no full stop in it; titles that end a line with their word may hold some."""
    m = re.fullmatch(r"(\d{1,9})[.)]\s*(\S.*)", line.strip())
    if not m:
        return None
    title = m.group(2).strip()
    low = title.lower()
    known = "." not in title and (low.startswith(OPENS) or any(w in low for w in HOLDS if w != "(including") or ("(including" in low and ")" in low.split("(including", 1)[1]))
    return (int(m.group(1)), title) if known or low.endswith(ENDS) else None


def split_misplaced(clauses: dict[int, tuple[str, list[str]]]) -> dict[int, tuple[str, list[str]]]:
    """Clauses {number: (title, lines)} with headers found inside other clauses moved out, with the lines after them.

    A header may take its number only where that clause is missing or empty; clauses
    are searched by number, and those that result are searched again.
    """
    out = {n: (t, list(lines)) for n, (t, lines) in clauses.items()}
    todo = sorted(out)
    while todo:
        n = todo.pop(0)
        title, lines = out[n]
        for i, line in enumerate(lines):
            head = header_inside(line)
            if head and not out.get(head[0], ("", []))[1]:
                out[n] = (title, lines[:i])
                out[head[0]] = (f"{head[0]}) {head[1]}", lines[i + 1 :])
                todo = sorted({*todo, n, head[0]})
                break
    return out


def misplaced_headers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, title, body) of the clauses of texts in which a header was misplaced; others give no row. Null texts give none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in b.itertuples(index=False, name=None):
                own: dict[int, tuple[str, list[str]]] = {}
                for title, body in sg.split_clauses(t):
                    m = re.match(r"(\d{1,3})\.", title or "")
                    if m:
                        own.setdefault(int(m.group(1)), (title, body.split("\n")))
                split = split_misplaced(own)
                if split != own:
                    rows += [(k, n, title, "\n".join(lines)) for n, (title, lines) in sorted(split.items())]
            yield pd.DataFrame(rows, columns=[key, "number", "title", "body"])

    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, number int, title string, body string")


# Tables of sections.

#: Phrases that make section and table more alike (fixed values).
PHRASES = ("speed", "consumption", "fuel", "knots", "lifting", "equipment", "crane")
#: Words of a section's heading and of a table that belong together (fixed values).
PAIRED = ((("speed and consumption", "performance", "specifications"), ("speed", "consumption", "knots")), (("lifting", "equipment", "crane"), ("lifting", "equipment", "crane", "capacity")))
#: Words of legal text, of technical tables, and of legal text about technical matters (fixed values).
LEGAL, TECHNICAL, ABOUT = ("clause", "charter party", "bimco", "owners", "charterers", "liability", "indemnify"), ("speed", "consumption", "fuel", "knots", "mt/day"), ("speed", "consumption", "performance", "fuel")
#: Weights of nearness, shared words, structure and contamination; scores of paired headings and numbered ones; least score (fixed values).
NEAR, SHARED, STRUCTURE, FOREIGN, PAIR_SCORE, NUMBER_SCORE, LEAST = 0.3, 0.4, 0.4, 0.6, 80.0, 30.0, 50.0
#: Lines within which a table may belong to a section with which it shares no word: beyond, nearness and structure stay below the least score.
WITHIN = 40


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def table_score(section: Column, start: Column, end: Column, table: Column, first: Column, last: Column) -> Column:
    """How well a table at lines ``first`` to ``last`` belongs to a section at ``start`` to ``end``."""
    s, t = F.lower(F.coalesce(section, F.lit(""))), F.lower(F.coalesce(table, F.lit("")))
    near = F.greatest(F.lit(0.0), 100.0 - F.least(F.abs(first - end), F.abs(last - start)))
    head = F.substring_index(s, "\n", 1)
    structure = F.when(head.rlike(r"^\d+\.?\s*"), NUMBER_SCORE).otherwise(0.0)
    for heading, words in reversed(PAIRED):
        structure = F.when(_any(head, heading) & _any(t, words), PAIR_SCORE).otherwise(structure)
    foreign = F.when(_any(s, LEGAL) & _any(t, TECHNICAL) & ~_any(s, ABOUT), 100.0).otherwise(0.0)
    return near * NEAR + tx.phrase_score(s, t, list(PHRASES)) * SHARED + structure * STRUCTURE - foreign * FOREIGN


def attach_tables(sections: DataFrame, tables: DataFrame, doc: str) -> DataFrame:
    """(doc, section_id, table_id, score): for each section (doc, section_id, text, start, end) the best table (doc, table_id, text, start, end) of its document above ``LEAST``; of equals the first by start.

    Pairs are those that share a word or lie within ``WITHIN`` lines, found by equi
    joins; no others can reach the score. Blank tables belong to none.
    """
    s = sections.select(doc, "section_id", F.col("text").alias("s_text"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    t = tables.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(doc, "table_id", F.col("text").alias("t_text"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    word = lambda c: F.explode(tx.relevance_words(F.col(c))).alias("_w")
    shared = s.select(doc, "section_id", word("s_text")).join(t.select(doc, "table_id", word("t_text")), [doc, "_w"]).select(doc, "section_id", "table_id")
    cell = lambda c: F.floor(F.col(c) / WITHIN)
    out = shared
    for a, b in (("s_end", "t_start"), ("s_start", "t_end")):
        left = s.select(doc, "section_id", F.explode(F.sequence(cell(a) - 1, cell(a) + 1)).alias("_c"))
        out = out.unionByName(left.join(t.select(doc, "table_id", cell(b).alias("_c")), [doc, "_c"]).select(doc, "section_id", "table_id"))
    j = out.distinct().join(s, [doc, "section_id"]).join(t, [doc, "table_id"])
    j = j.withColumn("score", table_score(*[F.col(c) for c in ("s_text", "s_start", "s_end", "t_text", "t_start", "t_end")])).where(F.col("score") > LEAST)
    best = F.max_by(F.struct("table_id", "score"), F.struct("score", (-F.col("t_start")).alias("a"), (-F.col("table_id")).alias("b")))
    return j.groupBy(doc, "section_id").agg(best.alias("r")).select(doc, "section_id", "r.table_id", "r.score")
