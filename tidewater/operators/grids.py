"""Spreadsheet grids as cell rows (sheet_id, r, c, value): headers, columns, items, merged cells.

A grid's rows are few and its vocabulary small; everything is a join or a window
per sheet. Cells are trimmed; null and blank cells are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.operators import cargo as cg

#: Fields of a packing list, in order of precedence, and the words of their headers, without punctuation (fixed values).
HEADERS: dict[str, tuple[str, ...]] = {
    "item_id": (
        "pl", "pl n", "pl n°", "pl no", "pln", "plno", "nr plist", "packing list no", "packing list number", "packing list id", "pl id", "item id", "item no", "item number", "item code",
        "part no", "part number", "position no", "position number", "case no", "case number",
    ),
    "description": ("description", "descriz", "descrizione", "commodity", "goods", "comm"),
    "packing_type": ("packing type", "package type", "pkg type", "type of pack", "type of packing", "type of package"),
    "length_m": ("length", "lunghezza"),
    "width_m": ("width", "larghezza"),
    "height_m": ("height", "altezza"),
    "volume_m3": ("volume", "cbm", "m3", "m 3"),
    "net_weight_kg": ("net weight", "n w", "nw", "peso netto"),
    "gross_weight_kg": ("gross weight", "g w", "gw", "peso lordo"),
    "imo_flag": ("imo", "hazmat", "imdg", "dangerous"),
}
#: Letters that name an axis, alone or behind ``dim...`` and a unit.
AXES = {"length_m": "l", "width_m": "w", "height_m": "h"}
AXIS_UNITS = ("m", "mm")
#: Words that mark a totals row (fixed values).
TOTALS = ("tot", "total", "totale", "totals", "totali", "subtotal", "sum")
#: Header rows are sought among so many first rows and need at least this score.
HEAD_ROWS, LEAST = 30, 4


def header_words(text: Column) -> Column:
    """A header cell as words between single blanks, in lower case; punctuation separates."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}°]+", " ")), F.lit(" "))


def header_field(words: Column) -> Column:
    """The field that a header's words (``header_words``) name, null if none: the first whose words stand in it, or whose axis letter does."""
    def any_of(phrases: list[str]) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | F.contains(words, F.lit(f" {p} "))
        return out

    out = F.lit(None).cast("string")
    for name, phrases in reversed(HEADERS.items()):
        hit = any_of(list(phrases))
        if axis := AXES.get(name):
            alone = [f" {axis} ", *[f" {axis} {u} " for u in AXIS_UNITS]]
            hit = hit | words.isin(*alone) | (F.contains(words, F.lit(" dim")) & any_of([axis, *[f"{u} {axis}" for u in AXIS_UNITS]]))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def find_headers(cells: DataFrame) -> DataFrame:
    """(sheet_id, header_row, score, fields map<field, column>, texts map<field, header text>); of equal scores the first row, of equal fields the first column.

    A row scores a point per field, three more for an id with two dimensions and
    one more for a gross weight. Sheets whose best row scores less than ``LEAST`` have none.
    """
    named = cells.where((F.col("r") < HEAD_ROWS) & F.col("value").rlike(r"\p{L}"))  # cells without letters name no field
    f = named.withColumn("_w", header_words(F.col("value"))).withColumn("field", header_field(F.col("_w"))).where("field is not null").drop("_w")
    f = f.groupBy("sheet_id", "r", "field").agg(F.min_by(F.struct("c", "value"), "c").alias("cell"))
    rows = f.groupBy("sheet_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("field", "cell.c"))).alias("fields"), F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("cell.value", F.lit(""))))).alias("texts"))
    has = lambda n: F.map_contains_key("fields", n).cast("int")
    dims = has("length_m") + has("width_m") + has("height_m")
    score = F.size("fields") + F.when((has("item_id") == 1) & (dims >= 2), 3).otherwise(0) + has("gross_weight_kg")
    best = rows.withColumn("score", score).groupBy("sheet_id").agg(F.max_by(F.struct("r", "score", "fields", "texts"), F.struct("score", -F.col("r"))).alias("b"))
    return best.select("sheet_id", F.col("b.r").alias("header_row"), "b.score", "b.fields", "b.texts").where(F.col("score") >= LEAST)


def is_totals(cells: Column) -> Column:
    """Whether one of a row's first three cells holds a totals word."""
    tokens = F.flatten(F.transform(F.slice(cells, 1, 3), lambda c: F.split(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s.,:;\-]+")))
    return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in TOTALS]))


def parse_items(cells: DataFrame) -> DataFrame:
    """Rows below the header: (sheet_id, r, item fields, skipped).

    ``skipped`` is null for items, else ``blank``, ``totals`` or ``no dimensions``.
    Dimensions come out in metres, weights in kilograms; a missing volume is the
    product of the dimensions, a missing gross weight the net one, a missing id
    ``ITEM-nnn`` by the row's rank.
    """
    h = find_headers(cells)
    rows = cells.groupBy("sheet_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", F.coalesce(F.trim("value"), F.lit(""))))).alias("row"), F.array_sort(F.collect_list(F.struct("c", "value"))).alias("_o"))
    j = rows.join(h, "sheet_id").where(F.col("r") > F.col("header_row"))
    cell = lambda n: F.nullif(F.try_element_at("row", F.try_element_at("fields", F.lit(n))), F.lit(""))
    head = lambda n: F.try_element_at("texts", F.lit(n))
    num = lambda n: cg.flexible_number(cell(n))
    dims = {n: cg.metres(num(n), head(n)) for n in ("length_m", "width_m", "height_m")}
    blank = ~F.exists(F.map_values("row"), lambda v: v != "")
    none = (dims["length_m"] <= 0) & (dims["width_m"] <= 0) & (dims["height_m"] <= 0)
    skipped = F.when(blank, "blank").when(is_totals(F.transform("_o", lambda x: x["value"])), "totals").when(none, "no dimensions")
    j = j.select("sheet_id", "r", cell("item_id").alias("_id"), cell("description").alias("description"), *[v.alias(k) for k, v in dims.items()], num("volume_m3").alias("_v"), cg.kilograms(num("net_weight_kg"), head("net_weight_kg")).alias("net_weight_kg"), cg.kilograms(num("gross_weight_kg"), head("gross_weight_kg")).alias("_g"), cg.flagged(cell("imo_flag")).alias("imo_flag"), skipped.alias("skipped"))
    rank = F.sum(F.col("skipped").isNull().cast("int")).over(W.partitionBy("sheet_id").orderBy("r"))  # a sheet's format bounds its rows to 2 ** 20
    product = F.col("length_m") * F.col("width_m") * F.col("height_m")
    return j.select(
        "sheet_id", "r", "skipped", F.coalesce("_id", F.format_string("ITEM-%03d", rank)).alias("item_id"), "description", "length_m", "width_m", "height_m",
        F.when(F.coalesce(F.col("_v"), F.lit(0.0)) > 0, F.col("_v")).otherwise(product).alias("volume_m3"), "net_weight_kg", F.when(F.col("_g") > 0, F.col("_g")).otherwise(F.col("net_weight_kg")).alias("gross_weight_kg"), "imo_flag",
    )


def fill_merged(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells of merged regions (sheet_id, r1, r2, c1, c2) take the value of the region's first cell.

    Regions are unfolded to their cells (their area is bounded by the sheet), so
    the match is an equi join.
    """
    area = regions.select("sheet_id", F.explode(F.sequence("r1", "r2")).alias("r"), F.col("r1").alias("_r"), F.col("c1").alias("_c"), "c1", "c2").select("sheet_id", "r", "_r", "_c", F.explode(F.sequence("c1", "c2")).alias("c"))
    anchor = cells.select("sheet_id", F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("value").alias("_v"))
    j = area.join(anchor, ["sheet_id", "_r", "_c"], "left").select("sheet_id", "r", "c", "_v", F.lit(True).alias("_in"))
    out = cells.join(j, ["sheet_id", "r", "c"], "full_outer")
    return out.select("sheet_id", "r", "c", F.when(F.col("_in"), F.col("_v")).otherwise(F.col("value")).alias("value"))


def two_row_headers(top: DataFrame, sub: DataFrame) -> DataFrame:
    """(sheet_id, c, header): ``Main (Sub)``, with the main header carried to the right over blanks."""
    w = W.partitionBy("sheet_id").orderBy("c").rowsBetween(W.unboundedPreceding, 0)
    main = top.withColumn("main", F.last(F.nullif(F.trim("value"), F.lit("")), True).over(w)).select("sheet_id", "c", "main")
    j = main.join(sub.select("sheet_id", "c", F.nullif(F.trim("value"), F.lit("")).alias("sub")), ["sheet_id", "c"], "left")
    both = F.when(F.col("sub").isNotNull() & F.col("main").isNotNull(), F.concat(F.col("main"), F.lit(" ("), F.col("sub"), F.lit(")")))
    return j.select("sheet_id", "c", F.coalesce(both, "main", "sub").alias("header"))


def label_lines(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet_id, r, line): each row as ``Header: value`` parts joined by bars, empty cells left out."""
    j = cells.where("value is not null and trim(value) <> ''").join(headers, ["sheet_id", "c"])
    g = j.groupBy("sheet_id", "r").agg(F.sort_array(F.collect_list(F.struct("c", F.concat("header", F.lit(": "), F.trim("value")).alias("t")))).alias("p"))
    return g.select("sheet_id", "r", F.array_join(F.transform("p", lambda x: x["t"]), " | ").alias("line"))


def sections(rows: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows of fixed row ranges with the name of their section."""
    name = F.lit(None).cast("string")
    for k, (a, b) in ranges.items():
        name = F.when(F.col("r").between(a, b), F.lit(k)).otherwise(name)
    return rows.withColumn("section", name).where("section is not null")


def widest_sheet(sheets: DataFrame) -> DataFrame:
    """(file, sheet_id): each file's sheet with the most rows; of equals the first."""
    g = sheets.groupBy("file", "sheet_id").agg(F.count_distinct("r").alias("n"))
    return g.groupBy("file").agg(F.max_by("sheet_id", F.struct("n", F.struct((-F.col("sheet_id")).alias("k")))).alias("sheet_id"))
