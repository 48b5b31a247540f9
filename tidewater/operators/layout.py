"""Text elements with positions (doc_id, page, text, x, y, size, is_bold) to columns, rows, headers and margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions import text as tx
from tidewater.operators import ordered as od
from tidewater.operators.segments import gap_statistics, inversions, longest_run

BIN = 20.0
#: A font is a heading's from this multiple of the body's size; bold ones up to so many characters.
LARGER, BOLD_CHARS = 1.12, 120
SNAP = 3.0


def global_axis(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``gy``: y on one axis over all pages; pages (doc_id, page, height) advance by twice their height and a margin."""
    w = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    off = pages.select("doc_id", "page", F.coalesce(F.sum(F.col("height") * 2 + 200).over(w), F.lit(0.0)).alias("_off"))
    return elements.join(off, ["doc_id", "page"]).withColumn("gy", F.col("y") + F.col("_off")).drop("_off")


def body_size(elements: DataFrame) -> DataFrame:
    """(doc_id, body_size): the commonest size, rounded to halves; of equals the smaller."""
    g = elements.groupBy("doc_id", (F.round(F.col("size") * 2) / 2).alias("s")).agg(F.count("*").alias("n"))
    return g.groupBy("doc_id").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body_size"))


def heading_chunks(elements: DataFrame, y: str = "gy") -> DataFrame:
    """(doc_id, chunk, title, lines, body): elements grouped under headings by size, weight or clause form; what precedes the first is chunk 0.

    Bodies keep reading order. Elements of one document are joined in chunks, each
    bounded by the next heading.
    """
    e = elements.join(body_size(elements), "doc_id")
    s = F.trim("text")
    head = (s != "") & ((F.col("size") >= F.col("body_size") * LARGER) | (F.col("is_bold") & (F.char_length(s) < BOLD_CHARS)) | tx.is_clause_header(s))
    e = od.running_sum(e.withColumn("_h", head).withColumn("_n", head.cast("int")), ["doc_id"], [y, "x", "text"], "_n", "chunk").withColumn("_o", F.struct(y, "x", "text"))
    g = e.groupBy("doc_id", "chunk").agg(F.min_by(F.when(F.col("_h"), s), "_o").alias("title"), F.count("*").alias("lines"), F.sort_array(F.collect_list(F.when(~F.col("_h") & (s != ""), F.struct("_o", s.alias("t"))))).alias("_b"))
    return g.select("doc_id", "chunk", "title", "lines", F.array_join(F.transform("_b", lambda x: x["t"]), "\n").alias("body"))


def column_split(elements: DataFrame, spread: float = 0.02, least: int = 3) -> DataFrame:
    """(doc_id, page, split_x): the middle of the widest band between 15 and 80 % of a page's width that hardly any element starts in.

    A band is at least ``least`` bins of ``BIN`` points with at most ``spread`` of
    the page's elements each. Pages without one have no row.
    """
    p = elements.groupBy("doc_id", "page").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    bins = p.where("hi > lo").select("*", F.explode(F.sequence(F.ceil((F.col("lo") + 0.15 * (F.col("hi") - F.col("lo"))) / BIN), F.floor((F.col("lo") + 0.80 * (F.col("hi") - F.col("lo"))) / BIN))).alias("bin"))
    seen = elements.groupBy("doc_id", "page", F.floor(F.col("x") / BIN).alias("bin")).agg(F.count("*").alias("k"))
    sparse = bins.join(seen, ["doc_id", "page", "bin"], "left").withColumn("flag", F.coalesce("k", F.lit(0)) <= F.col("n") * spread)
    runs = longest_run(sparse, ["doc_id", "page"], "bin", "flag").where(F.col("length") >= least)
    return runs.select("doc_id", "page", ((F.col("start") + F.col("length") / 2) * BIN).alias("split_x"))


def margin_numbers(elements: DataFrame, side: str = "left") -> DataFrame:
    """(doc_id, x_bin, n): the bin of 15 points that holds running line numbers at a page's outer quarter, if there is one.

    At least ten bare numbers over a range of 15 and more, half of the range
    present, at most a fifth of them falling in reading order.
    """
    num = elements.where(F.trim("text").rlike(r"^\d{1,3}$")).withColumn("value", F.trim("text").try_cast("int")).withColumn("x_bin", F.floor(F.col("x") / 15))
    ext = elements.groupBy("doc_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    counts = num.groupBy("doc_id", "x_bin").agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id").agg(F.max_by("x_bin", F.struct("n", -F.col("x_bin"))).alias("x_bin"), F.max("n").alias("n")).where("n >= 10").join(ext, "doc_id")
    at = (F.col("x_bin") * 15 - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    best = best.where(F.coalesce(at <= 0.25 if side == "left" else at >= 0.75, F.lit(True))).select("doc_id", "x_bin", "n")
    own = num.join(best.select("doc_id", "x_bin"), ["doc_id", "x_bin"])
    stats = gap_statistics(own, ["doc_id"], "value").where("span >= 15 and density >= 0.5").select("doc_id")
    order = inversions(own, ["doc_id"], "y", "value").where("inverted <= 0.2").select("doc_id")
    return best.join(stats, "doc_id", "left_semi").join(order, "doc_id", "left_semi")


def snap_rows(elements: DataFrame) -> DataFrame:
    """Adds ``row``: elements whose y lies within ``SNAP`` of the first of their row, per page; equal elements stay as many as they are.

    The anchor is the row's start, so a fold over the page's sorted distinct ys
    decides. Anchors lie more than ``SNAP`` apart, so a page has at most its
    height over ``SNAP`` of them: they travel as one array per page, in which each
    element looks up its row.
    """
    pages = elements.groupBy("doc_id", "page").agg(F.sort_array(F.collect_set("y")).alias("_ys"))
    start = F.struct(F.lit(-1e18).alias("at"), F.array().cast("array<double>").alias("rows"))
    fold = F.aggregate("_ys", start, lambda s, y: F.when(F.abs(y - s["at"]) > SNAP, F.struct(y.alias("at"), F.concat(s["rows"], F.array(y)).alias("rows"))).otherwise(s))
    j = elements.join(pages.select("doc_id", "page", fold["rows"].alias("_rows")), ["doc_id", "page"])
    row = F.size(F.filter("_rows", lambda a: a <= F.col("y"))) - 1
    return j.select(*elements.columns, row.alias("row"))


def text_lines(elements: DataFrame) -> DataFrame:
    """(doc_id, page, row, line): elements of a row joined from left to right."""
    r = snap_rows(elements)
    g = r.groupBy("doc_id", "page", "row").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("_t"))
    return g.select("doc_id", "page", "row", F.array_join(F.transform("_t", lambda t: t["text"]), " ").alias("line"))


def struck_glyphs(glyphs: DataFrame, bands: DataFrame, least: float = 0.52) -> DataFrame:
    """Glyphs (doc_id, page, glyph_id, x0, x1, y0, y1) whose width a strike band (x0, x1, y0, y1) covers by ``least`` and more in their middle half.

    Glyphs and bands meet per page and cell of the height, not all with all.
    """
    cell = 40.0
    mid = (F.col("y0") + F.col("y1")) / 2
    g = glyphs.withColumn("_cell", F.floor(mid / cell))
    b = bands.select("doc_id", "page", *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0", "y1")], F.explode(F.sequence(F.floor(F.col("y0") / cell) - 1, F.floor(F.col("y1") / cell) + 1)).alias("_cell"))
    j = g.join(b, ["doc_id", "page", "_cell"])
    at = (F.col("b_y0") + F.col("b_y1")) / 2
    quarter = (F.col("y1") - F.col("y0")) / 4
    over = (F.least("x1", "b_x1") - F.greatest("x0", "b_x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))
    return j.where((over >= least) & at.between(F.col("y0") + quarter, F.col("y1") - quarter)).select("doc_id", "page", "glyph_id").distinct()


def scanned(pages: DataFrame, first: int = 8, share: float = 0.85) -> DataFrame:
    """(doc_id, scanned): whether at least ``share`` of the first pages (doc_id, page, images, words) are images with hardly any words."""
    p = pages.where(F.col("page") < first)
    return p.groupBy("doc_id").agg((F.avg(((F.col("images") > 0) & (F.col("words") < 5)).cast("double")) >= share).alias("scanned"))


def mark_runs(runs: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, text): text runs joined in order, neighbouring struck ones inside one pair of ``~~``."""
    w = W.partitionBy(*group).orderBy(order)
    r = runs.withColumn("_s", F.coalesce("struck", F.lit(False))).withColumn("_new", (F.col("_s") != F.coalesce(F.lag("_s").over(w), ~F.col("_s"))).cast("int")).withColumn("_i", F.sum("_new").over(w))
    g = r.groupBy(*group, "_i", "_s").agg(F.min(order).alias("_o"), F.sort_array(F.collect_list(F.struct(order, "text"))).alias("_t"))
    part = F.array_join(F.transform("_t", lambda t: t["text"]), "")
    marked = F.when(F.col("_s") & (F.trim(part) != ""), F.concat(F.lit("~~"), part, F.lit("~~"))).otherwise(part)
    return g.select(*group, "_o", marked.alias("_m")).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_o", "_m"))).alias("_p")).select(*group, F.array_join(F.transform("_p", lambda x: x["_m"]), "").alias("text"))
