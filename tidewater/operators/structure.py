"""Chapters, clause trees, identity fields, hold geometry, and lookups that pick one of several matches."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions import text as tx
from tidewater.operators import ordered as od


def text_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of every text; null texts give none."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def assign_parts(lines: DataFrame, key: str, patterns: list[tuple[str, str]], barred: tuple[str, str, int] | None = None) -> DataFrame:
    """Adds ``part`` and ``start``: the part whose heading pattern a line or an earlier one met; null before the first.

    Of several patterns the first in order wins. ``barred`` = (part, phrase, n)
    suppresses a part's heading if the phrase stands in a short line among the n
    lines before it.
    """
    s = F.trim("line")
    part = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        part = F.when(s.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(part)
    r = lines.withColumn("_part", part)
    if barred:
        name, phrase, n = barred
        block = F.floor(F.col("line_no") / od.WIDTH)
        edge = F.pmod(F.col("line_no"), F.lit(od.WIDTH)) >= od.WIDTH - n  # the next block's first lines look back at these
        r = r.withColumn("_blk", F.explode(F.when(edge, F.array(block, block + 1)).otherwise(F.array(block))))
        w = W.partitionBy(key, "_blk").orderBy("line_no").rowsBetween(-n, -1)
        near = F.coalesce(F.max((F.contains(F.lower("line"), F.lit(phrase)) & (F.char_length("line") < 100)).cast("int")).over(w), F.lit(0))
        r = r.withColumn("_near", near).where(F.col("_blk") == block)
        r = r.withColumn("_part", F.when((F.col("_part") == name) & (F.col("_near") == 1), F.lit(None)).otherwise(F.col("_part"))).drop("_near", "_blk")
    r = od.filled(r.withColumn("_here", F.when(F.col("_part").isNotNull(), F.struct(F.col("_part").alias("part"), F.col("line_no").alias("start")))), [key], ["line_no"], "_here", "_at")
    return r.select(*lines.columns, F.col("_at.part").alias("part"), F.col("_at.start").alias("start"))


def part_bodies(parts: DataFrame, key: str, again: str = "replace") -> DataFrame:
    """(key, part, body): a part's lines without its heading; of a repeated part the last run (``replace``) or all (``join``). Empty parts are left out."""
    p = parts.where("part is not null and line_no > start and trim(line) <> ''")
    if again == "replace":
        p = p.join(p.groupBy(key, "part").agg(F.max("start").alias("start")), [key, "part", "start"], "left_semi")
    g = p.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return g.select(key, "part", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("body"))


#: A clause tree: chapters of content, tables and sub-chapters, these of content, clauses and rider clauses.
_CLAUSES = "map<string, struct<title: string, content: array<string>>>"
TREE = f"map<string, struct<content: array<string>, tables: array<array<array<string>>>, sub_chapters: map<string, struct<content: array<string>, clauses: {_CLAUSES}, rider_clauses: {_CLAUSES}, rider_content: array<string>>>>>"


def flatten_tree(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, chapter, sub_chapter, kind, number, title, body, line_count): one row per content block, clause and rider clause.

    A chapter's tables count only where it has no content; cells are joined by
    bars, blank ones read ``N/A``. Empty bodies are left out.
    """
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n")
    none = F.lit(None).cast("string")
    ch = df.select(key, F.explode(tree).alias("chapter", "_c"))
    cell = lambda x: F.when(F.trim(F.coalesce(x, F.lit(""))) == "", F.lit("N/A")).otherwise(F.trim(x))
    tables = F.array_join(F.transform(F.flatten(F.coalesce("_c.tables", F.array().cast("array<array<array<string>>>"))), lambda r: F.array_join(F.transform(r, cell), " | ")), "\n")
    body = F.when(F.size(F.coalesce("_c.content", F.array().cast("array<string>"))) > 0, join(F.col("_c.content"))).otherwise(tables)
    out = ch.select(key, "chapter", none.alias("sub_chapter"), F.lit("chapter").alias("kind"), none.alias("number"), none.alias("title"), body.alias("body"))
    sub = ch.select(key, "chapter", F.explode("_c.sub_chapters").alias("sub_chapter", "_s"))
    for kind, field in (("clause", "clauses"), ("rider", "rider_clauses")):
        e = sub.select(key, "chapter", "sub_chapter", F.explode(f"_s.{field}").alias("number", "_e"))
        out = out.unionByName(e.select(key, "chapter", "sub_chapter", F.lit(kind).alias("kind"), "number", F.col("_e.title").alias("title"), join(F.col("_e.content")).alias("body")))
    for kind, field in (("rider text", "rider_content"), ("text", "content")):
        out = out.unionByName(sub.select(key, "chapter", "sub_chapter", F.lit(kind).alias("kind"), none.alias("number"), none.alias("title"), join(F.col(f"_s.{field}")).alias("body")))
    return out.where("trim(body) <> ''").withColumn("line_count", tx.line_count(F.col("body")))


def parse_enriched(answer: Column) -> Column:
    """array<struct<title, body>> of a model's answer: fenced or bare, an array or an object with ``chunks``; null if it is none."""
    body = F.trim(F.coalesce(F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), answer))
    kind = "array<struct<title: string, body: string>>"
    obj = F.from_json(body, f"chunks {kind}")["chunks"]
    arr = F.from_json(F.concat(F.lit('{"chunks": '), body, F.lit("}")), f"chunks {kind}")["chunks"]
    return F.when(F.startswith(body, F.lit("[")), arr).when(F.startswith(body, F.lit("{")), obj)


#: Forms of values, and the labels and form of each particular of a vessel (fixed values).
FORMS = {"digits": r"(\d{7})", "code": r"([A-Z0-9]{4,6})", "phrase": r"([^|\n]+)", "year": r"[^0-9\n]*(\d{4})", "figure": r"([\d.,]+)", "tonnes": r"([\d.,/]+\s*(?:mt|t)?)", "metres": r"([\d.,]+\s*m?)"}
PARTICULARS: dict[str, tuple[tuple[str, ...], str]] = {
    "imo_number": (("imo number", "imo no.", "imo no", "imo #", "imo"), "digits"),
    "call_sign": (("call sign",), "code"),
    "flag_state": (("flag state", "flag country"), "phrase"),
    "port_of_registry": (("port of registry", "port of register"), "phrase"),
    "year_built": (("year of build", "year of construction", "year of delivery", "year built", "date of build", "date of delivery", "delivered", "year"), "year"),
    "gross_tonnage": (("gross tonnage",), "figure"),
    "dwat": (("dwat",), "tonnes"),
    "loa": (("length over all",), "metres"),
}


def labelled(labels: tuple[str, ...], form: str) -> str:
    """A pattern of any of the labels, with or without a remark in brackets, a colon or dash, and the value."""
    names = "|".join(r"\s+".join(re.escape(w) for w in x.split()) for x in labels)
    return rf"(?i:{names})\s*(?:\([^)]*\)\s*)?[:-]?\s*{FORMS[form]}"


def particulars(chunks: DataFrame, key: str, order: str, title: str, body: str, sections: list[str] | None = None) -> DataFrame:
    """(key, field, value): each particular's first match by order, over chunks whose title names one of the sections (all if none are given)."""
    c = chunks
    if sections:
        named = F.lit(False)
        for s in sections:
            named = named | F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(s))
        c = c.where(named)
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.nullif(F.regexp_extract(F.coalesce(body, F.lit("")), labelled(*p), 1), F.lit("")).alias("v")) for k, p in PARTICULARS.items()])
    hits = c.select(key, order, F.explode(pairs).alias("p")).where("p.v is not null")
    clean = F.regexp_replace(F.regexp_replace(F.trim("p.v"), "[.,;]+$", ""), r"\s{2,}", " ")
    return hits.groupBy(key, F.col("p.field").alias("field")).agg(F.min_by(clean, order).alias("value"))


def fill_missing(records: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records whose null or blank fields take the found values (key, field, value); others stay."""
    wide = found.groupBy(key).pivot("field", fields).agg(F.first("value"))
    j = records.alias("r").join(wide.alias("f"), key, "left")
    rest = [c for c in records.columns if c not in fields and c != key]
    return j.select(key, *[F.col(f"r.{c}").alias(c) for c in rest], *[F.coalesce(F.nullif(F.trim(f"r.{c}"), F.lit("")), F.col(f"f.{c}")).alias(c) for c in fields])


def first_match_backfill(df: DataFrame, lookup: DataFrame, on: list[str], target: str, value: str, order: str) -> DataFrame:
    """``target`` where null takes the value of the lookup's first row (by order) with equal keys; null keys match nothing."""
    one = lookup.groupBy(*on).agg(F.min_by(value, order).alias("_v"))
    return df.join(one, on, "left").withColumn(target, F.coalesce(target, "_v")).select(*df.columns)


def best_match(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, score: Column, least: float, allowed: Column | None = None) -> DataFrame:
    """(left_id, right_id, score): the best right row of each left one within its key, above ``least``; of equals the smallest id.

    Sections and tables of one document meet on the document and on a shared word
    of ``relevance_words``. ``allowed``: which pairs of ids count; all by default.
    """
    word = lambda c: F.explode(tx.relevance_words(F.col(c)))
    lw = left.select(*on, left_id, word("section_text").alias("_w"))
    rw = right.select(*on, right_id, word("table_text").alias("_w"))
    pairs = lw.join(rw, [*on, "_w"]).where(F.lit(True) if allowed is None else allowed).select(*on, left_id, right_id).distinct()
    j = pairs.join(left, [*on, left_id]).join(right, [*on, right_id]).withColumn("score", score).where(F.col("score") > least)
    return j.groupBy(*on, left_id).agg(F.max_by(F.struct(right_id, "score"), F.struct("score", -F.col(right_id))).alias("r")).select(*on, left_id, f"r.{right_id}", "r.score")


def preferred(df: DataFrame, key: Column, good: Column, order: list[str]) -> DataFrame:
    """One row per key: rows with ``good`` first, then by order; an aggregate, no window."""
    cols = df.columns
    g = df.withColumn("_k", key).groupBy("_k").agg(F.min(F.struct((~good).cast("int").alias("_g"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(c) for c in cols])).alias("r"))
    return g.select("_k", *[F.col(f"r.{c}").alias(c) for c in cols])


def overlay(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(base with changed fields laid over, changes whose key the base lacks); null fields change nothing."""
    j = base.alias("b").join(changes.alias("c"), key, "left")
    keep = [F.col(f"b.{c}").alias(c) for c in base.columns if c != key and c not in fields]
    out = j.select(key, *keep, *[F.coalesce(f"c.{f}", f"b.{f}").alias(f) for f in fields])
    return out, changes.join(base.select(key), key, "left_anti")


def valid_history(messages: DataFrame) -> DataFrame:
    """Messages of user and assistant with a content that is not blank, trimmed."""
    ok = F.col("role").isin("user", "assistant") & F.col("content").isNotNull() & (F.trim("content") != "")
    return messages.where(ok).withColumn("content", F.trim("content"))


def file_class(name: Column, folder: Column) -> Column:
    """``vessel`` or ``agency`` by extension, else folder, else name; vessel if nothing tells."""
    n, d = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(folder, F.lit("")))
    return (
        F.when(n.rlike(r"\.(docx|pdf)$"), "vessel").when(n.rlike(r"\.xlsx?$"), "agency").when(F.contains(d, F.lit("vessel")), "vessel").when(d.rlike("agency|agencies"), "agency")
        .when(n.rlike("vessel|ship|mv_|mv-"), "vessel").when(n.rlike("agency|agent|supplier"), "agency").otherwise("vessel")
    )


def object_key(prefix: str, *parts: Column) -> Column:
    """A storage key: the prefix and the parts' slugs joined by slashes, the file's extension kept."""
    last = parts[-1]
    stem = tx.slug(F.regexp_replace(last, r"\.[^.]*$", ""))
    ext = F.lower(F.regexp_extract(last, r"(\.[A-Za-z0-9]+)$", 1))
    return F.concat_ws("/", F.lit(prefix), *[tx.slug(p) for p in parts[:-1]], F.concat(stem, ext))


def metadata(fields: dict[str, Column]) -> Column:
    """A map of fields as text without null and empty ones."""
    return tx.drop_empty(F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[v.cast("string") for v in fields.values()])))


def enriched_text(template: dict[str, Column], content: Column, words: Column) -> Column:
    """Context lines of the non-empty fields, the content, and its keywords."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in template.items()]
    tail = F.when(F.size(words) > 0, F.concat(F.lit("Keywords: "), F.array_join(words, ", ")))
    return F.concat_ws("\n", *lines, content, tail)


# Hold geometry.

HOLDS = "array<struct<id: int, length: double, breadth: double, height: double, lower_height: double, upper_height: double, has_tween: boolean>>"


def parse_holds(vessels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, length, breadth, height, has_tween, lower_height, upper_height) of each hold in a JSON text.

    Missing tween heights are derived: the lower level has what the upper leaves,
    45 % at least, and the other way round 55 %. Holds without positive measures
    and texts that are no list give no rows; a missing id is the hold's place.
    """
    e = vessels.select(key, F.posexplode(F.from_json(text, HOLDS)).alias("_i", "h")).where("h.length > 0 and h.breadth > 0 and h.height > 0")
    up, low, full = F.coalesce("h.upper_height", F.lit(0.0)), F.coalesce("h.lower_height", F.lit(0.0)), F.col("h.height")
    tween = F.coalesce("h.has_tween", up > 0)
    lower = F.when(~tween, full).when(low > 0, low).otherwise(F.greatest(full - up, full * 0.45))
    upper = F.when(~tween, F.lit(0.0)).when(up > 0, up).otherwise(F.greatest(full - lower, full * 0.55))
    return e.select(key, F.coalesce("h.id", F.col("_i") + 1).alias("id"), "h.length", "h.breadth", "h.height", tween.alias("has_tween"), lower.alias("lower_height"), upper.alias("upper_height"))


#: Measures named in a specification's prose, by their labels; a value may be ``abt`` (fixed values).
MEASURES = {"loa": ("length over all", "length overall"), "breadth": ("breadth moulded", "breadth over all", "breadth overall", "breadth"), "depth": ("depth moulded", "depth to main deck"), "draft": ("summer draught", "summer draft", "max draft", "max. draft"), "hold_height": ("hold height",)}
#: Words that tell of a tween deck, and labels of a hold's length, breadth and height in one value (fixed values).
TWEEN = ("tween deck", "t/d pontoon", "t/d dim", "t/d height", "above t/d", "below t/d")
HOLD_SIZE = ("hold dimensions", "hold dimension", "hold dims", "hold dim")
#: Shares of the length over all, of the breadth, and of the hold's length that several holds use (fixed values).
LONG, BROAD, DEEP, INNER, USED = 0.60, 0.13, 0.09, 0.85, 0.90
_ABOUT = r"[^:\n\d]*?[:\s]+(?:abt\.?\s*|about\s*)?"


def _after(labels: tuple[str, ...], value: str) -> str:
    return "(?i)(?:" + "|".join(re.escape(x) for x in labels) + ")" + _ABOUT + value


def hold_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, loa, breadth, depth, draft, holds_count, has_tween, length, width, height, estimated) read from a specification's prose.

    Where the hold's own measures are missing they are estimated from the length
    over all: 60 % long, 85 % of a breadth of 13 %, depth of 9 %; several holds
    share the length with 90 % of it used. Texts without a length give no row.
    """
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t]+", " ")
    number = lambda s: F.replace(F.nullif(F.rtrim(s, F.lit(".,")), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    one = {k: number(F.regexp_extract(t, _after(v, r"([\d.,]+)\s*m"), 1)).alias(k) for k, v in MEASURES.items()}
    size = F.split(F.lower(F.regexp_extract(t, _after(HOLD_SIZE, r"([\d.,]+(?: *x *[\d.,]+)*)"), 1)), " *x *")
    inner = [number(F.try_element_at(size, F.lit(i + 1))).alias(c) for i, c in enumerate(("_l", "_b", "_h"))]
    tween = F.exists(F.array(*[F.lit(x) for x in TWEEN]), lambda x: F.contains(F.lower(t), x)).alias("has_tween")
    s = df.select(key, *one.values(), F.regexp_extract(t, _after(("holds/hatches",), r"(\d+)"), 1).try_cast("int").alias("_n"), tween, *inner).where("loa is not null")
    n = F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))
    share = lambda x: F.round(F.col("loa") * x, 1)
    length = F.coalesce("_l", share(LONG))
    return s.select(
        key, "loa", F.coalesce("breadth", share(BROAD)).alias("breadth"), F.coalesce("depth", share(DEEP)).alias("depth"), "draft", n.alias("holds_count"), "has_tween",
        F.when(n > 1, F.round(length / n * USED, 1)).otherwise(length).alias("length"), F.coalesce("_b", F.round(F.coalesce("breadth", F.col("loa") * BROAD) * INNER, 1)).alias("width"),
        F.coalesce("_h", "hold_height", "depth", share(DEEP)).alias("height"), F.col("_l").isNull().alias("estimated"),
    )


def nearest_pair(pairs: Column, target: Column) -> Column:
    """Of an array of (lower, upper) the pair whose sum is nearest to the target; of equals the first."""
    return F.array_min(F.transform(pairs, lambda p, i: F.struct(F.abs(p["lower"] + p["upper"] - target).alias("d"), i.alias("i"), p.alias("p"))))["p"]


def log_events(kind: str, fields: dict[str, object]) -> str:
    """One structured log line."""
    return json.dumps({"kind": kind, **fields}, sort_keys=True, default=str)


def palette(position: Column, colours: list[str]) -> Column:
    """A colour by rank, going round."""
    return F.element_at(F.array(*[F.lit(c) for c in colours]), (F.pmod(position, F.lit(len(colours))) + 1).cast("int"))


def hold_defaults(vessels: DataFrame, holds: DataFrame, key: str) -> DataFrame:
    """(key, loa, breadth, depth, holds_count, has_tween): missing or zero dimensions from the greatest hold, 1.6 times its length, 1.05 its breadth, 1.1 its height."""
    g = holds.groupBy(key).agg(F.max("length").alias("_l"), F.max("breadth").alias("_b"), F.max("height").alias("_h"), F.count("*").cast("int").alias("holds_count"), F.max("has_tween").alias("has_tween"))
    j = vessels.join(g, key)
    own = lambda c, most, times: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.round(F.col(most) * times, 1)).alias(c)
    return j.select(key, own("loa", "_l", 1.6), own("breadth", "_b", 1.05), own("depth", "_h", 1.1), "holds_count", "has_tween")


def patch_items(items: DataFrame, patches: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Items with patched fields laid over, of ``allowed`` ones only; where a measure changed, ``volume_m3`` is their product again."""
    fields = [c for c in patches.columns if c in allowed]
    out = overlay(items, patches.select(key, *fields), key, fields)[0]
    sizes = [c for c in ("l", "w", "h") if c in fields]
    if not sizes:
        return out
    touched = patches.select(key, F.coalesce(*[F.col(c).isNotNull() for c in sizes[:1]]).alias("_t") if len(sizes) == 1 else F.greatest(*[F.col(c).isNotNull() for c in sizes]).alias("_t"))
    j = out.join(touched, key, "left")
    product = F.col("l") * F.col("w") * F.col("h")
    return j.withColumn("volume_m3", F.when(F.coalesce("_t", F.lit(False)), product).otherwise(F.col("volume_m3"))).select(*items.columns)


def unknown_keys(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are found but not known; nulls are none."""
    return found.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def page_rows(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """The rows of one page, from 1, in an order that must be total."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """(rows, pages): how many pages there are, one at least."""
    n = F.count("*")
    return df.agg(n.alias("rows"), F.greatest(F.lit(1), F.ceil(n / size)).cast("int").alias("pages"))


#: Activities of a call, the most telling first (fixed values).
ACTIVITIES = ("Loading", "Discharging")


def main_activity(activities: Column) -> Column:
    """The first listed activity that an array holds, else its first one; null if it is empty."""
    out = F.try_element_at(F.array_compact(activities), F.lit(1))
    for a in reversed(ACTIVITIES):
        out = F.when(F.array_contains(activities, a), F.lit(a)).otherwise(out)
    return out


def chapter_counts(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, counts map<chapter/sub-chapter, clauses>): how many clauses each sub-chapter of a tree holds, rider clauses too."""
    ch = df.select(key, F.explode(tree).alias("_n", "_c"))
    e = ch.select(key, "_n", F.explode("_c.sub_chapters").alias("_s", "_v"))
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    g = e.select(key, F.concat_ws("/", "_n", "_s").alias("_k"), (size("_v.clauses") + size("_v.rider_clauses")).alias("_n2"))
    return g.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_n2")))).alias("counts"))
