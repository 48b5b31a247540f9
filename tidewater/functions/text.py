"""String expressions on columns; built-in functions unless Unicode forms need Python.

Nulls give nulls unless stated. ``(?U)`` makes white space and letters Unicode-wide.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"(?U)\s+"


def words(text: Column) -> Column:
    """Blank-separated words; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def line_count(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n"))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, _SPACE, " "), "^ | $", "")


def content_hash(text: Column, length: int = 12) -> Column:
    """Start of the MD5 of the text without case and white-space differences."""
    return F.substring(F.md5(squeeze(F.lower(text))), 1, length)


def key_hash(text: Column) -> Column:
    return F.md5(F.lower(F.trim(text)))


def slug(text: Column, longest: int | None = None, numbered: bool = False) -> Column:
    """Lower-case letters and digits joined by underscores; ``numbered`` drops a leading clause number."""
    s = F.trim(F.coalesce(text, F.lit("")))
    if numbered:
        s = F.regexp_replace(s, r"^\d+[.\-—\s]+", "")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(s, 1, longest) if longest else s


def display_name(text: Column) -> Column:
    """A slug as a name: every letter run capitalised, also after digits and hyphens."""
    s = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" ")))
    parts = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def vector_id(client: Column, group: Column, section_no: Column, section: Column, title: Column, position: Column) -> tuple[Column, Column]:
    """(readable id, the same made free of collisions by a hash of its parts).

    The readable id repeats where titles only differ in what the slug drops.
    """
    name = F.concat_ws(
        "_", slug(F.coalesce(client, F.lit("unknown")), 30, True), slug(F.coalesce(group, F.lit("unknown")), 30, True), F.coalesce(section_no, F.lit(0)).cast("string"),
        slug(F.coalesce(section, F.lit("document")), 25, True), slug(F.coalesce(title, F.concat(F.lit("chunk_"), position.cast("string"))), 40, True), (position + 1).cast("string"),
    )
    parts = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in (client, group, section, title, position)])
    return name, F.concat(name, F.lit("_"), F.substring(F.sha2(parts, 256), 1, 12))


@F.pandas_udf(T.StringType())
def _nfkd_ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"))


#: Pieces of words that a split ligature leaves standing alone, those of them that also open words, and the beginnings of endings it leaves (fixed values).
LONE = ("ti", "ft", "tt", "ffi", "ffl", "fi", "fl")
OPENING = ("ti", "tt", "ffi", "ffl")
ENDINGS = ("tion", "tive", "ting", "tified", "tifying", "tifiable", "tification", "tities", "tity")


def join_fragments(text: str) -> str:
    """Words that a ligature split into blank-separated pieces, joined in one pass from left to right."""
    out: list[str] = []
    glued = False  # the piece before wants its right neighbour
    pieces = re.split(r"(\s+)", text)
    for i in range(0, len(pieces), 2):
        word, gap = pieces[i], pieces[i - 1] if i else ""
        after = pieces[i + 2] if i + 2 < len(pieces) else ""
        left = out[-1][-1:] if out else ""
        lone = word in LONE and gap == " " and (left.isalnum() or left == "_") and i + 2 < len(pieces) and pieces[i + 1] == " " and (after[:1].isalnum() or after[:1] == "_")
        ending = gap == " " and word.startswith(ENDINGS) and out and len(out[-1]) > 1 and out[-1][-2:].isascii() and out[-1][-2:].isalpha()
        out += [word] if glued or lone or ending else [gap, word]
        glued = lone or (word in OPENING and "a" <= after[:1] <= "z")
    return "".join(out)


@F.pandas_udf(T.StringType())
def _unfolded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else join_fragments(unicodedata.normalize("NFKC", t)))


def repair_ligatures(text: Column) -> Column:
    """Compatibility forms unfolded, words joined that a ligature split: ``no ti ce``, ``Dura tion``."""
    return _unfolded(text)


def ascii_id(text: Column, longest: int = 100) -> Column:
    """Letters, digits and underscores of the plain-letter form, cut to length."""
    t = F.regexp_replace(_nfkd_ascii(text), r"[^\w\s-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s_-]+", "_"), "^_+|_+$", "")
    return F.substring(t, 1, longest)


def significant_words(text: Column) -> Column:
    """Words of four and more ASCII letters, in lower case, without a leading number."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\d+[.)]\s*", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"\b([a-zA-Z]{4,})\b"), F.lit(1)), F.lower)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; 0 where both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def relevance_words(text: Column) -> Column:
    """Distinct words of three and more letters, digits and underscores, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b(\w{3,})\b"), F.lit(1)))


def phrase_score(a: Column, b: Column, phrases: list[str]) -> Column:
    """Overlap of two texts' words in per cent plus 20 for each phrase that both hold, 100 at most."""
    held = lambda c, p: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(p))
    bonus = sum((F.when(held(a, p) & held(b, p), 20.0).otherwise(0.0) for p in phrases), F.lit(0.0))
    return F.least(F.lit(100.0), jaccard(relevance_words(a), relevance_words(b)) * 100 + bonus)


def is_junk(body: Column) -> Column:
    """Extraction noise: fewer than three words, or more than 60 % of the lines of one or two characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), F.trim), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.char_length(x) <= 2))
    return (F.size(lines) == 0) | (word_count(body) < 3) | (short / F.size(lines) > 0.6)


def strip_wrappers(text: Column) -> Column:
    """A heading without strike and bold marks around it."""
    s = F.trim(text)
    return F.trim(F.regexp_replace(s, r"^(?:~~|\*+|\s)+|(?:~~|\*+|\s)+$", ""))


def clause_heading(line: Column) -> tuple[Column, Column]:
    """(number, title) of a top-level clause heading, nulls if the line is none.

    Four forms: ``N. title``, ``Clause N - title``, ``N Charter Party - title``
    and a bare ``Clause N``, whose title is empty.
    """
    s = strip_wrappers(line)
    forms = [(r"^(\d{1,3})\.\s+(.+)$", None), (r"(?i)^Clause\s+(\d{1,3})\s*[—–-]\s*(.+)$", None), (r"(?i)^(\d{1,3})\s+Charter Party\s*[—–-]\s*(.+)$", "Charter Party - "), (r"(?i)^Clause\s+(\d{1,3})\s*\.?\s*$", "")]
    number, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for pattern, lead in reversed(forms):
        hit = s.rlike(pattern)
        rest = F.lit("") if lead == "" else F.trim(F.regexp_extract(s, pattern, 2))
        number = F.when(hit, F.regexp_extract(s, pattern, 1).try_cast("int")).otherwise(number)
        title = F.when(hit, F.concat(F.lit(lead), rest) if lead else rest).otherwise(title)
    return number, title


def is_citation(line: Column) -> Column:
    """A sentence that opens with a clause it refers to, as ``Clause 47. The owners ...``."""
    s = F.trim(line)
    opens = s.rlike(r"(?i)^clause\s+\d+")
    alone = s.rlike(r"(?i)^clause\s+\d+\.?\s*$") | s.rlike(r"(?i)^clause\s+\d+\s*[—–-]\s*\S")
    return opens & ~alone & s.rlike(r"^(?i:clause\s+\d+\.?\s+the)\s+[a-z]")


def is_clause_header(line: Column) -> Column:
    """Clause, part, annex and appendix headings and ``N. Word`` lines; sentences citing a clause are none."""
    s = F.trim(line)
    header = s.rlike(r"^(?:(?:CLAUSE|Clause)\s+\d+|(?:PART|Part)\s+(?:[IVX]+|\d+)|(?:ANNEX|Annex|APPENDIX|Appendix)\s+\S+|\d{1,3}\s*[.\-—]\s+[A-Za-z])")
    return header & ~is_citation(line)


def is_section_label(line: Column) -> Column:
    """A short capitalised line that ends with a colon and holds no value."""
    s = F.trim(line)
    body = F.regexp_replace(s, ":$", "")
    return s.endswith(":") & (F.char_length(s) <= 80) & ~s.rlike(r"^\p{Ll}") & ~F.contains(body, F.lit(": "))


def bare_marker(title: Column) -> Column:
    """A title that is only a number, chapter or clause marker."""
    return F.coalesce(strip_wrappers(title).rlike(r"(?i)^(?:\d{1,3}\.?|CHAPTER\s+\d{1,3}\.?|Clause\s+\d{1,3}\.?)$"), F.lit(False))


#: Publishers and forms whose names open the subtitle of a standard rider clause, and the words such a subtitle may contain (fixed values).
RIDER_NAMES = ("BIMCO", "NYPE", "INTERTANKO", "BARECON", "SUPPLYTIME")
RIDER_PHRASES = ("clause for charter", "clause for time charter")
#: Least characters of a subtitle, and how far into the line a name counts.
SUBTITLE, NAMED_WITHIN = 12, 120


def names_rider(line: Column) -> Column:
    """Whether a line names a standard rider clause and is no item of a list."""
    head = F.substring(F.trim(line), 1, NAMED_WITHIN)
    words = F.split(F.upper(head), "[^A-Z]+")
    named = F.arrays_overlap(words, F.array(*[F.lit(x) for x in RIDER_NAMES]))
    flat = F.regexp_replace(F.lower(head), r"\s+", " ")
    for p in RIDER_PHRASES:
        named = named | F.contains(flat, F.lit(p))
    marker = F.regexp_replace(F.substring(head, 1, 12), " ", "")
    item = F.startswith(marker, F.lit("(")) | marker.rlike(r"^[A-Za-z]\)") | F.substring_index(head, " ", 1).rlike(r"^\d+\.\d+$")
    return (F.char_length(F.trim(line)) >= SUBTITLE) & named & ~item


def promote_subtitle(title: Column, body: Column) -> tuple[Column, Column]:
    """Moves a first body line that names a standard rider clause into a bare title."""
    lines = F.split(F.trim(body), "\n", 2)
    first, rest = F.trim(lines[0]), F.trim(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")))
    go = F.coalesce(bare_marker(title) & names_rider(first), F.lit(False))
    joint = F.when(F.substring(F.trim(title), -1, 1).isin(".", ":"), F.lit(" ")).otherwise(F.lit(" - "))
    return F.when(go, F.concat(F.trim(title), joint, first)).otherwise(title), F.when(go, rest).otherwise(body)


def strike_marks(text: Column) -> Column:
    """``[STRIKETHROUGH]x[/STRIKETHROUGH]`` and its variants as ``~~x~~``."""
    t = F.regexp_replace(text, r"(?is)\[\s*strike(?:through)?\s*\](.*?)\[\s*/\s*strike(?:through)?\s*\]", "~~$1~~")
    return F.regexp_replace(t, r"(?i)\[strikethrough:\s*([^\]]*)\]", "~~$1~~")


def prefixed_title(title: Column, label: Column) -> Column:
    """``label - title``, once; the label alone for null and blank titles."""
    t = F.coalesce(title, F.lit(""))
    return F.when(label.isNull() | (label == "") | F.startswith(t, label), title).when(F.trim(t) == "", label).otherwise(F.concat(label, F.lit(" - "), t))


def shorten(text: Column, longest: int = 60) -> Column:
    """At most ``longest`` characters, with an ellipsis where something was cut."""
    return F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("…"))).otherwise(text)


def first_sentence(text: Column, longest: int = 100) -> Column:
    return F.substring(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s").getItem(0), 1, longest)


def kept_parameters(url: Column, prefix: str) -> Column:
    """A URL with only those query parameters whose key starts with ``prefix``."""
    base = F.substring_index(url, "?", 1)
    query = F.when(F.contains(url, F.lit("?")), F.regexp_replace(url, r"^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: p.startswith(prefix))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def drop_empty(values: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & (v != ""))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches, null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")) for p in patterns])


#: Patterns of identity numbers (fixed values).
IMO = [r"(?i)\bIMO\s*(?:No\.?|Number)?\s*[:#]?\s*(\d{7})\b"]
CALL_SIGN = [r"(?i)\bcall\s*sign\s*[:#]?\s*([A-Z0-9]{4,7})\b"]


def rule_class(rules: list[tuple[str, list[str], list[str]]], text: Column, otherwise: Column) -> Column:
    """The first rule of (class, words that all must occur, words that must not) that the lower-cased text meets."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = otherwise
    for name, needed, barred in reversed(rules):
        cond = F.lit(True)
        for w in needed:
            cond = cond & F.contains(t, F.lit(w))
        for w in barred:
            cond = cond & ~F.contains(t, F.lit(w))
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


#: Clause classes by title, in order: class, all of these, none of these (fixed values).
TITLE_RULES: list[tuple[str, list[str], list[str]]] = [
    ("bunkers", ["bunker"], []), ("delivery", ["delivery"], ["redelivery"]), ("redelivery", ["redelivery"], []), ("hire", ["hire"], ["off"]), ("off_hire", ["off", "hire"], []),
    ("performance", ["performance"], []), ("performance", ["voyage"], []), ("drydocking", ["drydock"], []), ("drydocking", ["dry dock"], []), ("survey", ["survey"], []),
    ("speed_consumption", ["speed", "consumption"], []), ("insurance", ["insurance"], []), ("pollution", ["pollution"], []), ("liens", ["lien"], []), ("salvage", ["salvage"], []),
    ("general_average", ["general average"], []), ("exceptions", ["exception"], []), ("liberties", ["liberty"], []), ("liberties", ["liberties"], []), ("war_risks", ["war", "risk"], []),
    ("piracy", ["piracy"], []), ("sanctions", ["sanction"], []),
]
#: Clause classes by content (fixed values).
CONTENT_RULES: list[tuple[str, list[str], list[str]]] = [
    ("bunkers", ["bunker", "fuel"], []), ("off_hire", ["off hire"], []), ("off_hire", ["off-hire"], []), ("hire", ["hire", "payment"], []), ("hire", ["hire", "rate"], []),
    ("survey", ["survey", "delivery"], []), ("speed_consumption", ["speed", "consumption"], []), ("insurance", ["insurance", "vessel"], []),
    ("war_risks", ["bimco", "war"], []), ("piracy", ["bimco", "piracy"], []), ("sanctions", ["bimco", "sanction"], []), ("bimco_clause", ["bimco"], []),
]


def clause_type(title: Column, content: Column) -> Column:
    return rule_class(TITLE_RULES, title, rule_class(CONTENT_RULES, content, F.lit("general")))


def keywords(text: Column, terms: list[str], patterns: list[str]) -> Column:
    """Sorted distinct keywords: the listed terms that occur and all matches of the patterns, in lower case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    listed = F.filter(F.array(*[F.lit(x) for x in terms]), lambda k: F.contains(t, k))
    out = listed
    for p in patterns:
        out = F.array_union(out, F.regexp_extract_all(t, F.lit(p), F.lit(1)))
    return F.array_sort(F.array_distinct(out))


def port_text(text: Column) -> Column:
    """Letters, digits and single blanks, in lower case; empty for null."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9\s]", " "), r"\s+", " ")))


def port_match(query: Column, candidate: Column) -> Column:
    """``exact``, ``prefix`` or ``token-subset``; null if the port does not match."""
    q, c = port_text(query), port_text(candidate)
    subset = F.size(F.array_except(F.split(q, " "), F.split(c, " "))) == 0
    return F.when((q == "") | (c == ""), F.lit(None).cast("string")).when(q == c, "exact").when(F.startswith(c, q), "prefix").when(subset, "token-subset")


def query_parameters(text: Column) -> Column:
    """struct(port, vessel, date) named in a free-text question, nulls for what it does not name."""
    q = F.lower(F.trim(text))
    port = F.initcap(first_match(q, [r"port\s+(\w+)", r"in\s+(\w+)\s+port", r"(\w+)\s+port"]))
    vessel = F.when(~F.contains(q, F.lit("vessel")), F.initcap(first_match(q, [r"ship\s+(\w+)", r"(\w+)\s+ship"])))
    date = first_match(q, [r"(\d{4}-\d{2}-\d{2})", r"(\d{2}/\d{2}/\d{4})", r"(\d{2}-\d{2}-\d{4})"])
    return F.struct(port.alias("port"), vessel.alias("vessel"), date.alias("date"))


def is_reference(text: Column) -> Column:
    """Reference numbers such as ``AB-123456`` or ``ABC-1234567-2``."""
    return F.coalesce(F.trim(text).rlike(r"(?i)^[A-Z]{2,3}-\d{6,7}(-\d+)?$"), F.lit(False))


def normal_reference(text: Column) -> Column:
    """A reference in upper case with plain hyphens."""
    return F.upper(F.trim(F.translate(text, "‐‑‒–—", "-----")))


def year_within(text: Column, first: int, last: int) -> Column:
    """Whether a date text lies in the years; texts that are no dates pass."""
    y = F.year(F.try_to_timestamp(text))
    return F.coalesce(y.between(first, last), F.lit(True))


def not_about(word: str, *columns: Column) -> Column:
    """None of the texts contains the word, without case; nulls do not."""
    out = F.lit(True)
    for c in columns:
        out = out & ~F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word))
    return out
