"""Classes of clauses, specifications, sections and files by rule tables, and names of documents.

Tables are data: an ordered list of classes with the words that name them. The
engines are column expressions over a table, so all of them stay in the scan.
Null texts are empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Terms = dict[str, tuple[str, ...]]

#: Words that name a clause class, in order of precedence (fixed values; words that contain another one of their class are left out).
CLAUSE_TERMS: Terms = {
    "redelivery": ("redeliver",), "off_hire": ("off-hire", "off hire", "oﬀ-hire", "breakdown", "deficiency"), "delivery": ("deliver", "on-hire"), "bunkers": ("bunker", "fuel"), "hire": ("hire",),
    "performance": ("performance", "voyages", "navigation", "speed"), "drydocking": ("drydock", "dry dock", "docking"), "laydays": ("laydays", "laytime", "cancelling", "notice time"), "cargo_claims": ("cargo damage", "cargo liability", "claims"),
    "liens": ("lien", "security"), "requisition": ("requisition",), "total_loss": ("total loss", "vessel loss"), "salvage": ("salvage", "general average"), "pollution": ("pollution", "environmental", "marpol"), "taxes": ("taxes", "duties", "customs"),
    "liberties": ("liberties",), "notices": ("notices", "notification", "notice requirements"), "commissions": ("commissions", "brokerage", "commission payment"), "exceptions": ("exceptions", "excepted perils", "force majeure"),
    "cargo_handling": ("cargo handling", "cargo gear", "loading", "discharging"), "supercargo": ("supercargo", "cargo superintendent", "cargo supervision"), "stowaways": ("stowaway", "illegal passengers"), "smuggling": ("smuggling", "contraband", "illegal cargo"),
    "ice": ("ice",), "insurance": ("insurance", "war risks"), "stevedore_damage": ("stevedore", "damage"), "bills_of_lading": ("bills of lading", "bill of lading", "cargo documents"), "law_arbitration": ("law", "arbitration", "disputes"),
    "war_risks": ("war", "piracy", "conflict"), "protective": ("protective", "protection", "liability", "indemnity"),
}
#: Words that name a class of specification, in order of precedence (fixed values).
SPEC_TERMS: Terms = {
    "basic_info": ("vessel name", "imo number", "flag", "call sign", "built", "yard", "class"), "dimensions": ("loa", "length overall", "beam", "draft", "depth", "height", "dimensions"),
    "capacities": ("dwt", "deadweight", "cargo", "holds", "tanks", "capacity", "volume"), "propulsion": ("engine", "auxiliary", "propeller", "power", "speed"), "equipment": ("crane", "winch", "gear", "equipment", "handling", "machinery"),
    "navigation": ("navigation", "gps", "radar", "communication", "bridge", "instruments"), "certificates": ("certificate", "survey", "inspection", "valid", "expires", "classification"), "accommodation": ("accommodation", "crew", "cabins", "berths", "mess", "officers"),
}
#: Words of file names and the label they give, in order of precedence (fixed values).
FILE_TERMS: Terms = {
    "Fixture Recap": ("recap", "fixture"), "Charter Party Addendum": ("addendum", "addenda", "amendment", "rider"), "Vessel Specification": ("spec", "description", "particulars"), "Operational Instructions": ("instruction", "circular", "notice", "advisory"),
    "Charter Party": ("agreement", "contract", "charter", "gencon", "bimco"), "Financial Document": ("invoice", "statement", "account"), "Crew Document": ("crew", "manning", "seafarer"), "Cargo Document": ("cargo", "manifest", "loading", "stowage"),
}
#: Content types by heading: words of which one opens a family, the family's members with their words in order, the family's own name (fixed values).
HEADING_FAMILIES: list[tuple[tuple[str, ...], Terms, str]] = [
    (("charter party",), {
        "charter_party_cargo_exclusions": ("cargo exclusions", "excluded cargo"), "charter_party_trading_exclusions": ("trading exclusions", "trading limits"), "charter_party_duration_description": ("duration", "description"),
        "charter_party_delivery": ("delivery",), "charter_party_hire_payment": ("hire", "payment"), "charter_party_bunkers": ("bunkers",),
    }, "charter_party_clause"),
    (("fixture recap",), {
        "fixture_recap_trading_exclusions": ("trading", "exclusions"), "fixture_recap_cargo_details": ("cargo",), "fixture_recap_account": ("account",), "fixture_recap_period": ("period",), "fixture_recap_laycan": ("laycan",),
        "fixture_recap_delivery": ("delivery",), "fixture_recap_hire": ("hire",), "fixture_recap_bunkers": ("bunkers",),
    }, "fixture_recap_general"),
    (("vessel", "specification"), {"vessel_name": ("name",), "vessel_registration": ("registration",), "vessel_tonnage": ("tonnage",), "vessel_dimensions": ("dimensions",), "vessel_equipment": ("equipment",)}, "vessel_specification"),
    (("cargo",), {"cargo_exclusions_primary": ("exclusions",), "cargo_restrictions": ("restrictions",), "cargo_requirements": ("requirements",)}, "cargo_related"),
    (("trading",), {"trading_exclusions_primary": ("exclusions", "restrictions"), "trading_limits": ("limits",)}, "trading_related"),
]
#: Sections by content: words of which two are needed, words of which one is enough (fixed values).
SECTION_WORDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "vessel_specifications": (("vessel name", "imo number", "dwt", "loa", "beam", "draft", "class notation"), ()),
    "bunkers": (("bunker", "fuel", "vlsfo", "mgo", "delivery", "redelivery", "sampling"), ("bunker quantities", "fuel specifications", "iso 8217")),
    "trading_exclusions": (("trading", "trading exclusions", "prohibited", "sanctions", "iran", "cuba", "north korea"), ("inl/iwl", "sanctioned countries", "blacklisting")),
    "cargo_exclusions": (("cargo exclusions", "dangerous", "hazardous", "explosive", "radioactive"), ("livestock", "ammunition", "nuclear material")),
    "delivery": (("delivery", "dlosp", "port", "on-hire"), ("delivery port", "delivery notice")),
    "hire": (("hire", "daily", "usd", "payment"), ("rate of hire", "hire payment")),
}
#: Subsections of specifications by content (fixed values).
SPEC_PARTS: Terms = {"basic_info": ("vessel name", "imo number", "flag state"), "dimensions": ("loa", "beam", "draft", "depth"), "capacities": ("dwt", "deadweight", "cargo capacity"), "equipment": ("crane", "cargo gear", "container")}
#: First lines that are the heading of a charter clause as a whole, also behind ``BIMCO`` (fixed values).
CLAUSE_HEADINGS = (
    "Redelivery", "Bunkers", "Performance of Voyages", "Speed and Consumption", "Rate of Hire", "Hold Cleaning", "Hire Payment", "Cash Advances", "Spaces Available", "Supercargo", "Sailing Orders and Logs", "Cargo Exclusions", "OFF HIRE CLAUSE",
    "Pollution", "Drydocking", "Total Loss", "Exceptions", "Liberties", "Liens", "Salvage", "General Average", "Navigation", "Cargo Claims", "Cargo Handling Gear and Lights", "Bills of Lading", "Protective Clauses", "War Risks", "Ice", "Requisition",
    "Stevedore Damage", "Slow Steaming", "Piracy", "Taxes", "Industrial Action", "Stowaways", "Smuggling", "International Safety Management", "International Ship and Port", "Sanctions",
)


def term_class(text: Column, table: Terms, otherwise: Column | None = None) -> Column:
    """The first class of which the text, in lower case, holds a word; else ``otherwise`` (null)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for name, words in reversed(table.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def clause_class(heading: Column, content: Column, within: int = 500) -> Column:
    """The class of a clause by its heading, else by the first characters of its content, else ``general``."""
    return F.coalesce(term_class(heading, CLAUSE_TERMS), term_class(F.substring(content, 1, within), CLAUSE_TERMS), F.lit("general"))


def spec_class(content: Column) -> Column:
    return term_class(content, SPEC_TERMS, F.lit("general"))


def file_label(name: Column) -> Column:
    """A label of a document by its file name."""
    return term_class(name, FILE_TERMS, F.lit("Maritime Document"))


def heading_class(heading: Column) -> Column:
    """The content type of a heading: the first family that it opens, and in it the first member."""
    t = F.lower(F.coalesce(heading, F.lit("")))
    out = F.lit("general")
    for openers, members, own in reversed(HEADING_FAMILIES):
        hit = F.lit(False)
        for w in openers:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, term_class(heading, members, F.lit(own))).otherwise(out)
    return out


def part_name(text: Column) -> Column:
    """A heading as a name: lower case, no punctuation, blanks as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(text), r"(?U)[^\w\s-]", "")), r"\s+", "_")


def section_of(content: Column) -> Column:
    """struct(section, part, how): by the first line's form, else by the words of the content.

    Forms, the first that holds: a vessel specification, ``Fixture recap - N. item``,
    ``Charter Party – Clause N - title``, a listed clause heading, ``BIMCO ... Clause``,
    an addendum, ``N. title``. Content needs two words of a section or one that is
    enough alone.
    """
    first = F.trim(F.substring_index(F.coalesce(content, F.lit("")), "\n", 1))
    made = lambda s, p, how: F.struct(F.lit(s).alias("section"), p.alias("part"), F.lit(how).alias("how"))
    t = F.lower(F.coalesce(content, F.lit("")))
    count = lambda words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    out = made("other", F.lit("general"), "content_fallback")
    for name, (words, strong) in reversed(SECTION_WORDS.items()):
        part = term_class(content, SPEC_PARTS, F.lit("general")) if name == "vessel_specifications" else F.lit("general")
        out = F.when((count(words) >= 2) | (count(strong) >= 1), made(name, part, "content_match")).otherwise(out)
    listed = F.regexp_replace(first, "^BIMCO (?=(?:War Risks|Piracy|Sanctions)$)", "")
    forms = [
        (first.rlike(r"^Vessels? [Ss]pecifications? - .+"), "vessel_specifications", F.lit("all_specifications")),
        (first.rlike(r"^Fixture recap - \d+\.?\s*-?\s*.+"), "fixture_recap", part_name(F.regexp_replace(F.regexp_extract(first, r"^Fixture recap - \d+\.?\s*-?\s*(.+)", 1), "[:.]+$", ""))),
        (first.rlike(r"^Charter Party – Clause \d+ - .+"), "charter_party", part_name(F.regexp_extract(first, r"^Charter Party – Clause \d+ - (.+)", 1))),
        (listed.isin(*CLAUSE_HEADINGS), "charter_party", part_name(listed)),
        (first.rlike(r"^BIMCO .+ Clause"), "charter_party", part_name(F.replace(F.lower(F.regexp_extract(first, r"^BIMCO (.+?) Clause", 1)), F.lit(" "), F.lit("_")))),
        (F.startswith(first, F.lit("Addendum")), "addendum", F.lit("general")),
        (first.rlike(r"^\d+\.?\s+.+"), "other", part_name(F.regexp_extract(first, r"^\d+\.?\s+(.+)", 1))),
    ]
    for cond, section, part in reversed(forms):
        out = F.when(cond, made(section, part, "pattern_match")).otherwise(out)
    return out


#: Labels of a vessel's name, and the prefix of names (fixed values).
NAME_LABELS, PREFIX = ("vessel name", "ship name"), "MV"
#: Lines searched for the section of particulars, lines of it that are read, and lines read where there is none.
SEARCHED, READ, READ_ELSE = 200, 50, 100
#: Longest and shortest name.
NAME_MOST, NAME_LEAST = 99, 4


def _named(text: str, prefix: bool = True) -> str | None:
    name = " ".join(re.sub(r"[^\w\s-]", " ", text).split()).upper()
    if not NAME_LEAST <= len(name) <= NAME_MOST:
        return None
    return f"{PREFIX} {name}" if prefix and " " in name and not name.startswith(PREFIX) else name


def name_of_document(text: str | None, filename: str | None) -> str:
    """A vessel's or document's name: behind a label, in the line after one, a line of its own, else the file's.

    Labels are sought in the lines from the section of vessel details on, if
    there is one near the start, else in the first lines.
    """
    lines = [x.strip() for x in (text or "").split("\n")]
    start = next((i for i, x in enumerate(lines[:SEARCHED]) if "vessel detail" in x.lower() or "vessel specifications" in x.lower()), None)
    near = lines[:READ_ELSE] if start is None else lines[start : start + READ]
    marked = re.compile(r"(?i)(?:" + "|".join(x.replace(" ", r"\s+") for x in NAME_LABELS) + r")[\s:]+(\S.*)")
    for x in near:
        got = marked.search(x)
        if got and (name := _named(got.group(1))):
            return name
        if x.startswith(f"{PREFIX} ") and (name := _named(x)):
            return name
    for x, after in zip(near, near[1:], strict=False):
        if NAME_LABELS[0] in x.lower() and ":" in x and (name := _named(after)):
            return name
    for x in lines:
        words = x.upper().split()
        if len(x) > 4 and len(words) > 1 and words[0] == PREFIX and all(w.isascii() and w.isalpha() for w in words):
            return " ".join(words)
    stem = re.sub(r"\.[^.]*$", "", (filename or "").rsplit("/", 1)[-1])
    bare = " ".join(re.sub(r"[^\w\s-]", " ", stem).split())
    if PREFIX in stem.upper():
        cut = re.sub(r"(?i)(?:done|final|draft|copy|\d+)$", "", bare).strip()
        if cut:
            return (f"{PREFIX} {cut}" if " " in cut and not cut.upper().startswith(PREFIX) else cut).upper()
    return bare.upper()


def document_names(df: DataFrame, key: str, text: str, filename: str) -> DataFrame:
    """(key, name) of every row; null texts and file names are empty. Map-only."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, name_of_document(t, f)) for k, t, f in b.itertuples(index=False, name=None)], columns=[key, "name"])

    return df.select(key, text, filename).mapInPandas(run, f"`{key}` {kind}, name string")
