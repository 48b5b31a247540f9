"""Keyword-stuffed pages, link lists and tag lists.

Every page is read as a sequence of words. For each content word the recurrence
gaps to its previous and next occurrence are taken; the share of positions that
recur within lag windows is the page's positional autocorrelation. Prose repeats
function words, stuffed text repeats its content words at short and regular
gaps. The words of links and tags take part, so a list of links whose addresses
say the same things again and again is as regular as a list of words. The page is
cut into units (sentences of its lines), and a unit counts as stuffing if

- it lists content words without function words and figures, and most of them
  recur within the widest lag window - the first test, which at sf0.1 decides
  four fifths of the pages that are found,
- it consists of links, tags, hashtags or menu steps,
- a phrase that the page repeats stands in it again and again at gaps far below
  what sentences about a subject show,
- its items - figures aside - return as whole items of the page.

A page is found if such units hold more than half of its non-blank characters.
Genuine lists escape: inventories and specifications carry figures in every
item, texts on one subject name it about once a sentence, glossaries and
rotations do not return to the same items. A map-only job; whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import widen

#: Lag windows in words: phrase repetition within a sentence, within a few items, within a list.
LAGS = (4, 10, 40)
#: Share of recurring content words that makes a list a stuffed one.
RECUR = 0.6
#: Occurrences of a phrase or item from which it counts as repeated.
OFTEN = 4
#: Share of the non-blank characters.
MOST = 0.5
#: Function words of the languages of the corpus (fixed values, lower case).
FUNCTION = frozenset(
    """a an and are as at be been by can do for from had has have he her his i if in into is it its may must no not of off on or our out shall
    she should so than that the their them then there these they this those to unless until upon was we were what when where which who will with
    within without would you your me
    al como con de del desde el en es esta este fue la las lo los más no o para pero por que se sin sobre su sus un una y
    à au aux avec ce cette dans des du elle en est et il je le les leur mais ne nous ou où par pas pour qu que qui sa se ses son sont sur un une vous
    aber als am an auf aus bei bis das dass dem den der des die durch ein eine einem einen einer für hat ich im in ist mit nach nicht nur oder
    sich sie sind so über um und von vor war werden wird zu zum zur
    ao aos as com da das de do dos e em foi mais mas na nas no nos o os ou para pela pelo por que se sem seu sua um uma à às
    a ale by co czy dla do i jak jest lub na nie o od oraz po przez przy się są to w we z za ze że
    а бы в во все для до его ее и из или к как на не но о об от по при с со так то у что это
    """.split()
)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+(?=\D)")
_LINK = re.compile(r"https?://\S+|\bwww\.\S+|<\s*/?\s*(?:a|li|ul)\b[^>]*>|\]\([^)\s]*\)|(?:^|(?<=\s))//\S+\.\S+", re.I)
_HASH = re.compile(r"(?:^|(?<=[\s,;:]))#[^\W\d_]\w*|(?:^|(?<=[\s,;:]))#\d+\w+")
_TAGS = re.compile(r"^\s*(?:<[^>]*>\s*)*(?:meta\s+)?(?:tags?|keywords?|labels?|categories|schlagw\w+|mots[- ]cl\w+|etiquetas|теги|tagi)\s*[:=]", re.I)
_MENU = re.compile(r"\S\s*(?:>|»|›|→|::)\s*\S")
_ITEM = re.compile(r"\s*(?:\||::|/|;|•|·|»|>|→|\([\d\s.,]*\)|\[[\d\s.,]*\]|,(?=\s)|\t)\s*")
_HARD_ITEM = re.compile(r"\s*(?:\||::|;|•|·|»|>|→|\([\d\s.,]*\)|\[[\d\s.,]*\]|\t| / )\s*")
_CODED = re.compile(r"(?<!\S)(?=\S*?\d)\S+")
_MARKUP = re.compile(r"<[^>]*?(?=\s|>)|https?:|www\.|href|>|\]\(")
_COUNT = re.compile(r"[(\[]\d[\d.,]*[)\]]")
_MARK = re.compile(r"https?:|www\.|<|\]\(|//|#", re.I)
_SEPARATOR = re.compile(r"[|;•·»>→\t/(\[]|::|,\s")
_DIGIT = re.compile(r"\d")
_BLANKS = re.compile(r"(\s)\s{3,}")
_FIGURE = re.compile(r"\d[\d.,:/]*(\s?(?:mm|cm|m|km|kg|t|mt|kw|cbm|knots|m[²³23]|t/m2|%)\b)?", re.I)
_CLOUD = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]+[ -]){1,3}[^\W\d_]+ [(\[]\d[\d.,]*[)\]]")
_PRODUCT = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]+ ){1,5}(?:ref|sku|art|item|code|no|id)\.? ?#?\d[\d.,]*(?= *(?:[|;,]|$))", re.I)
#: Share of function words from which a unit is prose.
PROSE = 0.35
#: Words up to which a unit is a list entry rather than a sentence.
ENTRY = 10


def _solid(text: str) -> int:
    return sum(map(len, text.split()))


def _units(text: str) -> list[str]:
    out = []
    for line in text.splitlines():
        if line.strip():
            line = _BLANKS.sub(r"\1\1", line)
            out += [s for s in _SENTENCE.split(line) if s.strip()]
    return out


def _letters(m: re.Match) -> str:
    """The letters of a coded word, if it is one of a link or tag; other codes are no words."""
    return m.group() if _MARK.search(m.group()) or "/" in m.group() else " "


def _gaps(words: list[str], content: list[bool]) -> list[int]:
    """Distance of each content word to its nearest other occurrence; a large number if there is none."""
    far = 1 << 30
    out = [far] * len(words)
    seen: dict[str, int] = {}
    for i, w in enumerate(words):
        if content[i]:
            j = seen.get(w)
            if j is not None:
                g = i - j
                out[i] = g
                if g < out[j]:
                    out[j] = g
            seen[w] = i
    return out


def analyse(text: str | None) -> dict[str, float]:
    """Measures of one text: ``share`` of stuffed characters, autocorrelation per lag window, and the kinds of stuffing.

    Null, empty and blank texts have a share of 0.
    """
    zero = {"share": 0.0, "links": 0.0, "phrases": 0.0, "items": 0.0, "lists": 0.0, **{f"lag_{k}": 0.0 for k in LAGS}}
    units = _units(text or "")
    sizes = [_solid(u) for u in units]
    total = sum(sizes)
    if not total:
        return zero
    marked = _MARK.search(text) is not None
    words: list[str] = []
    all_words: list[str] = []  # those of links and tags too
    spans, all_spans, digits, marks = [], [], [], []
    for u in units:
        mark, digit = marked and _MARK.search(u) is not None, _DIGIT.search(u) is not None
        plain = _LINK.sub(" ", u) if mark else u
        own = _WORD.findall((_CODED.sub(" ", plain) if digit else plain).lower())
        if marked:
            bare = _MARKUP.sub(" ", u) if mark else u
            each = _WORD.findall((_CODED.sub(_letters, bare) if digit else bare).lower()) if mark else own
            all_spans.append((len(all_words), len(all_words) + len(each)))
            all_words += each
        spans.append((len(words), len(words) + len(own)))
        digits.append(digit)
        marks.append(mark)
        words += own
    function = [w in FUNCTION for w in words]
    content = [not f and len(w) > 1 for w, f in zip(words, function, strict=True)]
    gap = _gaps(words, content)
    all_content, all_gap = content, gap
    if marked:
        all_content = [w not in FUNCTION and len(w) > 1 for w in all_words]
        all_gap = _gaps(all_words, all_content)
    else:
        all_spans = spans
    n_content = max(1, sum(content))
    recurring = [g for g in gap if g <= LAGS[-1]]
    lag = {f"lag_{k}": sum(g <= k for g in recurring) / n_content for k in LAGS}
    single = Counter(w for w, c in zip(words, content, strict=True) if c)
    hot = {w for w, c in single.items() if c >= OFTEN}
    pairs = {p for p, c in Counter(_pairs(words)).items() if c >= OFTEN} if hot else set()
    items: Counter = Counter()
    split = []
    for u, digit, mark, (a, b) in zip(units, digits, marks, spans, strict=True):
        if not mark and not _SEPARATOR.search(u):
            parts = [" ".join(words[a:b])] if b > a else []
        else:
            cut = (_HARD_ITEM if digit else _ITEM).split(u.lower())
            parts = [x for p in cut if (x := " ".join(_WORD.findall(_CODED.sub(" ", p) if digit else p)))]
        split.append(parts)
        items.update(parts)
    opening = Counter(" ".join(p.split()[:2]) for parts in split if len(parts) >= 8 for p in parts)
    entries = sum(0 < b - a <= ENTRY and u.rstrip()[-1:] not in ".!?" for u, (a, b) in zip(units, spans, strict=True))
    often = 2 if entries >= 8 and entries > len(units) / 2 else OFTEN - 1
    same = Counter(units)
    kinds = dict.fromkeys(("links", "phrases", "items", "lists"), 0)
    for u, size, digit, mark, (a, b), (c, d), parts in zip(units, sizes, digits, marks, spans, all_spans, split, strict=True):
        own = words[a:b]
        n = b - a
        func = sum(function[a:b]) / max(1, n)
        ended = u.rstrip()[-1:] in ".!?"
        if func >= PROSE and (n > ENTRY or ended) and not mark and ":" not in u and "=" not in u and hot.isdisjoint(own) and (not digit or sum(map(u.count, "([|;,")) < 4):
            continue  # prose without repeated words meets none of the tests
        n_own = max(1, sum(content[a:b]))
        figures = _FIGURE.findall(_COUNT.sub(" ", u)) if digit else []
        counted = len(figures) > max(1, 0.2 * n) or any(figures)
        if d - c > 1 and func < 0.2 and not counted and not (6 <= d - c < 30 and ended) and sum(all_gap[i] <= LAGS[2] for i in range(c, d) if all_content[i]) >= RECUR * max(1, sum(all_content[c:d])):
            kinds["lists"] += size
            continue
        linked = sum(map(len, _LINK.findall(u))) + sum(map(len, _HASH.findall(u))) if mark else 0
        cloud = sum(len(m.group()) for m in _CLOUD.finditer(u)) if digit and u.count("(") + u.count("[") > 4 else 0
        products = _PRODUCT.findall(u) if digit and u.count("|") + u.count(";") + u.count(",") > 3 else []
        if len(products) > 4:
            cloud = max(cloud, sum(map(len, products)) + 3 * len(products))
        if linked > 0.5 * size or ((":" in u or "=" in u) and _TAGS.search(u)) or (linked and func < 0.2) or (func < 0.2 and n < 30 and len(_MENU.findall(u)) > 1) or cloud > 0.7 * len(u):
            kinds["links"] += size
            continue
        if not n:
            continue
        again = [w for w in own if w in hot] if hot else []
        twice = len(again) > 1 and len(set(again)) < len(again)
        inner = Counter(p for p in _pairs(own) if p in pairs) if pairs and again else Counter()
        if twice or inner:
            near = sum(gap[i] <= LAGS[1] for i in range(a, b) if words[i] in hot)
            if near >= max(2, 0.4 * n_own) and (any(c > 1 for c in inner.values()) or (not inner and twice)):
                kinds["phrases"] += size
                continue
        entry = n <= ENTRY and not ended
        whole = sum(map(len, parts))
        if len(parts) >= 8 and 4 <= whole / len(parts) <= 30 and func < PROSE and sum(len(p) for p in parts if opening[" ".join(p.split()[:2])] > 1) >= 0.5 * whole:
            kinds["items"] += size
            continue
        if func < 0.2 and not counted and same[u] >= OFTEN - 1:
            kinds["items"] += size
            continue
        if (func < 0.2 or entry) and (entry or len(parts) > 2 or twice) and not (entry and counted and len(parts) < 3):
            if sum(len(p) for p in parts if items[p] >= (often if entry else OFTEN - 1)) >= 0.5 * whole:
                kinds["items"] += size
                continue
        sentence = 6 <= n < 30 and ended and not twice
        if not counted and not sentence:
            recur = sum(gap[i] <= LAGS[2] for i in range(a, b) if content[i]) / n_own
            if (func < 0.2 and recur >= RECUR) or (entry and (inner or _opens(items, own, often))):
                kinds["lists"] += size
    stuffed = sum(kinds.values())
    return {"share": stuffed / total, **{k: v / total for k, v in kinds.items()}, **lag}


def _pairs(words: list[str]) -> list[tuple[str, str]]:
    """Neighbouring content words, also across one function word."""
    out = []
    for i in range(len(words) - 1):
        if words[i] not in FUNCTION and len(words[i]) > 1:
            if words[i + 1] not in FUNCTION:
                out.append((words[i], words[i + 1]))
            elif i + 2 < len(words) and words[i + 2] not in FUNCTION:
                out.append((words[i], words[i + 2]))
    return out


def _opens(items: Counter, own: list[str], often: int) -> bool:
    """Whether a short entry opens with an item of the page that also returns alone."""
    return any(items[" ".join(own[:k])] >= often for k in (1, 2, 3, 4) if len(own) > k)


MEASURES = "doc_id long, share double, links double, phrases double, items double, lists double, " + ", ".join(f"lag_{k} double" for k in LAGS)


def measure_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures of every text; see ``analyse``. Rows with a null key are left out; each other row gives one row."""
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"doc_id": int(k), **analyse(t)} for k, t in b.itertuples(index=False, name=None)], columns=names)

    return widen(df.where(F.col(key).isNotNull()).select(key, text), key).mapInPandas(run, MEASURES)


def stuffed_pages(df: DataFrame, key: str = "doc_id", text: str = "text", most: float = MOST) -> DataFrame:
    """The measures of the texts of which more than ``most`` is stuffing."""
    return measure_pages(df, key, text).where(F.col("share") > most)
