"""Noise in text read from scanned pages.

Layout first: running headers and page numbers that stand inside the text are
removed, words broken across lines are joined. Then misread characters: a
weighted Levenshtein automaton of every suspect token is intersected with a trie
of the corpus vocabulary, which retrieves all vocabulary words within the limit.
A confusion of the reader (a character or pair taken for another) costs
``CONFUSED``, an insertion, deletion or substitution of any character ``OTHER``.
Candidates are ranked by their frequency, their edits, and the words before and
after them. Last, hard line breaks within paragraphs are undone.

At scale: words and word pairs are counted over all rows, and all of them take
part. The vocabulary is dealt into tries of about ``SHARD`` words, the suspect
tokens into parts of about ``TOKENS``; each distinct token meets every trie once,
and its candidates are joined to the rows that hold it, as are the counts of
broken words and of neighbouring words. Only frequent words that no other word
can have been misread as are broadcast, so that their occurrences are passed
over: shares of all tokens of ``SURE_SHARE`` and more, at most 1/``SURE_SHARE``
words.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import cut_lineage, spread, widen

#: Share of all tokens from which a word is looked up once, among the others of that share; if it cannot have been misread, its occurrences are not inspected.
SURE_SHARE = 1e-4
#: A word must be so many times as frequent as its misreading: if letters changed into letters, or into other characters, or by an edit that is no listed confusion.
RATIO_LETTERS, RATIO_OTHER, RATIO_EDIT = 30, 3, 300
#: Share of all tokens from which a pair of neighbouring words is a common one.
PAIR_SHARE = 5e-6
#: Cost of a listed confusion, and of any other edit of one character.
CONFUSED, OTHER = 1, 2
#: Most cost of a token, by its length up to 8 and beyond.
DISTANCE = (2, 3)
#: Words of one trie; tokens looked up in it by one task, and at a time.
SHARD, TOKENS, STEP = 100_000, 50_000, 1_000
#: Log charges for a confusion and for another edit.
CHARGE_CONFUSED, CHARGE_OTHER = 5.0, 12.0
#: Confusions of a reader, as read -> as printed (fixed values).
CONFUSIONS = (
    ("c", "e"), ("@", "a"), ("+", "t"), ("5", "s"), ("$", "s"), ("0", "o"), ("1", "l"), ("|", "l"), ("!", "l"), ("1", "i"), ("|", "i"), ("!", "i"),
    ("l", "i"), ("9", "g"), ("8", "b"), ("6", "b"), ("b", "h"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("vv", "w"),
    ("h", "ti"), ("d", "cl"), ("li", "h"), ("tl", "th"),
)

_OUTER = ".,;:()“”\"‘’!?…[]{}<>*_=/\\«»"
_PLAIN = re.compile(r"[^\W\d_]+(?:[-'’‑][^\W\d_]+)*")
_TOKEN = re.compile(r"(?!.*\d\d)[^\W_@+|!$]*[^\W\d_][\w@+|!$'’-]*|[@+|!$0-9]{1,2}[^\W\d_][\w@+|!$'’-]*")
_ASCII = re.compile(r"[\x00-\x7f]+")
#: ``_PLAIN`` as the engine reads it.
_LETTERS_ONLY = r"^\p{L}+(?:[-'’‑]\p{L}+)*$"

_PAGE = re.compile(
    r"\s*(?:(?:p[a@][g9]e|p[g9]?\.|p[aá]g(?:ina|\.)?|s[e3]it[e3]|s[h]ee[t+]|f[o0][l1|]i[o0]|b[l1|]att|strona|str\.|стр\.?)\s*(?:n[o0°º]\.?\s*)?\d{1,4}(?:\s*(?:[o0]f|/|de|von|z|из|sur)\s*\d{1,4})?"
    r"|[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|\d{1,4}\s*/\s*\d{1,4})\s*",
    re.I,
)
_BARE = re.compile(r"\s*(?:\d{1,4}|[ivxl]{1,8})\s*")
_MARKED = re.compile(r"[^.;]{2,60}(?:\s[|¦]\s[^|¦.;]{1,40}){1,3}(?:\.\s?\d{1,3})?|.{2,50}\bc[o0]nf[il1|!]den[t+][il1|!][a@][l1|!].{0,12}|.{4,70}[,(]\s?[c]on[t+][il1|!]nued\)?", re.I)
_SPACED = re.compile(r"(?=[^\W\d_])\S.{1,60}?\S {2,}\S.{1,60}\S|(?=[^\W\d_])\S.{1,60}?\S {2,}\S+")
_CODE = re.compile(r"\b[A-Z0-9]{1,4}-?\d{3,}\b")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_SOFT = re.compile(r"[-‐¬­][ \t]*\n")
_BREAK = re.compile(r"(?<![^\s\-‐¬­])([^\s\-‐¬­]*[\w@+|!$])([-‐¬­])[ \t]*\n\s*([\w@+|!$][\w@+|!$'’]*)")


def _prose(line: str) -> bool:
    words = _LETTERS.findall(line)
    s = line.strip()
    return len(words) >= 4 or (len(words) >= 1 and s[-1:] in ".,;!?") or (len(words) >= 2 and s[:1].islower())


def _numbered(lines: list[str], bare: list[int]) -> bool:
    """Whether bare numbers number the single lines between them: a list."""
    runs = [b - a for a, b in zip(bare, bare[1:], strict=False)]
    return len(bare) >= 3 and all(r == 2 for r in runs) and all(lines[b].strip().isdigit() for b in bare)


def _is_page(line: str) -> bool:
    s = line.lstrip()
    return s[:1].lower() in "psfbсс-–—[0123456789" and _PAGE.fullmatch(line) is not None


def _is_head(line: str) -> bool:
    s = line.strip()
    if len(s) > 90 or s[:1] in "│├┌└|":
        return False
    if ("|" in s or "¦" in s or s[-4:].lower() in ("nued", "ued)") or "den" in s.lower()) and _MARKED.fullmatch(s):
        return True
    return "  " in s and s[-1] not in ".,;:" and _SPACED.fullmatch(s) is not None


def _label(line: str) -> bool:
    """Whether a line may be a header by its look alone: short, capitalised, without punctuation at its end."""
    s = line.strip()
    return 3 <= len(s) <= 70 and s[0].isupper() and s[-1] not in ".,;:!?-–¬­" and ":" not in s and len(s.split()) <= 8 and not _prose(line)


def _running(line: str) -> bool:
    """Whether a line is running text: five words and more lower-case than other starts."""
    words = _LETTERS.findall(line)
    return len(words) >= 5 and sum(w[0].islower() for w in words) * 2 > len(words) and not re.search(r":\s", line)


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """Numbers of the lines that are (running headers, page numbers) inside the text.

    A line counts only between lines of prose; what stands before the first or
    after the last of them is not inside the text. Bare numbers count where prose
    goes on across them, not in lists and tables.
    """
    solid = [i for i, x in enumerate(lines) if x and not x.isspace()]
    short = [i for i in solid if len(lines[i]) <= 100]
    pages = {i for i in short if len(lines[i]) <= 60 and _is_page(lines[i])}
    heads = {i for i in short if i not in pages and _is_head(lines[i])}
    bare = [i for i in short if i not in pages and len(lines[i]) <= 60 and _BARE.fullmatch(lines[i])]
    odd = [i for i in short if i not in pages and i not in heads and _label(lines[i])]
    if len(solid) < 3 or not (heads or pages or bare or odd):
        return set(), set()
    flags = {i: _prose(lines[i]) for i in solid if i not in heads and i not in pages}
    if sum(flags.values()) < 2:
        return set(), set()
    rest = list(flags)
    if not _numbered(lines, bare):
        firm = [i for i in rest if not (i in odd and _CODE.search(lines[i]))]
        at = {i: k for k, i in enumerate(firm)}
        for i in bare:
            k = at.get(i, 0)
            if 0 < k < len(firm) - 1 and flags[firm[k - 1]] and flags[firm[k + 1]]:
                pages.add(i)
    sure = heads | pages
    beside = {j for k, i in enumerate(solid) if i in sure for j in solid[max(0, k - 1) : k + 2]}
    firm = [i for i in rest if i not in pages]
    at = {i: k for k, i in enumerate(firm)}
    for i in odd:
        k = at.get(i, 0)
        if not 0 < k < len(firm) - 1 or flags[i]:
            continue
        before, after = lines[firm[k - 1]].rstrip(), lines[firm[k + 1]].lstrip()
        strong = i in beside or _CODE.search(lines[i]) is not None
        if flags[firm[k - 1]] and (_running(before) or _running(after)) and (flags[firm[k + 1]] or strong) and (strong or before[-1:] not in ".!?:;" or after[:1].islower()):
            heads.add(i)
    known = [i for i in rest if i not in pages and i not in heads]
    prose = [i for i in known if flags[i]]

    def between(i: int) -> bool:
        k = bisect.bisect(known, i)
        return 0 < k < len(known) and (flags[known[k - 1]] or flags[known[k]])

    return {i for i in heads if between(i)}, {i for i in pages if between(i)} if prose else set()


#: Whether a word broken by a hyphen is joined, by (joined form, hyphenated form, second part not in lower case).
Decide = Callable[[str, str, bool], bool]


def join_breaks(text: str, decide: Decide) -> tuple[str, int]:
    """Joins words broken across lines: (text, how many).

    A soft hyphen or logical-not sign always marks a break; of a hyphen between
    words of letters ``decide`` tells.
    """
    hits = 0

    def join(m: re.Match) -> str:
        nonlocal hits
        left, mark, right = m.groups()
        if mark in "-‐":
            if not any(c.isalpha() for c in left) or not any(c.isalpha() for c in right):
                return m.group()
            if not decide((left + right).strip(_OUTER).lower(), f"{left}-{right}".strip(_OUTER).lower(), right[0].isalpha() and not right[0].islower()):
                return m.group()
        hits += 1
        return left + right

    if "-\n" not in text and not _SOFT.search(text):
        return text, 0
    return _BREAK.sub(join, text), hits


def joins(whole: Column, hyphened: Column, capital: Column) -> Column:
    """Whether a break is joined, by how often the joined and the hyphenated form stand in the corpus.

    It is, unless the hyphenated form is the commoner word, or the joined form is
    unknown and the second part is capitalised.
    """
    return (hyphened <= whole) & ((whole > 0) | ~capital)


def clean_layout(text: str, decide: Decide) -> tuple[str, int, int, int]:
    """(text without furniture and broken words, headers, page numbers, joined words)."""
    heads: set[int] = set()
    pages: set[int] = set()
    if "\n" in text:
        lines = text.split("\n")
        heads, pages = furniture(lines)
        if heads or pages:
            gone = heads | pages
            keep: list[str] = []
            cut = False
            for i, line in enumerate(lines):
                if i in gone or (cut and not line.strip()):
                    while keep and not keep[-1].strip():
                        keep.pop()
                    cut = True
                    continue
                cut = False
                keep.append(line)
            text = "\n".join(keep)
    text, joined = join_breaks(text, decide)
    return text, len(heads), len(pages), joined


def tokens(text: str) -> list[str]:
    """Blank-separated tokens without outer punctuation, in lower case."""
    return [t.strip(_OUTER) for t in text.lower().split()]


@lru_cache(maxsize=100_000)
def word_like(token: str) -> bool:
    """Whether a token may be a misread word: mostly letters, not a code or a number."""
    return 1 < len(token) <= 24 and sum(c.isalpha() for c in token) * 2 >= len(token) and _TOKEN.fullmatch(token) is not None


class Trie:
    """Vocabulary trie as arrays, level by level, to be intersected with the automata of many tokens at once.

    The words of a node are a range of the sorted vocabulary, its children a
    range of the next level.
    """

    def __init__(self, words: list[str], confusions: tuple = CONFUSIONS, other: int = OTHER) -> None:
        self.words = sorted({w for w in words if w})
        self.confusions, self.other = confusions, other
        n = len(self.words)
        size = np.array([len(w) for w in self.words], np.int64)
        depth = int(size.max()) if n else 0
        grid = np.zeros((n, depth), np.uint32)
        for i, w in enumerate(self.words):
            grid[i, : len(w)] = [ord(c) for c in w]
        common = np.zeros(n, np.int64)  # leading characters shared with the word before
        if n > 1:
            differs = grid[1:] != grid[:-1]
            common[1:] = np.where(differs.any(1), differs.argmax(1), depth)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rows, ends = np.zeros(1, np.int64), np.array([n])
        for level in range(depth):
            new = (common <= level) & (size > level)
            if n:
                new[0] = size[0] > level
            start = np.nonzero(new)[0]
            children = np.searchsorted(start, rows), np.searchsorted(start, ends)
            stop = np.append(start[1:], n)
            if level:  # a node ends where its parent does
                owner = np.searchsorted(rows, start, "right") - 1
                stop = np.minimum(stop, ends[owner])
            self.levels.append((children[0], children[1], grid[start, level], np.where(size[start] == level + 1, start, -1)))
            rows, ends = start, stop

    def within(self, tokens: list[str], limit: int) -> list[tuple[int, str, int, int]]:
        """(number of the token, word, confusions, other edits) of all words within ``limit``, by the cheapest edits; the token itself is left out.

        Every state of the automaton is a bit: bit i of plane (c, o) says that i
        characters of the token are read with c confusions and o other edits.
        """
        if not self.words or not tokens:
            return []
        planes = sorted(((c, o) for c in range(limit // CONFUSED + 1) for o in range(limit // self.other + 1) if c * CONFUSED + o * self.other <= limit), key=lambda p: (p[0] * CONFUSED + p[1] * self.other, p[1]))
        if not self.confusions:
            planes = [p for p in planes if not p[0]]
        at = {p: k for k, p in enumerate(planes)}
        code: dict[int, int] = {}
        for _, _, chars, _ in self.levels:
            for c in np.unique(chars).tolist():
                code.setdefault(c, len(code))
        match = np.zeros((len(tokens), len(code) + 1), np.int64)
        op = np.zeros((len(tokens), max(1, len(self.confusions))), np.int64)
        for t, token in enumerate(tokens):
            for i, c in enumerate(token):
                if (k := code.get(ord(c))) is not None:
                    match[t, k] |= 1 << i
            for k, (read, _) in enumerate(self.confusions):
                i = token.find(read)
                while i >= 0:
                    op[t, k] |= 1 << i
                    i = token.find(read, i + 1)
        full = np.array([(1 << (len(t) + 1)) - 1 for t in tokens], np.int64)
        last = np.array([1 << len(t) for t in tokens], np.int64)

        def drop(state: list[np.ndarray], most: np.ndarray) -> list[np.ndarray]:
            """Characters of the token that no character of the word stands for."""
            for p, k in at.items():
                if (to := at.get((p[0], p[1] + 1))) is not None:
                    state[to] = state[to] | (state[k] << 1)
            return [x & most for x in state]

        tok = np.arange(len(tokens))
        node = np.zeros(len(tokens), np.int64)
        state = drop([np.full(len(tokens), 1 if p == (0, 0) else 0, np.int64) for p in planes], full)
        older = [np.zeros(len(tokens), np.int64) for _ in planes]
        before = np.zeros(len(tokens), np.uint32)
        out: list[tuple[int, str, int, int]] = []
        lookup = np.zeros(max(code, default=0) + 1, np.int64)
        for c, k in code.items():
            lookup[c] = k
        for first, end, chars, word in self.levels:
            width = (end - first)[node]
            at_parent = np.repeat(np.arange(len(node)), width)
            if not len(at_parent):
                break
            child = np.arange(len(at_parent)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[node], width)
            t, c = tok[at_parent], chars[child]
            old = [x[at_parent] for x in state]
            oldest = [x[at_parent] for x in older]
            prior = before[at_parent]
            same = match[t, lookup[c]]
            new = [(x & same) << 1 for x in old]
            waiting = np.zeros(len(t), bool)
            for p, k in at.items():
                if (to := at.get((p[0], p[1] + 1))) is not None:
                    new[to] |= old[k] | (old[k] << 1)
            for k, (read, printed) in enumerate(self.confusions):
                here = np.nonzero(c == ord(printed[-1]))[0]
                if len(printed) > 1:
                    here = here[prior[here] == ord(printed[0])]
                if len(here):
                    source, allowed = (old if len(printed) == 1 else oldest), op[t[here], k]
                    for p, plane in at.items():
                        if (to := at.get((p[0] + 1, p[1]))) is not None:
                            new[to][here] |= (source[plane][here] & allowed) << len(read)
                if len(printed) > 1:
                    half = np.nonzero(c == ord(printed[0]))[0]
                    if len(half):
                        reach = np.zeros(len(half), np.int64)
                        for p, plane in at.items():
                            if (p[0] + 1, p[1]) in at:
                                reach |= old[plane][half]
                        waiting[half] |= (reach & op[t[half], k]) != 0
            new = drop(new, full[t])
            alive = waiting
            for x in new:
                alive = alive | (x != 0)
            ended = np.nonzero(word[child] >= 0)[0]
            open_ = np.ones(len(ended), bool)
            for k, p in enumerate(planes):
                hit = open_ & ((new[k][ended] & last[t[ended]]) != 0)
                open_ &= ~hit
                if p != (0, 0):
                    out += [(a, self.words[b], *p) for a, b in zip(t[ended[hit]].tolist(), word[child[ended[hit]]].tolist(), strict=True)]
            tok, node, before = t[alive], child[alive], c[alive]
            state, older = [x[alive] for x in new], [x[alive] for x in old]
        return out


def count_words(df: DataFrame, text: str = "body") -> DataFrame:
    """(kind, a, b, n): ``w`` rows count word-like tokens a, with b = ``plain`` if they are letters only; ``p`` rows neighbouring plain words a, b; one ``n`` row counts all tokens. All rows take part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        pairs: Counter = Counter()
        total = 0

        def flush() -> pd.DataFrame:
            known = {w for w in words if _PLAIN.fullmatch(w)}
            rows = [("w", w, "plain" if w in known else "", n) for w, n in words.items() if w in known or word_like(w)]
            rows += [("p", a, b, n) for (a, b), n in pairs.items() if a in known and b in known]
            rows.append(("n", "", "", total))
            words.clear()
            pairs.clear()
            return pd.DataFrame(rows, columns=["kind", "a", "b", "n"])

        for b in batches:
            for t in b[text]:
                ts = tokens(t)
                words.update(ts)
                pairs.update(zip(ts, ts[1:], strict=False))
                total += len(ts)
            if len(pairs) + len(words) > 300_000:
                yield flush()
                total = 0
        yield flush()

    return widen(df.where(F.col(text).isNotNull()).select(text), text).mapInPandas(run, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


class Statistics:
    """Counts of a corpus' words and neighbouring words, kept in the shared folder, and the frequent words."""

    def __init__(self, df: DataFrame, text: str = "body") -> None:
        self.table = cut_lineage(count_words(df, text))
        self.total = self.table.where("kind = 'n'").agg(F.sum("n")).first()[0] or 0
        self.words = self.table.where("kind = 'w' and a <> ''").select("a", F.col("b") == "plain", "n").toDF("word", "plain", "n")
        self.pairs = self.table.where("kind = 'p'").select("a", "b", "n")
        often = {r.word: r.n for r in self.words.where(F.col("plain") & (F.col("n") >= SURE_SHARE * self.total)).select("word", "n").toLocalIterator()}
        self.sure = often.keys() - {x[0] for x in _options(often, often)}


def _options(vocabulary: dict[str, int], asked: dict[str, int]) -> Iterator[tuple[str, int, str, int, int, int]]:
    """(token, its count, word, its count, confusions, other edits) of the words that the tokens may have been misread from.

    Words that differ in characters beyond ASCII are retrieved but left out here
    unless listed confusions explain them: such characters change by a wrong
    encoding (``llm.garbling``) or an accent, not by the reader.
    """
    trie = Trie([w for w, n in vocabulary.items() if n >= RATIO_OTHER])
    for long in (False, True):
        own = sorted(((t, n) for t, n in asked.items() if (len(t) > 8) == long), key=lambda x: (len(x[0]), x[0]))
        for i in range(0, len(own), STEP):
            block = own[i : i + STEP]
            for k, w, confused, other in trie.within([t for t, _ in block], DISTANCE[long]):
                t, n = block[k]
                if other and _ASCII.sub("", t) != _ASCII.sub("", w):
                    continue
                ratio = RATIO_EDIT if other else RATIO_LETTERS if _PLAIN.fullmatch(t) else RATIO_OTHER
                if vocabulary[w] >= ratio * n:
                    yield t, n, w, vocabulary[w], confused, other


def corrections(suspects: DataFrame, stats: Statistics) -> DataFrame:
    """(token, token_n, word, n, confused, other): for every distinct ``token`` all vocabulary words within its limit that are frequent enough beside it.

    Words rarer than ``RATIO_OTHER`` can never be, so they are left out of the
    tries. Tokens meet each trie in parts of bounded size.
    """
    spark = suspects.sparkSession
    counted = suspects.select("token").distinct().join(stats.words.select(F.col("word").alias("token"), F.col("n").alias("token_n")), "token", "left")
    rare = cut_lineage(counted.select("token", F.coalesce("token_n", F.lit(1)).alias("token_n")))
    vocabulary = stats.words.where(F.col("plain") & (F.col("n") >= RATIO_OTHER))
    shards = max(1, -(-vocabulary.count() // SHARD))
    parts = max(spark.sparkContext.defaultParallelism, -(-rare.count() // TOKENS))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    tries = vocabulary.select(deal("word", shards).alias("shard"), upto(parts).alias("part"), F.lit(True).alias("listed"), F.col("word").alias("s"), "n")
    asked = rare.select(upto(shards).alias("shard"), deal("token", parts).alias("part"), F.lit(False).alias("listed"), F.col("token").alias("s"), F.col("token_n").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        listed, rest = (dict(zip(pdf.s[at], pdf.n[at].astype(int), strict=True)) for at in (pdf.listed, ~pdf.listed))
        return pd.DataFrame(_options(listed, rest), columns=["token", "token_n", "word", "n", "confused", "other"])

    both = tries.unionByName(asked)
    return spread(both, "shard", "part").groupBy("shard", "part").applyInPandas(run, "token string, token_n long, word string, n long, confused int, other int")


SUSPECTS = "chunk_id long, headers int, pages int, soft int, breaks array<struct<whole: string, hyphened: string, capital: boolean>>, suspects array<struct<token: string, prev: string, next: string, broken: boolean>>"


def inspect_rows(df: DataFrame, sure: Broadcast, key: str = "id", text: str = "body") -> DataFrame:
    """Layout findings, words broken by hyphens and suspect tokens of every row that has any. Map-only.

    Tokens are those of the text with all breaks joined; those that a hyphen's
    break gave are ``broken``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sure.value
        for b in batches:
            rows = []
            for k, t in b.itertuples(index=False, name=None):
                met: list[tuple[str, str, bool]] = []

                def note(*broken: str | bool, met: list = met) -> bool:
                    met.append(broken)
                    return True

                body, heads, pages, joined = clean_layout(t, note)
                ts = tokens(body)
                whole = {x[0] for x in met}
                odd = [i for i, x in enumerate(ts) if x not in known and word_like(x)]
                if heads or pages or joined or odd:
                    found = [{"token": ts[i], "prev": ts[i - 1] if i else "", "next": ts[i + 1] if i + 1 < len(ts) else "", "broken": ts[i] in whole} for i in odd]
                    rows.append((int(k), heads, pages, joined - len(met), [dict(zip(("whole", "hyphened", "capital"), x, strict=True)) for x in met], found))
            yield pd.DataFrame(rows, columns=["chunk_id", "headers", "pages", "soft", "breaks", "suspects"])

    return widen(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text), key).mapInPandas(run, SUSPECTS)


def joined_words(seen: DataFrame, stats: Statistics) -> DataFrame:
    """(chunk_id, whole, hyphened, capital, times) of the words broken by a hyphen that are to be joined; see ``joins``."""
    met = seen.select("chunk_id", "breaks").distinct().select("chunk_id", F.explode("breaks").alias("b")).select("chunk_id", "b.*").groupBy("chunk_id", "whole", "hyphened", "capital").agg(F.count("*").alias("times"))
    for form in ("whole", "hyphened"):
        met = met.join(stats.words.select(F.col("word").alias(form), F.col("n").alias(f"{form}_n")), form, "left")
    whole, hyphened = (F.coalesce(f"{c}_n", F.lit(0)) for c in ("whole", "hyphened"))
    return met.where(joins(whole, hyphened, F.col("capital"))).select("chunk_id", "whole", "hyphened", "capital", "times")


def misreadings(seen: DataFrame, joined: DataFrame, stats: Statistics) -> DataFrame:
    """(chunk_id, token, word): misread tokens of the rows with the likeliest word in their context.

    A candidate scores its log frequency plus that of its pairs with the words
    before and after, less a charge for each edit. A token of letters only is
    taken as misread where the candidate stands beside one of its neighbours
    more often than the token stands at all, or makes a common pair with it, or
    where it is far commoner than the token; one that differs by more than confusions only where both its
    neighbours speak for the candidate.
    """
    met = seen.select("chunk_id", F.explode("suspects").alias("s")).select("chunk_id", "s.*")
    options = cut_lineage(corrections(met, stats))
    met = met.join(options.select("token").distinct(), "token", "left_semi")
    broken = met.where("broken").join(joined.select("chunk_id", F.col("whole").alias("token")).distinct(), ["chunk_id", "token"], "left_semi")
    j = met.where("not broken").unionByName(broken).drop("broken").distinct().join(options, "token")
    pairs = stats.pairs
    j = j.join(pairs.select(F.col("a").alias("prev"), F.col("b").alias("word"), F.col("n").alias("_left")), ["prev", "word"], "left")
    j = j.join(pairs.select(F.col("a").alias("word"), F.col("b").alias("next"), F.col("n").alias("_right")), ["word", "next"], "left")
    left, right = F.coalesce("_left", F.lit(0)), F.coalesce("_right", F.lit(0))
    stands = lambda c: (c >= RATIO_OTHER * F.col("token_n")) | (c >= PAIR_SHARE * stats.total)
    plain = F.col("token").rlike(_LETTERS_ONLY)
    known = F.when(F.col("other") > 0, stands(left) & stands(right)).otherwise(~plain | stands(left) | stands(right) | (F.col("n") >= 10 * RATIO_LETTERS * F.col("token_n")))
    score = F.log(F.col("n")) - CHARGE_CONFUSED * F.col("confused") - CHARGE_OTHER * F.col("other") + F.log1p(left) + F.log1p(right)
    best = j.where(known).groupBy("chunk_id", "token", "prev", "next").agg(F.max_by("word", F.struct(score, "word")).alias("word"))
    return best.select("chunk_id", "token", "word")


def _findings(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layout findings per row, joined words, misreadings)."""
    stats = Statistics(df, text)
    seen = cut_lineage(inspect_rows(df, df.sparkSession.sparkContext.broadcast(stats.sure), key, text))
    joined = cut_lineage(joined_words(seen, stats))
    plain = seen.where("headers > 0 or pages > 0 or soft > 0").select("chunk_id", "headers", "pages", F.col("soft").alias("joined"))
    hyphens = joined.select("chunk_id", *[F.lit(0).alias(c) for c in ("headers", "pages")], F.col("times").cast("int").alias("joined"))
    per = plain.groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in ("headers", "pages", "joined")])
    cut = hyphens.groupBy("chunk_id").agg(F.lit(0).alias("headers"), F.lit(0).alias("pages"), F.sum("joined").cast("int").alias("joined"))
    layout = per.unionByName(cut).groupBy("chunk_id").agg(F.max("headers").alias("headers"), F.max("pages").alias("pages"), F.sum("joined").cast("int").alias("joined"))
    return layout, joined, misreadings(seen, joined, stats)


def noisy_rows(df: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """One row per noisy row: (chunk_id, headers, pages, joined, misread).

    Null and empty texts and rows with a null key give no row; repeated rows of a
    key count once. Texts with hard line breaks alone give none. Other columns
    play no part.
    """
    layout, _, found = _findings(df, key, text)
    read = found.groupBy("chunk_id").agg(F.countDistinct("token").cast("int").alias("misread"))
    zero = [F.lit(0).alias(c) for c in ("headers", "pages", "joined")]
    both = layout.withColumn("misread", F.lit(0)).unionByName(read.select("chunk_id", *zero, "misread"))
    return both.groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in ("headers", "pages", "joined", "misread")])


def _dress(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and len(letters) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() or (not like[:1].isalpha() and len(letters) > 1 and letters[0].isupper()) else word


_ENTRY = re.compile(r"(?:[-•*–]|\(?\w{1,3}[.)])\s|\s{2,}|[│├|]")


def reflow(text: str) -> str:
    """Undoes hard line breaks: prose runs on across them; blank lines, list entries, tables and short lines keep theirs.

    The width is that of the longer lines of prose; texts of wider lines have no hard breaks.
    """
    lines = text.split("\n")
    lengths = sorted(len(x) for x in lines if _prose(x))
    width = lengths[(len(lengths) - 1) * 3 // 4] if lengths else 0
    if len(lengths) < 2 or width > 120:
        return text
    out: list[str] = []
    before = ""
    for line in lines:
        joins = bool(out) and bool(before.strip()) and bool(line.strip()) and len(before) >= 0.6 * width and _prose(before) and _prose(line) and not _ENTRY.match(line)
        if joins:
            out[-1] = f"{out[-1].rstrip()} {line.strip()}"
        else:
            out.append(line)
        before = line
    return "\n".join(out)


def apply_fixes(text: str, decide: Decide, fixes: dict[str, str]) -> str:
    """Layout repair, corrections of the tokens, reflow."""
    body = clean_layout(text, decide)[0]

    def fix(m: re.Match) -> str:
        t = m.group()
        core = t.strip(_OUTER)
        word = fixes.get(core.lower())
        return t if word is None or not core else t.replace(core, _dress(word, core), 1)

    return reflow(re.sub(r"\S+", fix, body) if fixes else body)


REPAIRED = "chunk_id long, repaired string, headers int, pages int, joined int, misread int"


def repair_scans(df: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """The repaired text of every noisy row: continuous paragraphs without furniture, broken and misread words."""
    layout, joined, found = _findings(df, key, text)
    fixes = found.groupBy("chunk_id").agg(F.collect_set(F.struct("token", "word")).alias("fixes"))
    breaks = joined.groupBy("chunk_id").agg(F.collect_set(F.struct("whole", "hyphened", "capital")).alias("breaks"))
    ids = layout.join(fixes, "chunk_id", "full_outer").join(breaks, "chunk_id", "left")
    first = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("chunk_id"), F.col(text).alias("_text"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("headers", "pages", "joined")]
    j = first.join(ids, "chunk_id").dropDuplicates(["chunk_id"]).select("chunk_id", "_text", "fixes", "breaks", *zero)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, fx, br, h, p, jn in b.itertuples(index=False, name=None):
                own = {x["token"]: x["word"] for x in fx} if fx is not None else {}
                whole = {(x["whole"], x["hyphened"], x["capital"]) for x in br} if br is not None else set()
                rows.append((int(k), apply_fixes(t, lambda *x, whole=whole: x in whole, own), h, p, jn, len(own)))
            yield pd.DataFrame(rows, columns=["chunk_id", "repaired", "headers", "pages", "joined", "misread"])

    return j.mapInPandas(run, REPAIRED)
