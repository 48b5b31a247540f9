"""Text decoded with the wrong character encoding.

A hidden Markov model labels the characters of a text: one clean state, and one
state per encoding pair (the encoding the bytes were in, the one they were read
as). ASCII characters read alike in all of them and only carry the state on, so
the model works on the runs of other characters between them. A garbled state
emits a run with the probability of what the run's inverse transform gives; a
run that has no inverse there is possible only with a heavy charge for every
lost byte. Probabilities come from one table of character bigrams, in which
ASCII letters and digits are folded into classes.

The bigrams are learned from the corpus itself, by hard expectation
maximisation over the distinct runs and their neighbours: garbled occurrences
are counted as what they stand for. Runs are counted over all rows, and each
round labels and counts all of them in distributed tasks; the driver and the
broadcast hold only the resulting tables of bigrams and of runs between their
neighbours, both of a share of ``FLOOR`` and more, so at most 1/``FLOOR`` rows.
All thresholds are shares and ratios, so a text reads alike in corpora of any size.

Labelled spans are replaced by their inverse transform and read again, since a
text may have been garbled twice.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import cut_lineage, spread, widen

#: Encodings of the bytes and encodings they are read as (names of Python codecs).
TRUE = ("utf-8", "cp1252", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac-roman", "iso8859-5", "mac-cyrillic")
READ = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp866", "cp437", "cp850", "mac-roman")
PAIRS = tuple((a, b) for a in TRUE for b in READ if a != b and (a, b) not in {("cp1252", "latin-1")}) + tuple(("utf-8", f"{b}>utf-8>{c}") for b in ("cp1252", "latin-1") for c in ("cp1252", "latin-1"))
CLEAN, LOST = -1, -2
#: Least share of all bigrams, or of all runs, of an entry of the model.
FLOOR = 1e-6
ROUNDS = 4
#: Log probabilities: to enter a garbled state of UTF-8 or of another encoding, to leave it, per byte that cannot be restored.
ENTER_UTF8, ENTER_OTHER, LEAVE, LOSS = math.log(1e-2), math.log(1e-3), math.log(0.05), math.log(1e-5)
REREAD = 3
#: Where a garbled reading between the same two characters on either side is at least this share of all runs, that evidence counts, at a lower charge.
SEEN, ENTER_SEEN = 2e-5, math.log(1e-2)
#: ... if the run itself stands there so many times less often. SEEN / FEWER is not below FLOOR, so no run left out of the model could object.
FEWER = 20
UNKNOWN = 6.0

#: Longer runs are read piece by piece; a multiple of the lengths of UTF-8 characters.
PIECE = 240
_RUN = re.compile(rf"[^\x00-\x7f]{{1,{PIECE}}}")
_HIGH = "[^\\x00-\\x7f]"


def _fold(c: str) -> str:
    if not c or c in "\n\r\t":
        return " "
    if c > "\x7f":
        return c
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c


@lru_cache(maxsize=64)
def _table(codec: str) -> tuple[dict[str, int], dict[int, str]]:
    """Characters to bytes and back; bytes without a character stand for the control of that number."""
    to, back = {}, {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        to.setdefault(c, b)
        back[b] = c
    return to, back


def inverse(run: str, pair: tuple[str, str]) -> tuple[str, int] | None:
    """(what the run stands for, how much was lost); None if it cannot have come from this pair."""
    true, read = pair
    if ">" in read:
        outer, _, inner = read.rpartition(">utf-8>")
        once = inverse(run, ("utf-8", inner))
        return None if once is None or once[1] or once[0].isascii() else inverse(once[0], ("utf-8", outer))
    to = _table(read)[0]
    data = bytearray()
    for c in run:
        b = to.get(c)
        if b is None:
            return None
        data.append(b)
    if true != "utf-8":
        back = _table(true)[1]
        return "".join(back[b] for b in data), 0
    text = bytes(data).decode("utf-8", "replace")
    lost = text.count("�")
    return None if lost == len(text) and len(data) > 1 else (text, lost)


@lru_cache(maxsize=20_000)
def readings(run: str) -> tuple[tuple[int, str, int], ...]:
    """(pair's number, what the run stands for, how much was lost) of every pair that it can have come from."""
    return tuple((s, *inv) for s, pair in enumerate(PAIRS) if (inv := inverse(run, pair)))


def _near(s: str) -> str:
    """Neighbouring characters as they take part in exact contexts: lower case, one digit, one blank."""
    return "".join("0" if c.isdigit() else " " if c.isspace() else c for c in s.lower())


class Model:
    """Bigram log probabilities of clean text, counts of runs between their neighbours, and emission scores of runs."""

    def __init__(self, bigrams: dict[tuple[str, str], float], exact: dict[tuple[str, str, str], int] | None = None, runs: int = 0) -> None:
        self.exact, self.runs = exact or {}, runs
        total: Counter = Counter()
        for (a, _), n in bigrams.items():
            total[a] += n
        self.p = {k: math.log((n + 0.01) / (total[k[0]] + 50.0)) for k, n in bigrams.items()}
        self.unseen = {a: math.log(0.01 / (n + 50.0)) for a, n in total.items()}
        self.never = math.log(0.01 / 50.0)
        self.scores: dict[tuple[str, str, str], dict[int, float]] = {}
        self.logs: dict[tuple[str, str, str], float] = {}

    def log(self, left: str, run: str, right: str) -> float:
        key = (_fold(left[-1:]), run, _fold(right[0]) if right else "")
        got = self.logs.get(key)
        if got is None:
            if len(self.logs) > 300_000:
                self.logs.clear()
            got, a = 0.0, key[0]
            for c in (*run, key[2]) if right else run:
                k = (a, c) if c > "\x7f" else (a, _fold(c))
                p = self.p.get(k)
                got += p if p is not None else self.unseen.get(a, self.never)
                a = k[1]
            self.logs[key] = got
        return got

    def relative(self, left: str, run: str, right: str) -> dict[int, float]:
        """Score over the clean state's, of all states that can explain the run at all well.

        A reading that is known to stand between these neighbours outdoes those
        that are not by ``UNKNOWN``.
        """
        key = (left, run, right)
        got = self.scores.get(key)
        if got is None:
            if len(self.scores) > 50_000:
                self.scores.clear()
            if "�" in run:
                got = {LOST: 50.0}
            else:
                clean, got, known = self.log(left, run, right), {}, set()
                for s, text, lost in readings(run):
                    x = self.log(left, text.replace("�", ""), right) + LOSS * lost - clean
                    if not lost and (seen := self._seen(key, text, s)) > -math.inf:
                        known.add(s)
                        x = max(x, seen)
                    if x > -12:
                        got[s] = x
                if known:
                    got = {s: x if s in known else x - UNKNOWN for s, x in got.items()}
            self.scores[key] = got
        return got

    def _seen(self, key: tuple[str, str, str], text: str, s: int) -> float:
        """Score by how often the reading and the run itself stand between these neighbours."""
        left, run, right = _near(key[0]), key[1], _near(key[2])
        n, own = self.exact.get((left, text, right), 0), self.exact.get((left, run, right), 0)
        if not n or n < SEEN * self.runs or n < FEWER * own or text == run or len(right) < 2:
            return -math.inf
        return math.log(n / max(own + 0.5, FLOOR * self.runs)) + ENTER_SEEN - _enter(s)


def contexts(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, left, run, right) of every run of characters beyond ASCII, with the two characters on either side; at the text's end, where words may be cut, fewer."""
    return [(m.start(), m.end(), text[max(0, m.start() - 2) : m.start()] or " ", m.group(), text[m.end() : m.end() + 2]) for m in _RUN.finditer(text)]


def _enter(s: int) -> float:
    return 0.0 if s == LOST else ENTER_UTF8 if PAIRS[s][0] == "utf-8" else ENTER_OTHER


def label(text: str, model: Model) -> list[tuple[int, int, int]]:
    """(start, end, state) of the runs that are not clean, by the Viterbi path."""
    runs = contexts(text)
    rel = [model.relative(*r[2:]) for r in runs]
    states = {s for r in rel for s, x in r.items() if x > 0}
    if not states:
        return []
    best: dict[int, tuple[float, tuple | None]] = {CLEAN: (0.0, None)}
    for i, r in enumerate(rel):
        step: dict[int, tuple[float, tuple | None]] = {}
        garbled = max(((x, c) for s, (x, c) in best.items() if s != CLEAN), key=lambda t: t[0], default=(-math.inf, None))
        stay = best.get(CLEAN, (-math.inf, None))
        if LOST not in r:
            step[CLEAN] = stay if stay[0] >= garbled[0] + LEAVE else (garbled[0] + LEAVE, garbled[1])
        for s in states:
            if s not in r:
                continue
            come = max((stay[0] + _enter(s), stay[1]), (garbled[0] + LEAVE + _enter(s), garbled[1]), best.get(s, (-math.inf, None)), key=lambda t: t[0])
            step[s] = (come[0] + r[s], (i, s, come[1]))
        best = step
    chain = max(best.values(), key=lambda t: t[0])[1]
    out = []
    while chain:
        i, s, chain = chain
        out.append((runs[i][0], runs[i][1], s))
    return out[::-1]


def restore(text: str, model: Model) -> tuple[str, list[str], bool]:
    """(restored text, the pairs found in order, whether something stays lost)."""
    pairs: list[str] = []
    lost = False
    for _ in range(REREAD):
        spans = label(text, model)
        if not spans:
            break
        parts, at = [], 0
        for a, b, s in spans:
            parts.append(text[at:a])
            if s == LOST:
                lost = True
                parts.append(text[a:b])
                name = "lost"
            else:
                new, gone = inverse(text[a:b], PAIRS[s])
                lost |= gone > 0
                parts.append(text[a:b] if gone else new)
                name = f"{PAIRS[s][0]}>{PAIRS[s][1]}"
            if name not in pairs:
                pairs.append(name)
            at = b
        new = "".join(parts) + text[at:]
        if new == text:
            break
        text = new
    return text, pairs, lost


def tally(counts: Iterable[tuple[tuple[str, str, str], int]], model: Model | None) -> tuple[Counter, Counter]:
    """(bigrams, runs between their neighbours) of contexts, garbled ones counted as what the model says they stand for; without a model all are clean."""
    bigrams: Counter = Counter()
    exact: Counter = Counter()
    for (left, run, right), n in counts:
        if "�" in run:
            continue
        if model:
            x, s = max(((x + _enter(s), s) for s, x in model.relative(left, run, right).items()), default=(0.0, CLEAN))
            if x > 0 and s >= 0:
                inv = inverse(run, PAIRS[s])
                if not inv or inv[1]:
                    continue
                run = inv[0]
        exact[_near(left), run, _near(right)] += n
        a = _fold(left[-1:])
        for c in (*run, right[0]) if right else run:
            c = _fold(c)
            bigrams[a, c] += n
            a = c
    return bigrams, exact


def train(counts: dict[tuple[str, str, str], int]) -> Model:
    """Hard expectation maximisation over distinct runs and their neighbours, in one process."""
    model = None
    for _ in range(ROUNDS):
        bigrams, exact = tally(counts.items(), model)
        model = Model(bigrams, exact, sum(counts.values()))
    return model


def count_contexts(df: DataFrame, text: str = "body") -> DataFrame:
    """(l, run, r, n): how often each run of characters beyond ASCII stands between its neighbours, over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b[text]:
                c.update(x[2:] for x in contexts(t))
            if len(c) > 100_000:
                yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["l", "run", "r", "n"])
                c.clear()
        yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["l", "run", "r", "n"])

    part = widen(df.where(F.col(text).rlike(_HIGH)).select(text), text).mapInPandas(run, "l string, run string, r string, n long")
    return part.groupBy("l", "run", "r").agg(F.sum("n").alias("n"))


def _counted(counted: DataFrame, model: Model | None) -> DataFrame:
    """(kind, a, b, c, n): the tally of all contexts as ``b`` rows (bigrams a, b) and ``e`` rows (runs b between a and c)."""
    shared = counted.sparkSession.sparkContext.broadcast(None if model is None else (model.p, model.unseen, model.exact, model.runs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        if shared.value is not None:
            own = Model({})
            own.p, own.unseen, own.exact, own.runs = shared.value
        for b in batches:
            bigrams, exact = tally((((l, r, t), n) for l, r, t, n in b.itertuples(index=False, name=None)), own)
            rows = [("b", x, y, "", n) for (x, y), n in bigrams.items()] + [("e", *k, n) for k, n in exact.items()]
            yield pd.DataFrame(rows, columns=["kind", "a", "b", "c", "n"])

    return counted.select("l", "run", "r", "n").mapInPandas(run, "kind string, a string, b string, c string, n long").groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "body") -> Model:
    """The model of all rows of ``df``, by distributed rounds of labelling and counting."""
    counted = cut_lineage(spread(count_contexts(df, text), "l", "run", "r"))
    runs = counted.agg(F.sum("n")).first()[0] or 0
    model = None
    for _ in range(ROUNDS):
        got = _counted(counted, model).persist()
        total = got.where("kind = 'b'").agg(F.sum("n")).first()[0] or 0
        kept = got.where(F.col("n") >= FLOOR * F.when(F.col("kind") == "b", total).otherwise(runs)).toPandas()
        got.unpersist()
        rows = kept.itertuples(index=False, name=None)
        bigrams, exact = {}, {}
        for kind, a, b, c, n in rows:
            if kind == "b":
                bigrams[a, b] = int(n)
            else:
                exact[a, b, c] = int(n)
        model = Model(bigrams, exact, runs)
    return model


FIXED = "chunk_id long, restored string, pairs array<string>, lost boolean"


def repair(df: DataFrame, key: str = "id", text: str = "body", model: Model | None = None) -> DataFrame:
    """Rows whose text was garbled: (chunk_id, restored text, encoding pairs, whether something stays lost).

    Null and empty texts, texts of ASCII only and clean texts give no row, nor do
    rows with a null key. Repeated rows give repeated results. What cannot be
    restored stays as it was, with ``lost`` set. Other columns play no part.
    """
    m = model or learn(df, text)
    shared = df.sparkSession.sparkContext.broadcast((m.p, m.unseen, m.exact, m.runs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model({})
        own.p, own.unseen, own.exact, own.runs = shared.value
        for b in batches:
            rows = []
            for k, t in b.itertuples(index=False, name=None):
                new, pairs, lost = restore(t, own)
                if pairs:
                    rows.append((int(k), new, pairs, lost))
            yield pd.DataFrame(rows, columns=["chunk_id", "restored", "pairs", "lost"])

    return widen(df.where(F.col(key).isNotNull() & F.col(text).rlike(_HIGH)).select(key, text), key).mapInPandas(run, FIXED)
