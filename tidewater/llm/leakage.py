"""Evaluation texts leaking into training text.

Latent semantic retrieval. Passages are windows of ``WINDOW`` words, weighted by
TF-IDF with the document frequencies of the whole corpus. A randomised SVD over
the items' windows and the corpus' windows of which at least ``KNOWN`` words
belong to the item vocabulary (one pass: every task multiplies its part of the
Gram matrix with the same random matrix, the products are added up, and a Nystrom
step gives the right singular vectors) yields a latent space of ``RANK``
dimensions. Passages of documents and items that are near each other in it by
cosine are candidates. They are found through buckets: signs of ``BITS`` random
projections of the latent vector, in ``TABLES`` tables; only passages that share
a bucket are compared.

Each candidate places an item beside a document. There the longest run of equal
words is counted (``find_leaks``), and for paraphrases the longest common
subsequence of the item with that part of the document (``find_paraphrases``),
and whether the item's answer stands in the document.

A common run of ``RUN`` words contains, wherever it starts, a whole window of
the document's partition into windows of half that length, so disjoint document
windows and all item windows suffice. Equal windows have equal signs, whole
numbers being added up, and a cosine of 1: no leak is lost to the buckets.

The items are a small stated query set; they are taken in blocks of at most
``BLOCK_WORDS`` words, each block compared with all rows, so what is broadcast is
bounded at any size of the item set. Nothing of the documents is collected; the
driver sees sums over the item vocabulary only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import cut_lineage, widen

RUN = 12
WINDOW = (RUN + 1) // 2
RANK = 128
OVERSAMPLE = 8
#: Words of a window that items must know for it to be a passage.
KNOWN = WINDOW // 2
#: Least cosine of a candidate; signs per bucket, and tables of buckets.
COSINE, BITS, TABLES = 0.85, 16, 12
#: Share of an item's words that a paraphrase holds in order.
SHARE = 0.6
BLOCK_WORDS = 100_000
SEED = 7
_CHUNKS = 64
_ROWS = 4096

_WORD = re.compile(r"[^\W_]+")
_ANSWER = re.compile(r"\banswer\s*[:=]\s*(.+)", re.I | re.S)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case; none for null."""
    return _WORD.findall((text or "").lower())


class Items:
    """A block of held-out items: vocabulary, word ids and windows."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in rows]
        self.words = [words_of(t) for _, t in rows]
        self.vocabulary: dict[str, int] = {}
        for ws in self.words:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.codes = [np.array([self.vocabulary[w] for w in ws], np.int32) for ws in self.words]
        self.answers = [words_of(m.group(1)) if (m := _ANSWER.search(t or "")) else [] for _, t in rows]
        at: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, c in enumerate(self.codes):
            if len(c) >= RUN:
                for p in range(len(c) - WINDOW + 1):
                    at[tuple(c[p : p + WINDOW].tolist())].append((k, p))
        self.windows = np.array(list(at), np.int32).reshape(-1, WINDOW)
        self.places = list(at.values())


def _codes(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """Word ids of a text, -1 for words that no item has."""
    get = vocabulary.get
    return np.array([get(w, -1) for w in words_of(text)], np.int32)


def _blocks(codes: np.ndarray) -> np.ndarray:
    n = len(codes) // WINDOW
    return codes[: n * WINDOW].reshape(n, WINDOW)


CODED = "key long, codes binary, words int"


def encode_words(df: DataFrame, key: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """(key, codes, words): every text once as the ids of its words in the item vocabulary, -1 for others; texts without any such word have no codes.

    A text's words are read once; all later steps work on the ids.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for b in batches:
            rows = []
            for k, t in b.itertuples(index=False, name=None):
                c = _codes(t, v)
                rows.append((k, c.tobytes() if (c >= 0).any() else None, len(c)))
            yield pd.DataFrame(rows, columns=["key", "codes", "words"])

    return widen(df.select(F.col(key).cast("long").alias("key"), text), "key").mapInPandas(run, CODED)


def document_frequencies(coded: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(documents that contain each word, all documents), over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(n + 1, np.int64)
        for b in batches:
            for c in b["codes"]:
                if c is not None:
                    u = np.unique(np.frombuffer(c, np.int32))
                    seen[u[u >= 0]] += 1
            seen[n] += len(b)
        at = np.nonzero(seen)[0]
        yield pd.DataFrame({"w": at.astype(np.int32), "n": seen[at]})

    counts = coded.select("codes").mapInPandas(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n + 1)
    for r in counts:
        out[r.w] = r.n
    return out[:n], int(out[n])


def latent_space(coded: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF passages of all rows and items, by a randomised SVD."""
    n = len(items.vocabulary)
    k = min(rank + OVERSAMPLE, n)
    omega = np.random.default_rng(SEED).standard_normal((n, k))
    shared = coded.sparkSession.sparkContext.broadcast((idf, omega))

    def product(windows: np.ndarray, weights: np.ndarray, om: np.ndarray, into: np.ndarray) -> None:
        """Adds (A'A) om of these passages."""
        windows, back = _distinct(windows)
        times = np.bincount(back, minlength=len(windows))
        for i in range(0, len(windows), 8192):
            w = windows[i : i + 8192]
            x = np.where(w >= 0, weights[w], 0.0)
            y = np.einsum("ij,ijk->ik", x, om[w]) * times[i : i + 8192, None]
            flat = w.ravel()
            order = np.argsort(flat, kind="stable")
            order = order[np.searchsorted(flat[order], 0) :]
            known = flat[order]
            first = np.nonzero(np.diff(known, prepend=-1))[0]
            if len(known):
                into[known[first]] += np.add.reduceat(x.ravel()[order, None] * y[order // WINDOW], first, axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, om = shared.value
        acc = np.zeros_like(om)
        for b in batches:
            w = _passages(b["codes"])[0]
            product(w, weights, om, acc)
        yield pd.DataFrame({"chunk": range(_CHUNKS), "data": [acc[c::_CHUNKS].tobytes() for c in range(_CHUNKS)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d, np.float64) for d in pdf.data)
        return pd.DataFrame({"chunk": [pdf.chunk.iloc[0]], "data": [total.tobytes()]})

    kind = "chunk int, data binary"
    y = np.zeros_like(omega)
    product(items.windows, idf, omega, y)
    for r in coded.where("codes is not null").select("codes").mapInPandas(run, kind).groupBy("chunk").applyInPandas(add, kind).collect():
        y[r.chunk :: _CHUNKS] += np.frombuffer(r.data, np.float64).reshape(-1, k)
    shift = 1e-9 * max(np.linalg.norm(y), 1e-30)
    y += shift * omega
    core = omega.T @ y
    low = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(k))
    u, _, _ = np.linalg.svd(np.linalg.solve(low, y.T).T, full_matrices=False)
    return u[:, :rank]


def _passages(codes: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(windows of at least ``KNOWN`` known words, their document in the batch, their first word, all documents' codes)."""
    docs = [np.frombuffer(c, np.int32) for c in codes]
    cut = [_blocks(c) for c in docs]
    owner = np.repeat(np.arange(len(docs)), [len(c) for c in cut])
    place = np.concatenate([np.arange(len(c)) for c in cut] or [np.zeros(0, int)]) * WINDOW
    w = np.concatenate(cut or [np.zeros((0, WINDOW), np.int32)])
    own = (w >= 0).sum(1) >= KNOWN
    return w[own], owner[own], place[own], docs


def _distinct(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct windows, the number of each window among them)."""
    whole = np.ascontiguousarray(windows).view(np.dtype((np.void, windows.dtype.itemsize * WINDOW))).ravel()
    _, first, back = np.unique(whole, return_index=True, return_inverse=True)
    return windows[first], back.ravel()


class Buckets:
    """Latent vectors of the items' windows, and which of them share the signs of their projections."""

    def __init__(self, windows: np.ndarray, loadings: np.ndarray) -> None:
        self.windows = windows
        self.loadings = np.vstack([loadings, np.zeros((1, loadings.shape[1]))]).astype(np.float32)  # the last row stands for unknown words
        planes = np.random.default_rng(SEED).standard_normal((loadings.shape[1], BITS * TABLES))
        signs = self.loadings @ planes
        self.signs = np.rint(signs * ((1 << 24) / max(np.abs(signs).max(initial=0.0), 1e-30))).astype(np.int32)
        self.vectors = self._vectors(windows)
        codes = self._codes(windows)
        self.order = np.argsort(codes, axis=0, kind="stable")
        at = np.arange(1 << BITS)
        listed = np.take_along_axis(codes, self.order, 0)
        self.start = np.stack([np.searchsorted(listed[:, t], at) for t in range(TABLES)])
        self.stop = np.stack([np.searchsorted(listed[:, t], at, "right") for t in range(TABLES)])

    def _vectors(self, windows: np.ndarray) -> np.ndarray:
        x = self.loadings[windows[:, 0]].copy()
        for j in range(1, WINDOW):
            x += self.loadings[windows[:, j]]
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1.0)

    def _codes(self, windows: np.ndarray) -> np.ndarray:
        """Bucket of each window in each table."""
        x = self.signs[windows[:, 0]].copy()
        for j in range(1, WINDOW):
            x += self.signs[windows[:, j]]
        return np.packbits(x > 0, axis=1).view(np.dtype(f"u{BITS // 8}"))

    def candidates(self, windows: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window numbers, item window numbers) of the pairs that share a bucket and whose cosine reaches the threshold."""
        n = len(self.windows)
        own, back = _distinct(windows)
        order = np.argsort(back, kind="stable")
        stop = np.cumsum(np.bincount(back, minlength=len(own)))
        for i in range(0, len(own), _ROWS):
            w = own[i : i + _ROWS]
            codes = self._codes(w)
            met = []
            for t in range(TABLES):
                lo, hi = self.start[t, codes[:, t]], self.stop[t, codes[:, t]]
                k = hi - lo
                if k.any():
                    who = np.repeat(np.arange(len(w)), k)
                    nth = np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)
                    met.append(who * n + self.order[nth, t])
            if not met:
                continue
            a, b = np.divmod(np.unique(np.concatenate(met)), n)
            near = np.einsum("ij,ij->i", self._vectors(w)[a], self.vectors[b]) >= cosine - 1e-4
            a, b = a[near] + i, b[near]
            k = stop[a] - np.where(a > 0, stop[a - 1], 0)  # all windows equal to each distinct one
            if len(a):
                yield order[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(stop[a] - k, k)], np.repeat(b, k)


def longest_runs(docs: list[np.ndarray], items: list[np.ndarray], beside: np.ndarray) -> np.ndarray:
    """For rows (document, item, shift) the longest run of equal words with the item's first word beside word ``shift`` of the document."""
    flat = np.concatenate(docs)
    size = np.array([len(d) for d in docs])
    start = np.cumsum(size) - size
    width = max((len(c) for c in items), default=0)
    grid = np.full((len(items), width), -2, np.int32)
    for k, c in enumerate(items):
        grid[k, : len(c)] = c
    out = np.zeros(len(beside), np.int64)
    for i in range(0, len(beside), 1 << 16):
        d, k, shift = beside[i : i + (1 << 16)].T
        run = np.zeros(len(d), np.int64)
        most = out[i : i + (1 << 16)]
        for j in range(width):
            at = shift + j
            inside = (at >= 0) & (at < size[d])
            same = inside & (flat[np.where(inside, start[d] + at, 0)] == grid[k, j])
            run = (run + 1) * same
            np.maximum(most, run, out=most)
    return out


def common_words(doc: np.ndarray, item: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    bits: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        bits[w] |= 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in doc.tolist():
        u = v & bits.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


LEAKS = "doc_id long, item_id long, run int, common int, share double, answer boolean"


def _item_blocks(items: DataFrame) -> Iterator[Items]:
    rows, size = [], 0
    for r in items.where("item_id is not null").select("item_id", "text").toLocalIterator():
        rows.append((r.item_id, r.text))
        size += len(words_of(r.text))
        if size >= BLOCK_WORDS:
            yield Items(rows)
            rows, size = [], 0
    yield Items(rows)


def retrieve(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", cosine: float = COSINE, loose: bool = False) -> DataFrame:
    """Documents near an item: (doc_id, item_id, longest run, longest common subsequence, its share of the item, whether the item's answer is in the document).

    Rows are those with a run of ``RUN`` words or, if ``loose``, a common
    subsequence of ``SHARE`` of the item; without ``loose``, subsequences are not
    counted and read 0. Null and empty texts and rows with null keys give no row;
    of an item listed twice each text counts. Items shorter than ``RUN`` words
    are not sought. Repeated document rows give repeated results.
    """
    out = None
    for own in _item_blocks(items):
        if len(own.windows):
            found = _near(df, own, key, text, cosine, loose)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else df.sparkSession.createDataFrame([], LEAKS)


def find_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that contain at least ``RUN`` consecutive words of an item; see ``retrieve``."""
    return retrieve(df, items, key, text)


def find_paraphrases(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", cosine: float = COSINE) -> DataFrame:
    """Documents that hold ``SHARE`` of an item's words in order, but no run of ``RUN`` of them; see ``retrieve``.

    Retrieval is approximate here: a paraphrase all of whose windows stay below the
    cosine, or share no bucket, is missed.
    """
    return retrieve(df, items, key, text, cosine, True).where(F.col("run") < RUN)


def _near(df: DataFrame, items: Items, key: str, text: str, cosine: float, loose: bool) -> DataFrame:
    coded = cut_lineage(encode_words(df, key, text, items.vocabulary))
    seen, total = document_frequencies(coded, len(items.vocabulary))
    idf = np.log((total + 1.0) / (seen + 1.0)) + 1.0
    loadings = latent_space(coded, items, idf) * idf[:, None]
    answers = [np.array([items.vocabulary[w] for w in a], np.int32) for a in items.answers]
    shared = df.sparkSession.sparkContext.broadcast((items.ids, items.codes, items.windows, items.places, answers, loadings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, codes, windows, places, asked, load = shared.value
        buckets = Buckets(windows, load)
        held = np.array([len(x) for x in places])
        first = np.cumsum(held) - held
        at_item, at_word = np.array([x for p in places for x in p]).T
        for b in batches:
            w, owner, place, docs = _passages(b["codes"])
            near = [np.stack([owner[a], place[a], q], 1) for a, q in buckets.candidates(w, cosine)]
            rows = []
            if near:
                d, x, q = np.concatenate(near).T
                times = held[q]
                nth = np.repeat(first[q], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                beside = np.unique(np.stack([np.repeat(d, times), at_item[nth], np.repeat(x, times) - at_word[nth]], 1), axis=0)
                rows = _checked(docs, codes, beside, loose)
            keys = b["key"].tolist()
            rows = [(int(keys[d]), ids[k], run, common, common / len(codes[k]), _contains(docs[d], asked[k])) for d, k, run, common in rows]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "common", "share", "answer"])

    return coded.where("key is not null and codes is not null").select("key", "codes").mapInPandas(run, LEAKS)


def _checked(docs: list[np.ndarray], items: list[np.ndarray], beside: np.ndarray, loose: bool) -> list[tuple[int, int, int, int]]:
    """(document, item, longest run, common words) of the pairs that leak, from rows (document, item, shift) sorted by pair."""
    runs = longest_runs(docs, items, beside)
    edge = np.nonzero((np.diff(beside[:, :2], axis=0, prepend=-1) != 0).any(1))[0]
    out = []
    for a, b, most in zip(edge.tolist(), [*edge[1:].tolist(), len(beside)], np.maximum.reduceat(runs, edge).tolist(), strict=True):
        d, k = int(beside[a, 0]), int(beside[a, 1])
        common = 0
        if loose and most < RUN and np.isin(items[k], docs[d]).sum() >= SHARE * len(items[k]):
            item, slack = items[k], len(items[k]) // 4 + 1
            lo, hi = int(beside[a:b, 2].min()) - slack, int(beside[a:b, 2].max()) + len(item) + slack
            if hi - lo <= 2 * (len(item) + 2 * slack):
                common = common_words(docs[d][max(0, lo) : hi], item)
            else:
                common = max(common_words(docs[d][max(0, s - slack) : s + len(item) + slack], item) for s in beside[a:b, 2].tolist())
        if most >= RUN or common >= SHARE * len(items[k]):
            out.append((d, k, most, common))
    return out


def _contains(doc: np.ndarray, part: np.ndarray) -> bool:
    """Whether the words of ``part`` stand consecutively in the document; an empty part does not."""
    if not len(part) or len(part) > len(doc):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(doc, len(part)) == part).all(1).any())
