"""Splitting oversized texts at natural boundaries.

Agglomerative merging: the text is cut into atomic segments (words with the
blanks after them); every boundary between neighbours has a strength, from
within a word up to a paragraph break. Adjacent pairs wait in a heap, and the
weakest boundary is merged first as long as the combined size plus the overlap
fits the limit. What cannot merge any more are the pieces. Concatenating the
pieces without their overlaps gives the text back exactly.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import spread

LIMIT = 4000
OVERLAP = 200

_ATOM = re.compile(r"\s*\S+\s*|\s+")
_SENTENCE_END = re.compile(r"[.!?…。！？][)\]\"'’”»]*\s+$")
_CLAUSE_END = re.compile(r"[;:,–—，；：]\s+$")


#: A run without blanks that is longer than this is cut after its own separators.
_LONG = 100
_PART = re.compile(r"[^|;,。！？]*(?:[|;,。！？]+|\Z)")


def _strength(left: str) -> float:
    """Of the boundary after ``left``: 0 inside a word, 1 word, 2 clause, 3 sentence, 4 line, 5 paragraph.

    Separators inside a run without blanks count 0.5, a bar 1, a full-width stop 3.
    """
    if not left:
        return 0
    if not left[-1].isspace():
        return {"|": 1, ";": 0.5, ",": 0.5, "。": 3, "！": 3, "？": 3}.get(left[-1], 0)
    tail = left[len(left.rstrip()):]
    breaks = tail.count("\n")
    if breaks:
        return 5 if breaks > 1 else 4
    return 3 if _SENTENCE_END.search(left) else 2 if _CLAUSE_END.search(left) else 1


def _atoms(text: str, most: int) -> list[str]:
    out = []
    for m in _ATOM.finditer(text):
        a = m.group()
        for p in [a] if len(a) <= _LONG else filter(None, _PART.findall(a)):
            out += [p[i : i + most] for i in range(0, len(p), most)]
    return out


def segments(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """Consecutive segments of at most ``limit - overlap`` characters whose concatenation is ``text``.

    A text within the limit is one segment; an empty text is none. A word longer
    than a segment is cut inside.
    """
    if limit <= overlap:
        raise ValueError("the limit must exceed the overlap")
    if len(text) <= limit:
        return [text] if text else []
    most = limit - overlap
    part = _atoms(text, most)
    n = len(part)
    size = [len(p) for p in part]
    after = [_strength(p) for p in part]
    right = list(range(1, n)) + [-1]
    left = [-1, *range(n - 1)]
    end = list(range(n))
    version = [0] * n
    heap = [(after[i], size[i] + size[i + 1], i, 0, 0) for i in range(n - 1) if size[i] + size[i + 1] <= most]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, total, i, vi, vj = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or version[i] != vi or version[j] != vj or size[i] + size[j] != total:
            continue
        size[i], end[i], after[i] = total, end[j], after[j]
        right[i] = right[j]
        alive[j] = False
        version[i] += 1
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and size[a] + size[b] <= most:
                heapq.heappush(heap, (after[a], size[a] + size[b], a, version[a], version[b]))
    return ["".join(part[i : end[i] + 1]) for i in range(n) if alive[i]]


def tail(piece: str, overlap: int = OVERLAP) -> str:
    """The last ``overlap`` characters or fewer, from the strongest boundary in them if there is one."""
    if overlap <= 0:
        return ""
    if len(piece) <= overlap:
        return piece
    cut = piece[-overlap:]
    best, start = min(3, _strength(piece[-overlap - 80 : -overlap])), 0
    for m in re.finditer(r"\S*\s+|[^\s|;,]*[|;,]+", cut):
        at = m.end()
        s = min(_strength(cut[max(0, at - 80) : at]), 3)
        if s > best and at < len(cut):
            best, start = s, at
    return cut[start:]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """[(piece, length of its overlap)]; every piece has at most ``limit`` characters."""
    out: list[tuple[str, int]] = []
    for s in segments(text, limit, overlap):
        head = tail(out[-1][0], overlap) if out else ""
        out.append((head + s, len(head)))
    return out


PIECES = "chunk_id long, part int, parts int, title string, piece string, overlap_chars int"


def split_oversized(df: DataFrame, key: str = "id", title: str = "title", body: str = "body", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every body longer than ``limit``: (chunk_id, part from 1, parts, title with part number, piece, overlap_chars).

    Only oversized bodies reach Python. Null and short bodies give no rows, and
    rows with a null key none. Repeated rows of one key with equal title and body
    count once. A null or blank title becomes ``(part n)`` alone. Characters are
    code points. Other columns play no part.
    """
    big = df.where(F.col(key).isNotNull() & (F.char_length(body) > limit)).select(F.col(key).alias("k"), F.col(title).alias("t"), F.col(body).alias("b"))
    big = spread(big, "k").dropDuplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, text in b.itertuples(index=False, name=None):
                pieces = split_text(text, limit, overlap)
                name = t.strip() if isinstance(t, str) else ""
                rows += [(int(k), i, len(pieces), f"{name} (part {i})".strip(), p, n) for i, (p, n) in enumerate(pieces, 1)]
            yield pd.DataFrame(rows, columns=["chunk_id", "part", "parts", "title", "piece", "overlap_chars"])

    return big.mapInPandas(run, PIECES)
