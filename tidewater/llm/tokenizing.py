"""Encoding texts by a public byte-level BPE vocabulary.

Prefix dynamic programming: every byte prefix of a word has exactly one valid
last token - the last token of the prefix's own encoding - so a table of last
tokens, one per prefix, holds the encodings of all prefixes at once. Appending
bytes extends the table; after an edit the table is cut back to the edit and
extended again. A token ``t`` ending at byte ``i`` is the valid last token iff
it follows the last token ``p`` of the prefix before it in a valid pair, that is,
if merging the bytes of ``p`` and ``t`` gives ``p, t`` again.

Words come from the vocabulary's public split pattern. Encoded words and pairs
are kept in bounded caches of each Python worker; a map-only job, no shuffle.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tidewater.session import widen

#: Where the public vocabulary files lie; a parameter everywhere below.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The split pattern published with the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept in a worker's caches before they are emptied.
CACHE = 200_000


class Vocabulary:
    """Token bytes and ranks, pair validity and prefix tables."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.words = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a few bytes by merging the lowest-ranked neighbours first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def valid(self, first: int, second: int) -> bool:
        """Whether ``second`` may follow ``first`` in an encoding."""
        key = (first, second)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.bytes[first] + self.bytes[second]) == [first, second]
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            data = word.encode("utf-8", "surrogatepass")
            whole = self.rank.get(data)
            known = (whole,) if whole is not None else tuple(PrefixTable(self, data).ids())
            if len(word) <= 64:
                self.cache[word] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        """Token ids; none for null and empty texts. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if text:
            encode = self.encode_word
            for w in self.words.findall(text):
                out += encode(w)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes[i] for i in ids)


class PrefixTable:
    """The unique valid last token of every byte prefix of one word."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extends the word; what is in the table stays as it is."""
        start = len(self.data)
        self.data += more
        data, last, rank, valid = self.data, self.last, self.v.rank, self.v.valid
        for i in range(start + 1, len(data) + 1):
            for j in range(max(0, i - self.v.longest), i):
                t = rank.get(data[j:i])
                if t is not None and (j == 0 or valid(last[j - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces bytes ``start`` to ``end``; only prefixes beyond ``start`` are encoded again."""
        rest = new + self.data[end:]
        self.data = self.data[:start]
        del self.last[start:]
        self.append(rest)

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i - 1])
            i -= len(self.v.bytes[self.last[i - 1]])
        return out[::-1]


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str = PATTERN) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path, pattern)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(key, ids array of int): every row's text encoded whole, without special tokens.

    Null and empty texts give an empty list, blank texts are encoded as they are.
    Each input row gives one row; rows with a null key too. Other columns are
    dropped. Map-only. The vocabulary file is read where the driver runs and sent
    to the executors.
    """
    at = path or os.path.join(TOKENIZERS, VOCABULARY)
    df.sparkSession.sparkContext.addFile(at)  # executors need not have the folder
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(os.path.basename(at)), pattern)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1).to_pylist():
                flat += v.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return widen(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
