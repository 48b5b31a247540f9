"""The encoder against a public implementation, appends and edits."""

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.tokenizing import PATTERN, TOKENIZERS, VOCABULARY, PrefixTable, encode_corpus, vocabulary

PATH = os.path.join(TOKENIZERS, VOCABULARY)
tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_equals_public(public, text):
    text = text.encode("utf-8", "ignore").decode()
    v = vocabulary(PATH)
    assert v.encode(text) == public.encode_ordinary(text)
    assert v.decode(v.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 3000, "  \n\n\t ", "don't they'LL 123456", "Zrębowo № 17 船舶", "﻿\x07"])
def test_special_cases(public, text):
    assert vocabulary(PATH).encode(text) == public.encode_ordinary(text)


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.binary(max_size=10), st.data())
def test_appends_and_edits(a, b, data):
    v = vocabulary(PATH)
    t = PrefixTable(v, a)
    before = list(t.last)
    t.append(b)
    assert t.last[: len(a)] == before and t.ids() == v.merge(a + b)
    i = data.draw(st.integers(0, len(a)))
    j = data.draw(st.integers(i, len(a + b)))
    new = data.draw(st.binary(max_size=6))
    whole = (a + b)[:i] + new + (a + b)[j:]
    t.edit(i, j, new)
    assert t.ids() == (v.merge(whole) if whole else [])


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (None, "a", "x"), (4, "hold " * 20000, "x"), (4, "hold", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, len(r.ids)) for r in encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (3, 1), (None, 1), (4, 20001), (4, 1)], key=str) or dict(got)[1] == dict(got)[2] == 0
    assert encode_corpus(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert encode_corpus(df.where("false")).count() == 0
