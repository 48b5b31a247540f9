"""Leaks against brute force."""

import random

import numpy as np

from tidewater.llm import leakage
from tidewater.llm.leakage import RUN, SHARE, common_words, find_leaks, find_paraphrases, longest_runs, words_of


def test_words():
    assert words_of("A_b É-1 don't № 船舶") == ["a", "b", "é", "1", "don", "t", "船舶"] and words_of(None) == []


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 50))) + (" Answer: 17 units." if i % 2 else "")) for i in range(12)]
    docs = []
    for d in range(120):
        words = rng.choices(vocab + [f"x{i}" for i in range(200)], k=rng.randint(0, 80))
        if d % 3 == 0:
            w = words_of(rng.choice(items)[1])
            n = rng.choice([RUN - 1, RUN, RUN + 5])
            s = rng.randint(0, max(0, len(w) - n))
            at = rng.randint(0, len(words))
            words = words[:at] + [x.upper() + rng.choice(["", ",", "_"]) for x in w[s : s + n]] + words[at:]
        docs.append((d, rng.choice([" ", "\n", " - "]).join(words), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (None, items[0][1], "x"), (902, items[1][1], "x"), (902, items[1][1], "x")]
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - RUN + 1):
            grams.setdefault(tuple(w[k : k + RUN]), set()).add(i)
    want = set()
    for d, t, _ in docs:
        w = words_of(t)
        if d is not None:
            want |= {(d, i) for k in range(len(w) - RUN + 1) for i in grams.get(tuple(w[k : k + RUN]), ())}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    assert all(r.run >= RUN for r in got)
    assert {r.answer for r in got if r.doc_id == 902 and r.item_id == 1} == {True} or len(words_of(items[1][1])) < RUN
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, it).collect()} == want
    assert find_leaks(df.where("false"), it).count() == 0 and find_leaks(df, it.where("false")).count() == 0


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_runs_and_subsequences():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (np.array(rng.choices(range(6), k=rng.randint(1, 30)), np.int32) for _ in range(2))
        assert common_words(a, b) == plain_common(a.tolist(), b.tolist())
        shift = rng.randint(-len(b) + 1, len(a) - 1)
        best = run = 0
        for i, w in enumerate(b.tolist()):
            run = run + 1 if 0 <= i + shift < len(a) and a[i + shift] == w else 0
            best = max(best, run)
        assert longest_runs([a[:0], a], [b[:0], b], np.array([[1, 1, shift]])).tolist() == [best]


def test_paraphrases_against_brute_force(spark):
    """Of the documents that hold SHARE of an item in order within its length and a half, at least 0.9 are found."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    weights = [1 / (i + 3) for i in range(900)]
    pick = lambda k: rng.choices(vocab, weights, k=k)
    items = [(i, " ".join(pick(rng.randint(24, 50)))) for i in range(40)]
    docs, planted = [], set()
    for d in range(600):
        words = pick(rng.randint(0, 120))
        if d % 4 == 0:
            i, t = rng.choice(items)
            told = []
            for w in t.split():
                x = rng.random()
                told += [] if x < 0.05 else [w, rng.choice(vocab)] if x < 0.1 else [rng.choice(vocab)] if x < 0.2 else [w]
            at = rng.randint(0, len(words))
            words = words[:at] + told + words[at:]
            planted.add((d, i))
        docs.append((d, " ".join(words)))
    by_item, by_doc = dict(items), dict(docs)
    runs = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, i in planted if (d, i) not in runs and plain_common(by_doc[d].split(), by_item[i].split()) >= (SHARE + 0.1) * len(by_item[i].split())}
    got = {(r.doc_id, r.item_id) for r in find_paraphrases(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 60 and len(want & got) >= 0.9 * len(want), (len(want), len(want & got))
    assert all(plain_common(by_doc[d].split(), by_item[i].split()) >= SHARE * len(by_item[i].split()) for d, i in got) and len(got - planted) <= 0.1 * len(got)
