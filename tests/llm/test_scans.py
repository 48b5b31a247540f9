"""Scan noise: layout, retrieval against brute force, whole operator."""

import random

from tidewater.llm import scans
from tidewater.llm.scans import CONFUSIONS, Trie, clean_layout, noisy_rows, reflow, repair_scans, word_like

COUNTS = {"redelivery": 50, "sub-charterers": 40, "off-hire": 30, "officers": 20, "delivery": 60}


def WORDS(whole, hyphened, capital):
    return COUNTS.get(hyphened, 0) <= COUNTS.get(whole, 0) and (COUNTS.get(whole, 0) > 0 or not capital)


LINE = "Hire shall be paid every 24 days in advance to the account"


def test_furniture_inside_prose_only():
    text = f"{LINE}\nPage 2 of 30\nRIDER CLAUSES  BLUE / YOUNG WILLOW\nof the owners and {LINE.lower()}\n7\nwhich goes on here and there."
    body, heads, pages, _ = clean_layout(text, WORDS)
    assert (heads, pages) == (1, 2) and body == f"{LINE}\nof the owners and {LINE.lower()}\nwhich goes on here and there."
    for keep in ("Laycan 4 -\n17 February\n" + LINE + ".\nCranes\n5\nGrabs\n4", "Hold\nhatches\n1\n2\n" + LINE + ".", LINE + "\nof the owners.", "Page 2 of 30\n" + LINE, "1\n" + LINE + "\n2\n" + LINE + "\n3\n" + LINE, ""):
        assert clean_layout(keep, WORDS) == (keep, 0, 0, 0)


def test_breaks():
    assert clean_layout("the rede-\nlivery of it", WORDS)[0::3] == ("the redelivery of it", 1)
    assert clean_layout("the rede¬\nlivery", WORDS)[3] == 1 and clean_layout("the rede­\nlivery", WORDS)[3] == 1
    assert clean_layout("Sub-\nCharterers and off-\nhire 4 -\n17 x", WORDS)[3] == 0
    assert clean_layout("the rede-\n\np. 3\nlivery of it and more words here", WORDS)[3] == 1


def cheapest(token, word, confusions, other):
    """Least cost that turns the token into the word, trying all alignments: confusions cost 1, other edits of a character ``other``."""
    best = {(0, 0): 0}
    for i in range(len(token) + 1):
        for j in range(len(word) + 1):
            k = best.get((i, j))
            if k is None:
                continue
            steps = [(len(r), len(p), 1) for r, p in confusions if token.startswith(r, i) and word.startswith(p, j)]
            steps += [(1, 0, other), (0, 1, other), (1, 1, 0 if i < len(token) and j < len(word) and token[i] == word[j] else other)]
            for a, b, c in steps:
                if i + a <= len(token) and j + b <= len(word):
                    best[i + a, j + b] = min(best.get((i + a, j + b), 99), k + c)
    return best[len(token), len(word)]


def test_retrieval_is_complete():
    rng = random.Random(2)
    words = ["hours", "have", "bold", "hold", "deck", "named", "ning", "ring", "under", "tion", "time", "corn", "com", "days", "clays", "lading", "gel", "the", "charter", "laytime", "vessel", "freight", "notice"]
    trie = Trie(words)
    tokens = ["chorter", "chartev", "freiqht", "freght", "frreight", "", "x"]
    for _ in range(300):
        t = list(rng.choice(words))
        for read, printed in rng.sample(CONFUSIONS, 3):
            s = "".join(t)
            if printed in s and rng.random() < 0.7:
                t = list(s.replace(printed, read, 1))
        if rng.random() < 0.3:
            t[rng.randrange(len(t))] = rng.choice("aeixq")
        tokens.append("".join(t))
    for limit in (1, 2, 3):
        got = {(k, w): c + 2 * o for k, w, c, o in trie.within(tokens, limit)}
        want = {(k, w): d for k, t in enumerate(tokens) for w in words if 0 < (d := cheapest(t, w, CONFUSIONS, 2)) <= limit}
        assert got == want
    assert {w for k, w, *_ in trie.within(tokens[:5], 2)} >= {"charter", "freight"}


def test_plain_edit_distance():
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    words, tokens = sorted({make() for _ in range(80)}), [make() for _ in range(60)]
    for limit in (1, 2, 3):
        got = {(k, w): o for k, w, _, o in Trie(words, (), 1).within(tokens, limit)}
        assert got == {(k, w): d for k, t in enumerate(tokens) for w in words if 0 < (d := cheapest(t, w, (), 1)) <= limit}
    assert Trie([]).within(["a"], 2) == [] and Trie(["a"]).within([], 2) == []


def test_many_tries(spark, monkeypatch):
    """Dealing words and tokens to many tries and parts changes nothing."""
    rows = [(i, "the hoiirs of dclivery and the noticc") for i in range(1)] + [(i, "the hours of delivery and the notice") for i in range(10, 400)]
    df = spark.createDataFrame(rows, "id long, body string")
    once = sorted(map(tuple, repair_scans(df).collect()))
    monkeypatch.setattr(scans, "SHARD", 2)
    monkeypatch.setattr(scans, "TOKENS", 1)
    assert sorted(map(tuple, repair_scans(df).collect())) == once and once[0][1] == "the hours of delivery and the notice"


def test_word_like():
    assert word_like("h@tches") and word_like("c0mplaint") and word_like("|oading") and word_like("wi+h")
    assert not any(map(word_like, ["ar-12345", "2024", "a", "", "99abc12", "x" * 30]))


def test_reflow():
    assert reflow(f"{LINE}\nof the owners in time.\n\n- list entry here\n- another entry") == f"{LINE} of the owners in time.\n\n- list entry here\n- another entry"
    assert reflow(f"{LINE}\n{LINE} {LINE.lower()} and so on\n{LINE.lower()}\n{LINE.lower()}\nin time.").count("\n") == 0
    assert reflow("Depth moulded: 3 m\nBreadth: 4 m") == "Depth moulded: 3 m\nBreadth: 4 m"


def test_operator(spark):
    clean = [(i, f"The hours of delivery are counted under clause {i} with the tonnes of cargo in hold {i}.") for i in range(400)]
    dirty = [
        (1001, "The hoiirs of delivery are counted under clause 5 with the tonnes of cargo."), (1002, "The hours of deliv-\nery are counted under clause 5 with the tonnes."),
        (1003, "The hours of delivery are counted\nPage 3 of 9\nunder clause 5 with the tonnes of cargo."), (1004, "The hours of delivery are counted\nunder clause 5 with the tonnes of cargo."),
        (1001, "The hoiirs of delivery are counted under clause 5 with the tonnes of cargo."), (1005, None), (1006, ""), (None, "The hoiirs of delivery"), (1007, "The h0urs of de1ivery are c0unted " * 3),
    ]
    df = spark.createDataFrame([(*r, 0) for r in clean + dirty], "id long, body string, misread int")
    got = {r.chunk_id: (r.headers, r.pages, r.joined, r.misread) for r in noisy_rows(df).collect()}
    assert got == {1001: (0, 0, 0, 1), 1002: (0, 0, 1, 0), 1003: (0, 1, 0, 0), 1007: (0, 0, 0, 3)}
    fixed = {r.chunk_id: r.repaired for r in repair_scans(df).collect()}
    assert fixed[1001].startswith("The hours of") and "delivery are" in fixed[1002] and "Page 3" not in fixed[1003] and fixed[1007].startswith("The hours of delivery are counted")
    assert noisy_rows(df.where("false")).count() == 0
    assert scans._PLAIN.fullmatch("bo’sun")
