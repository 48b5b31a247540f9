"""Stuffed pages and genuine lists that resemble them."""

import pytest

from tidewater.llm.stuffing import analyse, stuffed_pages

PROSE = "The vessel has a continuous deck, 16 hatches and 17 cranes of 264 tonnes each. Hire shall be paid every 24 days in advance to the account named by the owners."
STUFFED = [
    "Order ballast pump today, because ballast pump from Tarquay means cheap ballast pump. Why ballast pump? ballast pump 2025 ballast pump! " * 3,
    "\n".join(f"https://a{i}.example/ship-paint/{i}" for i in range(12)), "tags: rope, rope, paint, rope\n<li><a href='//x.test'>rope</a></li>\n" * 5,
    "Home > Ship Paint > top > ballast pump\nHome > Insurance > offer > pump\n" * 4, "tug hire (12) ship paint (9) tug hire (3) crew jacket (4) ship paint (2) tug hire (8) crew jacket (1)",
    "Frachtrate / Bunkerpreis / Ankerkette / Frachtrate / Ankerkette / Bunkerpreis / Frachtrate / Ankerkette / Bunkerpreis", "deck winch crew tug. " * 8,
    "\n".join(f"{p} mooring rope {q}" for p in ("best", "cheap", "top", "buy") for q in ("Tarquay", "Vessany", "Ostrelle")), "vessel for sale Vessel For Sale VESSEL FOR SALE top vessel for sale buy vessel for sale vessel for sale",
    "heavy lift quote ref 64.30 | bunker price SKU 54.90 | cargo insurance ref 614.83 | anchor chain art. 109.07 | ship chandler ref 828.94 | dry dock offer ref 166.06",
    "anchor chain ref 796.66 | tug hire SKU 170.24 | anchor chain art. 266.17 | tug hire ref 534.22 | tug hire art. 5.44 | anchor chain art. 748.69 | tug hire art. 507.30 | anchor chain ref 1.2",
]
GENUINE = [
    PROSE, "INVENTORY ON DELIVERY\n" + "\n".join(f"{7 * i % 40 + 1} x {n} {5 * i + 15} mm, {p}, {c}" for i, (n, p, c) in enumerate([(n, p, c) for n in ("lamp", "valve", "shackle", "fender") for p in ("hold 1", "bridge", "forepeak") for c in ("new", "worn")])),
    "Rotation of Golden Willow\n" + "\n".join(f"{i}) {p}, ETA {i} June 2023 15:25, load {311 * i} t" for i, p in enumerate(["Tarquay", "Vessany", "Ostrelle", "Anselby"] * 3, 1)),
    "Seals checked: " + ", ".join(f"AB-{i}7074" for i in range(20)) + ". All seals were intact when the surveyor left.", "BOW THRUSTER\n\n" + " ".join(f"The crew tested the bow thruster on {i} May 2025 and recorded the result under the usual reference." for i in range(8)),
    PROSE + "\n\nTags: rope, paint, anchor chain", PROSE * 3 + "\n\nSee also:\nhttps://a.example/x\nhttps://b.example/y", "NOR tendered 08:30", "Ok, thanks.", "—", "", "Depth moulded: 32.06 t\nBreadth moulded: 881.81 m\nSummer draft: 279.76 knots\nHatch size: 473.70 t",
    "GLOSSARY\nLaydays: The days on which the vessel may be tendered.\nDemurrage: Money that is due for time beyond the laytime.",
]


@pytest.mark.parametrize("text", STUFFED)
def test_stuffed(text):
    assert analyse(text)["share"] > 0.5


@pytest.mark.parametrize("text", GENUINE)
def test_genuine(text):
    assert analyse(text)["share"] <= 0.5


def test_share_decides():
    assert analyse(PROSE * 4 + "\n" + STUFFED[4])["share"] < 0.5 < analyse(PROSE + "\n" + STUFFED[0])["share"]


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, STUFFED[0], 1.0), (1, STUFFED[0], 1.0), (2, None, 1.0), (3, "", 1.0), (4, " \n", 1.0), (None, STUFFED[0], 1.0), (5, PROSE * 2000, 1.0)], "doc_id long, text string, share double")
    assert [r.doc_id for r in stuffed_pages(df).collect()] == [1, 1]
    assert stuffed_pages(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000 + "x", "a b " * 50_000, "ship paint | " * 20_000, "1" * 200_000, "a. " * 50_000, "\n" * 100_000])
def test_long_texts_are_read_in_linear_time(text):
    import time

    t = time.time()
    analyse(text)
    assert time.time() - t < 20


def test_regular_repetition_decides_without_link_patterns():
    """Lists of links and tag clouds that keep saying the same are found by their recurrence gaps."""
    links = "\n".join(f"http://{a}-deals.example/{b}/{i}" for i, (a, b) in enumerate([("tor", "deck-winch"), ("mir", "tug-hire"), ("tor", "tug-hire"), ("mir", "deck-winch")] * 6))
    cloud = " ".join(f"{w} ({i * 7})" for i, w in enumerate(["deck winch", "tug hire", "ship paint", "anchor chain"] * 8))
    for text in (links, cloud):
        got = analyse(text)
        assert got["lists"] > 0.9 and got["share"] > 0.9
