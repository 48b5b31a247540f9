"""Round trips and limits of the splitter."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.splitting import split_oversized, split_text, tail


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab é.\n,;|。 "), max_size=400), st.integers(20, 60), st.integers(0, 19))
def test_round_trip(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(p[n:] for p, n in pieces) == text
    assert all(len(p) <= limit and n <= overlap for p, n in pieces)
    for (a, _), (b, n) in zip(pieces, pieces[1:], strict=False):
        assert a.endswith(b[:n])
        assert n or not overlap or not a


def test_prefers_natural_boundaries():
    text = "First sentence here. Second one is here.\n\nNew paragraph starts. And it goes on."
    pieces = [p[n:] for p, n in split_text(text, 60, 10)]
    assert pieces[0].endswith("\n\n")
    assert tail("one two three. four five", 12) == "four five"


def test_word_longer_than_a_piece():
    pieces = split_text("x" * 10_000, 4000, 200)
    assert [len(p) for p, _ in pieces] == [3800, 4000, 2600]


def test_operator_edges(spark):
    rows = [(1, "T", "a " * 2500, "x"), (1, "T", "a " * 2500, "x"), (2, None, "é" * 4001, "x"), (3, "", "b" * 4000, "x"), (4, "t", None, "x"), (None, "t", "c" * 5000, "x"), (5, " ", "d " * 3000, "x")]
    df = spark.createDataFrame(rows, "id long, title string, body string, piece string")
    got = split_oversized(df).collect()
    assert {r.chunk_id for r in got} == {1, 2, 5}
    assert len([r for r in got if r.chunk_id == 1]) == 2
    assert {r.title for r in got if r.chunk_id == 2} == {"(part 1)", "(part 2)"}
    assert split_oversized(df.where("false")).count() == 0
