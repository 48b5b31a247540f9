"""Packing: limits hold, every item once, exact fills are used, oversized items alone are divided."""

from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import packing
from tidewater.llm.packing import cut_oversized, fill, pack_block, pack_items


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0, 10)), max_size=30))
def test_fill_holds_the_limits(raw):
    pieces = [(length, kg, i) for i, (length, kg) in enumerate(raw)]
    groups = fill(pieces, 50, 25.0)
    assert sorted(i for g in groups for i in g) == list(range(len(raw)))
    for g in groups:
        assert sum(raw[i][0] for i in g) <= 50
        assert sum(raw[i][1] for i in g) <= 25.0 + 1e-6


def test_exact_complements_beat_best_fit():
    lengths = [60, 45, 55, 40, 33, 33, 34, 70, 20, 10]
    groups = fill([(x, 0.0, i) for i, x in enumerate(lengths)], 100, 1.0)
    assert len(groups) == 4 and all(sum(lengths[i] for i in g) == 100 for g in groups)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 12), st.floats(0, 4), st.floats(0, 4), st.floats(0, 300)), min_size=1, max_size=25))
def test_pack_block_fits(raw):
    dims = (5.9, 2.35, 2.39, 100.0)
    items = [(i, k, *p) for i, it in enumerate(raw) for k, p in enumerate(cut_oversized(*it, dims))]
    out = pack_block(items, dims)
    assert sorted((i, k) for i, k, _ in out) == sorted((i, k) for i, k, *_ in items)
    at = {(i, k): (l, w, h, kg) for i, k, l, w, h, kg in items}
    used = {}
    for i, k, c in out:
        used.setdefault(c, []).append(at[i, k])
    for got in used.values():
        assert sum(g[3] for g in got) <= 100.0 * (1 + 1e-6)
        assert sum(g[0] * g[1] * g[2] for g in got) <= 5.9 * 2.35 * 2.39 * (1 + 1e-6)


ITEMS = "id long, manifest_id long, bin_type string, l double, w double, h double, weight_kg double, loaded_at timestamp_ntz, length string"
BINS = "bin_type string, length double, width double, height double, max_weight_kg double"
T = datetime(2024, 1, 1)


def test_operator_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 5)
    rows = [
        (1, 1, "b", 4.0, 2.0, 2.0, 10.0, T, ""), (1, 1, "b", 4.0, 2.0, 2.0, 10.0, T, ""), (2, 1, "b", 2.0, 4.0, 2.0, 10.0, T, ""), (3, 1, "b", 4.1, 1.0, 1.0, 1.0, T, ""), (4, 1, "b", None, 9.0, 1.0, 1.0, T, ""),
        (5, 1, "b", 1.0, 1.0, None, None, T, ""), (6, 1, "b", 1.0, 1.0, 2.1, 1.0, T, ""), (7, 1, "b", 1.0, 1.0, 1.0, 101.0, T, ""), (8, None, "b", 1.0, 1.0, 1.0, 1.0, T, ""), (9, 1, "zz", 1.0, 1.0, 1.0, 1.0, T, ""), (10, 2, None, 9.0, 9.0, 9.0, 1.0, T, ""),
    ]
    rows += [(100 + i, 3, "b", 1.0, 1.0, 1.0, 1.0, T, "") for i in range(23)]
    items = spark.createDataFrame(rows, ITEMS)
    bins = spark.createDataFrame([("b", 4.0, 2.0, 2.0, 100.0)], BINS)
    got = pack_items(items, bins).collect()
    assert {r.item_row_id for r in got if r.oversized} == {3, 6, 7}
    assert {r.item_row_id for r in got if r.parts > 1} == {3, 6, 7}
    assert {r.item_row_id for r in got} == {r[0] for r in rows} - {8, 9, 10}
    assert len([r for r in got if r.manifest_id == 3]) == 23
    assert pack_items(items.where("false"), bins).count() == 0


def test_blocks_exchange_until_none_is_saved(spark, monkeypatch):
    """Bars of many lengths in blocks of 8: limits hold, and containers are saved over blocks that never meet."""
    lengths = [(37 * i) % 61 + 20 for i in range(64)]
    items = spark.createDataFrame([(i, 1, "b", x / 10, 1.0, 1.0, 1.0, T, "") for i, x in enumerate(lengths)], ITEMS)
    bins = spark.createDataFrame([("b", 10.0, 1.0, 1.0, 1000.0)], BINS)
    monkeypatch.setattr(packing, "BLOCK", 8)
    apart = packing._pack(packing._blocked(packing._pieces(packing.item_rows(items, bins))), "a").select("container").distinct().count()
    got = pack_items(items, bins).collect()
    assert sorted(r.item_row_id for r in got) == list(range(64))
    used = {}
    for r in got:
        used.setdefault(r.container, []).append(lengths[r.item_row_id])
    assert all(sum(v) <= 100 for v in used.values())
    assert len(used) < apart


def test_a_manifest_of_a_thousand_pieces_is_one_block(spark):
    """Cut into blocks of 500 this lost exact complements."""
    items = spark.createDataFrame([(i, 1, "b", (10 + i % 700) / 1000, 1.0, 1.0, 0.0, T, "") for i in range(1400)], ITEMS)
    bins = spark.createDataFrame([("b", 0.72, 1.0, 1.0, 1000.0)], BINS)
    assert pack_items(items, bins).select("container").distinct().count() == packing.math.ceil(sum(10 + i % 700 for i in range(1400)) / 720)
