"""Placement geometry, stowage properties."""

import pandas as pd
from pyspark.sql import functions as F

from tidewater.operators import cargo as cg
from tidewater.operators.stowage import Bin, Weights, stow


def test_touching_boxes_do_not_overlap(frame):
    b = frame([(1, 9, None, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0), (2, 9, None, 2.0, 0.0, 0.0, 2.0, 2.0, 2.0), (3, 9, None, 1.0, 0.0, 1.0, 30.0, 2.0, 2.0), (4, 9, "lower", 1.0, 0.0, 1.0, 2.0, 2.0, 2.0), (5, 9, None, 0.0, 0.0, 0.0, None, 1.0, 1.0)], "id long, hold_id int, level string, x double, y double, z double, l double, w double, h double")
    got = {(r.a_id, r.b_id) for r in cg.overlaps(b, b, ["hold_id", "level"]).collect()}
    assert got == {(1, 3), (2, 3)}
    near = {(r.a_id, r.b_id) for r in cg.overlaps(b, b, ["hold_id", "level"], 0.1, 0.02).collect()}
    assert near == {(1, 2), (1, 3), (2, 3)}


def test_check_placements(frame):
    m = frame(
        [(1, 1, None, 0.0, 0.0, 0.0, 45, 1.0, 1.0, 1.0, True), (2, 1, None, 0.0, 0.0, 0.0, 90, 1.0, 1.0, 1.0, False), (3, 1, None, 9.5, 0.0, 0.0, 0, 1.0, 1.0, 1.0, True), (4, 1, "tween", 0.0, 0.0, 0.0, 0, 1.0, 1.0, 1.0, True), (5, 1, None, 0.0, 0.0, 0.0, 0, 1.0, 1.0, 1.0, True), (6, 1, None, 5.0, 0.0, 2.0, 0, 1.0, 1.0, None, True)],
        "id long, hold_id int, level string, x double, y double, z double, rotation_deg int, l double, w double, h double, can_rotate boolean",
    )
    h = frame([(1, 10.0, 5.0, 4.0, False, 0.0, 0.0)], "id int, length double, breadth double, height double, has_tween boolean, lower_height double, upper_height double")
    o = frame([(99, 1, None, 0.5, 0.0, 0.0, 1.0, 1.0, 1.0)], "id long, hold_id int, level string, x double, y double, z double, l double, w double, h double")
    got = {r.id: r.reason for r in cg.check_placements(m, h, o, ["hold_id", "level"]).collect()}
    assert got == {1: "rotation", 2: "may not rotate", 3: "beyond length", 4: None, 5: "overlap", 6: "no measures"}  # a hold without a tween deck has one level, whatever is asked


def test_holds_of_two_vessels_stay_apart(frame):
    m = frame([(1, "a", 1, None, 0.0, 0.0, 0.0, 0, 3.0, 1.0, 1.0, True), (2, "b", 1, None, 0.0, 0.0, 0.0, 0, 3.0, 1.0, 1.0, True)], "id long, vessel string, hold_id int, level string, x double, y double, z double, rotation_deg int, l double, w double, h double, can_rotate boolean")
    h = frame([("a", 1, 10.0, 5.0, 4.0, False, 0.0, 0.0), ("b", 1, 2.0, 5.0, 4.0, False, 0.0, 0.0)], "vessel string, id int, length double, breadth double, height double, has_tween boolean, lower_height double, upper_height double")
    o = m.where("false")
    assert sorted((r.id, r.reason) for r in cg.check_placements(m, h, o, ["vessel", "hold_id", "level"]).collect()) == [(1, None), (2, "beyond length")]


def items(n):
    rows = [(i, i, 1.0 + i % 3, 1.0 + i % 2, 1.0, 100.0 * (i + 1), i % 5 != 0, True, False, None, 0.0, 0.0, 0.0, 0) for i in range(n)]
    return pd.DataFrame(rows, columns="id position l w h weight_kg can_stack can_rotate pinned bin_id x y z rotation_deg".split())


def test_stowage_properties():
    bins = [Bin("a", (8.0, 3.0, 4.0), 4000.0, 2000.0), Bin("b", (6.0, 3.0, 3.0), 3000.0, 1500.0)]
    rows = stow(bins, items(20), Weights(), 0.1, 0.02)
    assert sorted(r[0] for r in rows) == list(range(20))
    placed = [r for r in rows if r[1]]
    assert placed and all(r[9] for r in rows if not r[1])
    size = {b.name: b for b in bins}
    for r in placed:
        b = size[r[1]]
        assert r[2] + r[5] <= b.size[0] + 1e-6 and r[3] + r[7] <= b.size[1] + 1e-6 and r[4] + r[6] <= b.size[2] + 1e-6
    for i, p in enumerate(placed):
        for q in placed[i + 1 :]:
            if p[1] == q[1]:
                apart = p[2] + p[5] <= q[2] + 1e-6 or q[2] + q[5] <= p[2] + 1e-6 or p[3] + p[7] <= q[3] + 1e-6 or q[3] + q[7] <= p[3] + 1e-6 or p[4] + p[6] <= q[4] + 1e-6 or q[4] + q[6] <= p[4] + 1e-6
                assert apart
    assert all(b.weight <= b.limit + 1e-6 for b in bins)


def test_numbers(spark):
    df = spark.createDataFrame([("12,5 kg",), ("1,234.5",), ("3.2 m",), ("",), (None,), ("abc",)], "v string")
    assert [r.n for r in df.select(cg.flexible_number(F.col("v")).alias("n")).collect()] == [12.5, 1234.5, 3.2, None, None, None]
    assert spark.range(1).select(cg.metres(F.lit(1200.0), F.lit("L (mm)")).alias("a"), cg.metres(F.lit(31.0), F.lit(None)).alias("b"), cg.kilograms(F.lit(2.0), F.lit("Weight t")).alias("c")).first() == (1.2, 0.031, 2000.0)


def test_balance_without_targets(frame):
    t = frame([("v", 1, 10.0), ("v", 2, 10.0)], "vessel string, hold_id int, target_kg double")
    a = frame([("v", 1, 10.0), ("v", 3, 99.0)], "vessel string, hold_id int, weight_kg double")
    assert cg.balance_scores(t, a, "vessel").first().balance == 50.0
    assert [(r.vessel, r.balance) for r in cg.balance_scores(t.where("false"), a, "vessel").collect()] == [("v", 100.0)]
    assert cg.balance_scores(t.where("false"), a.where("false"), "vessel").count() == 0
