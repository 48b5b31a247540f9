"""Joint stowage: items of all manifests, pins, limits, and the way back."""

import random

from tidewater.plans.joint import joint_stowage, manifest_summary, vessel_summary


def test_joint_stowage(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        pin = i in (3, 17)
        rows.append((i % 5, i, i, rng.uniform(0.5, 3), rng.uniform(0.5, 2), rng.uniform(0.5, 2), rng.uniform(10, 900), i % 4 != 0, True, pin, "a" if pin else None, 0.0 if i == 3 else 6.0, 0.0, 0.0, 0))
    items = spark.createDataFrame([*rows, (77, 99, 1, 1.0, 1.0, 1.0, 1.0, True, True, False, None, None, None, None, 0)], "manifest_id long, id long, position int, l double, w double, h double, weight_kg double, can_stack boolean, can_rotate boolean, pinned boolean, bin_id string, x double, y double, z double, rotation_deg int")
    manifests = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 3), (3, 4), (1, 0)], "vessel_id long, manifest_id long")
    bins = spark.createDataFrame([(v, b, 12.0, 5.0, 4.0, 240.0, 9000.0) for v in (1, 2) for b in ("a", "b")], "vessel_id long, bin_id string, length double, width double, height double, volume_m3 double, max_weight_kg double")
    layout = joint_stowage(manifests, items, bins)
    got = layout.collect()
    assert sorted(r.id for r in got) == list(range(60))
    assert {r.manifest_id: r.vessel_id for r in got} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}
    assert all(r.bin_id is None and r.reason for r in got if r.vessel_id == 3) and all((r.bin_id is None) == (r.reason is not None) for r in got)
    raw = {r[1]: r for r in rows}
    for r in got:
        if r.bin_id and not r.pinned:
            assert r.x + r.l <= 12 + 1e-6 and r.y + r.h <= 4 + 1e-6 and r.z + r.w <= 5 + 1e-6
        if r.pinned and r.vessel_id != 3:
            assert (r.bin_id, r.x, r.y, r.z) == ("a", raw[r.id][11], 0.0, 0.0)
    placed = [r for r in got if r.bin_id]
    for i, p in enumerate(placed):
        for q in placed[i + 1 :]:
            if (p.vessel_id, p.bin_id) == (q.vessel_id, q.bin_id):
                assert p.x + p.l <= q.x + 1e-6 or q.x + q.l <= p.x + 1e-6 or p.y + p.h <= q.y + 1e-6 or q.y + q.h <= p.y + 1e-6 or p.z + p.w <= q.z + 1e-6 or q.z + q.w <= p.z + 1e-6
    for v in (1, 2):
        for b in ("a", "b"):
            assert sum(r.weight_kg for r in placed if (r.vessel_id, r.bin_id) == (v, b)) <= 9000 + 1e-6
    back = {r.manifest_id: (r.placed + r.unplaced, r.colour) for r in manifest_summary(layout).collect()}
    assert {k: n for k, (n, _) in back.items()} == dict.fromkeys(range(5), 12) and len({back[m][1] for m in (0, 1, 2)}) == 3
    vessels = {r.vessel_id: r for r in vessel_summary(layout, bins).collect()}
    assert 0 <= vessels[1].balance <= 100 and vessels[3].placed == 0
    assert joint_stowage(manifests.where("false"), items, bins).count() == 0
