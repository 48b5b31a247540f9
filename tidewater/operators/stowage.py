"""Greedy three-dimensional stowage, one vessel per group.

Placing one item changes what fits for the next, so a vessel's items are placed
in order inside one task; vessels run in parallel. Candidate corners of a bin
are held in arrays and tested against all boxes of the bin at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewater.operators.cargo import EPS, LATERAL, STACK
from tidewater.session import spread


@dataclass(frozen=True)
class Weights:
    """Terms of a place's cost: height, load of its zone (and the power of that), distance from the centre line, weight beyond the target."""

    height: float = 10.0
    zone: float = 8.0
    zone_power: float = 1.5
    centre: float = 4.0
    excess: float = 1000.0
    tolerance: float = 0.10
    zones: int = 5


@dataclass
class Bin:
    name: str
    size: tuple[float, float, float]
    limit: float
    target: float
    corners: list[tuple[float, float, float]] = field(default_factory=lambda: [(0.0, 0.0, 0.0)])
    low: list[tuple[float, float, float]] = field(default_factory=list)
    span: list[tuple[float, float, float]] = field(default_factory=list)
    stackable: list[bool] = field(default_factory=list)
    weight: float = 0.0
    load: np.ndarray | None = None

    def zone(self, x: float, l: float, zones: int) -> int:
        return max(0, min(zones - 1, int(zones * (x + l / 2) / max(self.size[0], EPS))))

    def free(self, box: np.ndarray, lateral: float, stack: float) -> np.ndarray:
        """Which corners take the box: inside, clear of all boxes, standing on something that may bear it."""
        at = np.array(self.corners, float).reshape(-1, 3)
        ok = (at + box <= np.array(self.size) + EPS).all(1)
        if self.low and ok.any():
            low, span = np.array(self.low), np.array(self.span)
            gap = np.array([lateral, stack, lateral])
            apart = ((at[:, None] + box + gap <= low + EPS) | (low + span + gap <= at[:, None] + EPS)).any(2)
            ok &= apart.all(1)
            raised = at[:, 1] >= EPS
            rest = np.abs(low[:, 1] + span[:, 1] - at[:, None, 1]) <= EPS + stack
            over_x = np.minimum(low[:, 0] + span[:, 0], at[:, None, 0] + box[0]) - np.maximum(low[:, 0], at[:, None, 0])
            over_z = np.minimum(low[:, 2] + span[:, 2], at[:, None, 2] + box[2]) - np.maximum(low[:, 2], at[:, None, 2])
            touch = rest & (over_x > EPS) & (over_z > EPS)
            ok &= ~raised | (touch.any(1) & ~(touch & ~np.array(self.stackable)).any(1))
        return ok

    def put(self, corner: tuple[float, float, float], box: tuple[float, float, float], kg: float, stackable: bool, lateral: float, stack: float, zones: int) -> None:
        x, y, z = corner
        self.low.append(corner)
        self.span.append(box)
        self.stackable.append(stackable)
        self.weight += kg
        if self.load is None:
            self.load = np.zeros(zones)
        self.load[self.zone(x, box[0], zones)] += box[0] * box[1] * box[2]
        new = [(x + box[0] + lateral, y, z), (x, y + box[1] + stack, z), (x, y, z + box[2] + lateral)]
        kept = [c for c in self.corners if c != corner]
        kept += [c for c in new if c not in kept and all(v < s - EPS for v, s in zip(c, self.size, strict=True))]
        self.corners = sorted(kept, key=lambda c: (c[1], c[0], c[2]))


def stow(bins: list[Bin], items: pd.DataFrame, w: Weights, lateral: float, stack: float) -> list[tuple]:
    """Rows (item id, bin, x, y, z, l, w, h, rotation, reason): every item once, placed or with a reason.

    Items go largest first, then heaviest, then by position. Pinned items keep
    their place. Of equal costs the first bin, orientation and corner wins.
    """
    by_name = {b.name: b for b in bins}
    rows: list[tuple] = []
    order = items.assign(_v=-(items.l * items.w * items.h), _k=-items.weight_kg).sort_values(["pinned", "_v", "_k", "position"], ascending=[False, True, True, True], kind="stable")
    for it in order.itertuples(index=False):
        if it.pinned and it.bin_id in by_name:
            b = by_name[it.bin_id]
            turned = it.rotation_deg in (90, 270)
            box = (it.w if turned else it.l, it.h, it.l if turned else it.w)
            b.put((it.x, it.y, it.z), box, it.weight_kg, it.can_stack, lateral, stack, w.zones)
            rows.append((it.id, b.name, it.x, it.y, it.z, box[0], box[2], box[1], it.rotation_deg, None))
            continue
        best, why = None, set()
        if min(it.l, it.w, it.h) <= 0:
            rows.append((it.id, None, None, None, None, it.l, it.w, it.h, None, "no measures"))
            continue
        for b in bins:
            if it.h > b.size[1] + EPS:
                why.add("too tall")
                continue
            if max(it.l, it.w) > max(b.size[0], b.size[2]) + EPS or min(it.l, it.w) > min(b.size[0], b.size[2]) + EPS:
                why.add("too long")
                continue
            if b.weight + it.weight_kg > b.limit + EPS:
                why.add("too heavy")
                continue
            over = b.weight + it.weight_kg
            balance = (over - b.target) / b.target * w.excess if b.target > 0 and over > b.target * (1 + w.tolerance) else 0.0
            for turn in (0, 90) if it.can_rotate and abs(it.l - it.w) > EPS else (0,):
                box = (it.w if turn else it.l, it.h, it.l if turn else it.w)
                ok = b.free(np.array(box), lateral, stack)
                for i in np.nonzero(ok)[0]:
                    x, y, z = b.corners[i]
                    load = 0.0 if b.load is None else b.load[b.zone(x, box[0], w.zones)]
                    cost = y * w.height + load**w.zone_power * w.zone + abs(z + box[2] / 2 - b.size[2] / 2) / max(b.size[2], EPS) * w.centre + balance
                    if best is None or cost < best[0]:
                        best = (cost, b, b.corners[i], box, turn)
        if best is None:
            rows.append((it.id, None, None, None, None, it.l, it.w, it.h, None, ", ".join(sorted(why)) or "no free place"))
            continue
        _, b, corner, box, turn = best
        b.put(corner, box, it.weight_kg, it.can_stack, lateral, stack, w.zones)
        rows.append((it.id, b.name, *corner, box[0], box[2], box[1], turn, None))
    return rows


LAYOUT = "vessel_id long, item_id long, bin_id string, x double, y double, z double, l double, w double, h double, rotation_deg int, reason string"


def stow_vessels(bins: DataFrame, items: DataFrame, weights: Weights | None = None, lateral: float = LATERAL, stack: float = STACK) -> DataFrame:
    """The layout of every vessel: one row per item of ``items`` (vessel_id, id, position, l, w, h, weight_kg, can_stack, can_rotate, pinned, bin_id, x, y, z, rotation_deg).

    Null flags mean stackable, rotatable and not pinned, null measures 0. Items
    of a vessel without bins are unplaced.
    """
    w = weights or Weights()

    def run(key: tuple, bins_pdf: pd.DataFrame, items_pdf: pd.DataFrame) -> pd.DataFrame:
        it = items_pdf.copy()
        for c, v in (("l", 0.0), ("w", 0.0), ("h", 0.0), ("weight_kg", 0.0), ("can_stack", True), ("can_rotate", True), ("pinned", False), ("rotation_deg", 0)):
            it[c] = it[c].astype(object).where(it[c].notna(), v).astype(type(v))
        total = it.weight_kg.sum()
        volume = max(bins_pdf.volume_m3.sum(), EPS)
        own = [Bin(r.bin_id, (r.length, r.height, r.width), r.max_weight_kg, total * r.volume_m3 / volume) for r in bins_pdf.sort_values("bin_id").itertuples(index=False)]
        rows = stow(own, it, w, lateral, stack)
        cols = [c.split()[0] for c in LAYOUT.split(", ")]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=cols).astype({"rotation_deg": "Int32"})

    left = spread(bins, "vessel_id").groupBy("vessel_id")
    return left.cogroup(spread(items, "vessel_id").groupBy("vessel_id")).applyInPandas(run, LAYOUT)
