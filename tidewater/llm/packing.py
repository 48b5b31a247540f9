"""Filling fixed-capacity containers with items of varying size.

Packing goes in three stages, each of them a one-dimensional filling of a fixed
capacity: items of a like cross-section stand end to end in rows as long as the
container, rows stand side by side in layers as wide as it, layers lie on top of
each other up to its height. Weight is limited at every stage.

Each stage fills by exact-complement hashing: with lengths in whole millimetres,
the single lengths still available are counted in a hash table together with the
sums of pairs and triples; a gap is first filled by a combination of one, two or
three items that fits it exactly, as long as the counts allow, and only what no
combination fills exactly is placed best-fit (the longest item that fits).

A manifest may hold any share of all rows, so it is packed in blocks of at most
``BLOCK`` items, each a task of its own. The blocks then exchange: all containers
of a manifest of several blocks, ranked by their fill, are dealt into new blocks,
so that what any block left poorly filled meets; a new block is packed again as a
whole and keeps its former containers unless that saves some. Rounds go on for a
manifest until one saves no container.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import cut_lineage, spread
from tidewater.sources.tables import first_rows

#: Items packed in one task; bounds memory and time of a group.
BLOCK = 2000
#: Steps of fill by which containers are ranked for the exchange between blocks.
STEPS = 1000


class Stock:
    """Pieces waiting for a place along one dimension: length (mm) -> pieces, heaviest last."""

    def __init__(self, pieces: list[tuple[int, float, int]]) -> None:
        self.by: dict[int, list[tuple[float, int]]] = {}
        for length, weight, i in pieces:
            self.by.setdefault(length, []).append((weight, i))
        for v in self.by.values():
            v.sort()
        self.lengths = sorted(self.by)
        self.count = len(pieces)

    def take(self, length: int, room: float) -> tuple[float, int] | None:
        """The heaviest piece of this length whose weight fits, or None."""
        have = self.by.get(length)
        if not have:
            return None
        at = bisect.bisect_right(have, (room, 1 << 62)) - 1
        if at < 0:
            return None
        piece = have.pop(at)
        self.count -= 1
        if not have:
            del self.by[length]
            del self.lengths[bisect.bisect_left(self.lengths, length)]
        return piece

    def give(self, length: int, piece: tuple[float, int]) -> None:
        if length not in self.by:
            self.by[length] = []
            bisect.insort(self.lengths, length)
        bisect.insort(self.by[length], piece)
        self.count += 1


class Sums:
    """Hash index from sums of stocked lengths to the combinations that give them.

    Singles are the stock itself, pairs are stored, and a triple sum is hashed as
    one length and the pair that complements it.
    """

    def __init__(self, stock: Stock, capacity: int) -> None:
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        ls = stock.lengths
        for i, a in enumerate(ls):
            for b in ls[i : bisect.bisect_right(ls, capacity - a)]:  # a longer sum fits no gap
                self.pairs.setdefault(a + b, []).append((b, a))

    def _combinations(self, stock: Stock, gap: int) -> Iterator[tuple[int, ...]]:
        if gap in stock.by:
            yield (gap,)
        yield from self.pairs.get(gap, ())
        for a in stock.lengths[::-1]:
            if a < gap:
                for b, c in self.pairs.get(gap - a, ()):
                    if b <= a:
                        yield (a, b, c)

    def exact(self, stock: Stock, gap: int, room: float) -> list[tuple[int, tuple[float, int]]] | None:
        """Pieces taken from the stock whose lengths sum to the gap, as far as the counts allow, if there are such."""
        for combo in self._combinations(stock, gap):
            if any(len(stock.by.get(x, ())) < combo.count(x) for x in combo):
                continue
            if sum(stock.by[x][0][0] for x in combo) > room + 1e-9:  # not even the lightest pieces fit
                continue
            got, left = [], room
            for x in combo:
                p = stock.take(x, left)
                if p is None:
                    break
                got.append((x, p))
                left -= p[0]
            if len(got) == len(combo):
                return got
            for x, p in got:
                stock.give(x, p)
        return None


def fill(pieces: list[tuple[int, float, int]], capacity: int, most_weight: float) -> list[list[int]]:
    """Groups of piece numbers; the lengths of a group sum to ``capacity`` at most, its weights to ``most_weight``.

    ``pieces``: (length, weight, number). A piece beyond the capacity stands alone.
    """
    stock = Stock(pieces)
    sums = Sums(stock, capacity)
    out = []
    while stock.count:
        length = stock.lengths[-1]
        first = stock.take(length, math.inf)
        group, gap, room = [first[1]], capacity - length, most_weight - first[0]
        while gap > 0 and stock.count and stock.lengths[0] <= gap:
            if got := sums.exact(stock, gap, room):
                group += [p[1] for _, p in got]
                break
            at = bisect.bisect_right(stock.lengths, gap) - 1
            piece = None
            while at >= 0:
                size = stock.lengths[at]
                piece = stock.take(size, room)
                if piece:
                    break
                at -= 1
            if not piece:
                break
            group.append(piece[1])
            gap -= size
            room -= piece[0]
        out.append(group)
    return out


#: How far sizes of one class may differ, as (heights, widths); the packing with the fewest containers is taken.
SPREADS = ((1.12, 1.12), (1.3, 1.3), (1.3, 2.0), (1.6, 1.6), (2.0, 3.0), (4.0, 4.0))


def _classes(values: list[int], spread: float) -> dict[int, int]:
    """Rounds sizes up to the greatest of their class, so that like sections share rows."""
    out: dict[int, int] = {}
    top = None
    for v in sorted(set(values), reverse=True):
        if top is None or v * spread < top:
            top = v
        out[v] = top
    return out


def _mm(x: float | None) -> int:
    return max(0, math.ceil((x or 0.0) * 1000 - 1e-6))


def cut_oversized(l: float, w: float, h: float, weight: float, dims: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    """An item as pieces that each fit the container; one piece, unchanged, if it fits whole.

    Cut across as few faces as the sizes demand, in the horizontal position that
    needs the fewest cuts, into equal pieces; an item too heavy is cut along its length.
    """
    length, width, height, most = dims
    eps = 1e-9
    parts = lambda a, b: max(1, math.ceil(a / b - eps)) if b > 0 else 1
    along = min((parts(l, length), parts(w, width)), (parts(l, width), parts(w, length)), key=lambda p: p[0] * p[1])
    nl, nw, nh = along[0], along[1], parts(h, height)
    while weight / (nl * nw * nh) > most * (1 + eps) and most > 0:
        nl += 1
    n = nl * nw * nh
    return [(l / nl, w / nw, h / nh, weight / n)] * n


def _stages(placed: list[tuple[int, int, int, float, int]], inner: tuple[int, int, int], most: float, spread: tuple[float, float]) -> list[list[int]]:
    """Containers as lists of piece numbers: rows, then layers, then stacks of layers."""
    tall = _classes([p[2] for p in placed], spread[0])
    wide = _classes([p[1] for p in placed], spread[1])
    sections: dict[tuple[int, int], list[tuple[int, float, int]]] = {}
    for a, b, c, kg, n in placed:
        sections.setdefault((tall[c], wide[b]), []).append((a, kg, n))
    rows = []
    for pieces in sections.values():
        for group in fill(pieces, inner[0], most):
            rows.append((max(placed[i][2] for i in group), max(placed[i][1] for i in group), sum(placed[i][3] for i in group), group))
    floors: dict[int, list[tuple[int, float, int]]] = {}
    for i, (c, b, kg, _) in enumerate(rows):
        floors.setdefault(tall[c], []).append((b, kg, i))
    layers = []
    for pieces in floors.values():
        for group in fill(pieces, inner[1], most):
            layers.append((max(rows[i][0] for i in group), sum(rows[i][2] for i in group), group))
    stacks = fill([(c, kg, i) for i, (c, kg, _) in enumerate(layers)], inner[2], most)
    return [[n for i in group for r in layers[i][2] for n in rows[r][3]] for group in stacks]


def pack_block(items: list[tuple[int, int, float, float, float, float]], dims: tuple[float, float, float, float]) -> list[tuple[int, int, int]]:
    """Assigns pieces (item, part, l, w, h, weight) to containers: (item, part, container from 0).

    Every piece must fit an empty container. A piece lies along the container
    where it can, or across it where that leaves the shorter side for the row's width.
    """
    length, width, height = (math.floor(x * 1000 + 1e-6) for x in dims[:3])
    most = dims[3] * (1 + 1e-9)
    best: list[list[int]] | None = None
    space = max(1, length * width * height)
    least = max(1, math.ceil(sum(_mm(i[2]) * _mm(i[3]) * _mm(i[4]) for i in items) / space - 1e-9), math.ceil(sum(i[5] for i in items) / most - 1e-9) if most > 0 else 1)
    for across in (False, True):
        placed = []
        for n, (_, _, l, w, h, kg) in enumerate(items):
            a, b = sorted((_mm(l), _mm(w)), reverse=not across)
            if a > length or b > width:
                a, b = b, a
            placed.append((a, b, _mm(h), kg, n))
        for spread in SPREADS:
            got = _stages(placed, (length, width, height), most, spread)
            if best is None or len(got) < len(best):
                best = got
            if len(best) <= least:
                return [(items[n][0], items[n][1], k) for k, group in enumerate(best) for n in group]
    return [(items[n][0], items[n][1], k) for k, group in enumerate(best or []) for n in group]


ASSIGNED = "manifest_id long, item_row_id long, part int, parts int, oversized boolean, container string, fill double, l double, w double, h double, weight_kg double"
_PIECE = "manifest_id long, item_row_id long, part int, parts int, oversized boolean, l double, w double, h double, weight_kg double, length double, width double, height double, max_weight_kg double, bin_type string"

_PACKED = _PIECE + ", fill double, container string, whole boolean, saved boolean"


def item_rows(items: DataFrame, bins: DataFrame) -> DataFrame:
    """One row per item id with its container's measures and ``oversized``.

    Rows of an id count once, by the earliest. A null measure excludes nothing
    and packs as zero; negative measures count as zero. Items of an unknown or
    null bin_type have null container measures and are not oversized. Of a
    bin_type listed twice the largest measures count.
    """
    one = first_rows(items, "id", ["manifest_id", "bin_type", "l", "w", "h", "weight_kg"])
    b = bins.where("bin_type is not null").groupBy("bin_type").agg(*[F.max(c).alias(c) for c in ("length", "width", "height", "max_weight_kg")])
    j = one.join(b, "bin_type", "left")
    l, w = F.col("l"), F.col("w")
    flat = ((l <= F.col("length")) & (w <= F.col("width"))) | ((w <= F.col("length")) & (l <= F.col("width")))
    checks = [F.col("weight_kg") > F.col("max_weight_kg"), F.col("h") > F.col("height"), l.isNotNull() & w.isNotNull() & ~flat]
    over = F.lit(False)
    for c in checks:
        over = over | F.coalesce(c, F.lit(False))
    return j.withColumn("oversized", over)


def _pieces(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                dims = (r.length, r.width, r.height, r.max_weight_kg)
                val = [max(0.0, x) if x == x and x is not None else 0.0 for x in (r.l, r.w, r.h, r.weight_kg)]
                if not (r.l == r.l and r.w == r.w and r.l is not None and r.w is not None):
                    val[0], val[1] = min(val[0], r.length), min(val[1], r.width)
                cut = cut_oversized(*val, dims)
                out += [(r.manifest_id, r.id, i, len(cut), r.oversized, *p, *dims, r.bin_type) for i, p in enumerate(cut, 1)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])

    cols = ["manifest_id", "id", "bin_type", "l", "w", "h", "weight_kg", "length", "width", "height", "max_weight_kg", "oversized"]
    known = "manifest_id is not null and length is not null and width is not null and height is not null and max_weight_kg is not null"
    return rows.where(known).select(*cols).mapInPandas(run, _PIECE)


def _blocked(pieces: DataFrame) -> DataFrame:
    """Adds ``_block`` and ``whole``: pieces of a manifest and container type in blocks of about BLOCK, by hash; whole if one holds all."""
    n = pieces.groupBy("manifest_id", "bin_type").agg(F.count("*").alias("_n"))
    j = pieces.join(n, ["manifest_id", "bin_type"])
    blocks = F.ceil(F.col("_n") / BLOCK)
    return j.withColumn("whole", blocks == 1).withColumn("_block", F.pmod(F.xxhash64("item_row_id", "part", F.lit(1)), blocks).cast("int")).drop("_n")


def _ranked(packed: DataFrame) -> DataFrame:
    """Sets ``_block``: a manifest's containers in blocks of about BLOCK pieces, from the emptiest to the fullest.

    Ranked by counts per step of fill, so no window holds a manifest's containers;
    within a step the hash of the container decides.
    """
    keys = ["manifest_id", "bin_type"]
    r = packed.withColumn("_step", F.floor(F.least("fill", F.lit(1.0)) * STEPS))
    steps = r.groupBy(*keys, "_step").agg(F.count("*").alias("_in"))
    one = Window.partitionBy(*keys)
    steps = steps.withColumn("_n", F.sum("_in").over(one)).withColumn("_to", F.sum("_in").over(one.orderBy("_step")))
    blocks = F.ceil(F.col("_n") / BLOCK)
    share = F.pmod(F.xxhash64("container"), F.lit(1 << 20)) / (1 << 20)
    at = F.floor((F.col("_to") - F.col("_in") + share * F.col("_in")) * blocks / F.col("_n"))
    return r.join(steps, [*keys, "_step"]).withColumn("_block", F.least(at, blocks - 1).cast("int")).drop("_step", "_in", "_n", "_to")


def _pack(blocked: DataFrame, name: str) -> DataFrame:
    """Packs each block; one that is packed already changes, and is ``saved``, only if fewer containers do."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dims = tuple(pdf[c].iloc[0] for c in ("length", "width", "height", "max_weight_kg"))
        pdf = pdf.sort_values(["item_row_id", "part"], ignore_index=True)
        items = list(pdf[["item_row_id", "part", "l", "w", "h", "weight_kg"]].itertuples(index=False, name=None))
        at = {(i, p): k for i, p, k in pack_block(items, dims)}
        pdf["_k"] = [at[i, p] for i, p in zip(pdf.item_row_id, pdf.part, strict=True)]
        before = pdf.container.nunique() if "container" in pdf else None
        pdf["saved"] = before is not None and pdf._k.nunique() < before
        if before is None or pdf.saved.iloc[0]:
            space = max(dims[0] * dims[1] * dims[2], 1e-9)
            share = (pdf.l * pdf.w * pdf.h / space).groupby(pdf._k).transform("sum")
            load = (pdf.weight_kg / max(dims[3], 1e-9)).groupby(pdf._k).transform("sum")
            pdf["fill"] = pd.concat([share, load], axis=1).max(axis=1)
            pdf["container"] = [f"{b}/{name}{x}/{k}" for b, x, k in zip(pdf.bin_type, pdf._block, pdf._k, strict=True)]
        return pdf[[c.split()[0] for c in _PACKED.split(", ")]]

    return spread(blocked, "manifest_id", "bin_type", "_block").groupBy("manifest_id", "bin_type", "_block").applyInPandas(run, _PACKED)


def pack_items(items: DataFrame, bins: DataFrame) -> DataFrame:
    """Assigns every item to containers of its manifest's type: one row per piece.

    Items that exceed one container are ``oversized`` and divided; no other item
    is. ``container`` is unique within a manifest; ``fill`` is the larger of its
    used shares of volume and weight. Items without manifest or of an unknown
    type are not packed. See ``item_rows`` for nulls and repeats.
    """
    pieces = _pieces(item_rows(items, bins))
    first = cut_lineage(_pack(_blocked(pieces), "a"))
    done, going, n = first.where("whole"), first.where("not whole"), 0
    while not going.isEmpty():
        n += 1
        r = cut_lineage(_pack(_ranked(going), f"b{n}."))
        better = r.where("saved").select("manifest_id", "bin_type").distinct()
        done = done.unionByName(r.join(better, ["manifest_id", "bin_type"], "left_anti"))
        going = r.join(better, ["manifest_id", "bin_type"], "left_semi")
    return done.select(*[c.split()[0] for c in ASSIGNED.split(", ")])


def oversized_items(packed: DataFrame) -> DataFrame:
    """Ids of the items that the packing had to divide."""
    return packed.where("oversized").select("item_row_id").distinct()
