"""Cargo geometry, totals, balance and placement checks on DataFrames.

Placements carry ``hold_id``, ``level`` (null = single level), corner x, y, z and
spans l (along), w (across), h (up). Touching boxes do not overlap (``EPS``).
Null measures count as zero; boxes without volume collide with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.session import cut_lineage

EPS = 1e-6
LATERAL, STACK = 0.10, 0.02
#: Share of the deadweight that may be used, and the density (kg per m3) where it is unknown.
USABLE, DENSITY = 0.95, 700.0
#: Cell size (m) that buckets boxes for the overlap join.
CELL = 16.0


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def rotated(l: Column, w: Column, h: Column, rotation: Column) -> list[Column]:
    """Spans after a horizontal rotation; a quarter turn swaps l and w."""
    turned = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(360)).isin(90, 270)
    return [F.when(turned, w).otherwise(l), F.when(turned, l).otherwise(w), h]


def level_height(level: Column, has_tween: Column, lower: Column, upper: Column, full: Column) -> Column:
    """Usable height of a level, null where the hold lacks it; no level in a tween-decked hold means the lower one."""
    positive = lambda c: F.when(c > 0, c)
    none = level.isNull() | (level == "")
    tween = F.coalesce(has_tween, F.lit(False))
    return (
        F.when(~tween | none, F.when(tween & (lower > 0) & (upper > 0), lower).otherwise(positive(full)))
        .when(level == "lower", positive(lower))
        .when(level == "tween", positive(upper))
    )


def manifest_totals(items: DataFrame, key: str = "manifest_id") -> DataFrame:
    """(key, items, weight_kg, volume_m3)."""
    vol = zero("l") * zero("w") * zero("h")
    return items.groupBy(key).agg(F.count("*").alias("items"), F.coalesce(F.sum("weight_kg"), F.lit(0.0)).alias("weight_kg"), F.coalesce(F.sum(vol), F.lit(0.0)).alias("volume_m3"))


def hold_bins(holds: DataFrame, deadweight_kg: str | None = None) -> DataFrame:
    """Bins of holds (vessel_id, id, length, breadth, height, has_tween, lower_height, upper_height): one, or a lower and a tween one.

    Holds without positive measures give none. ``max_weight_kg`` is the bin's
    share by volume of the usable deadweight, else of the fallback density.
    """
    ok = holds.where("length > 0 and breadth > 0 and height > 0")
    split = F.coalesce(F.col("has_tween"), F.lit(False)) & (zero("lower_height") > 0) & (zero("upper_height") > 0)
    levels = F.when(split, F.array(F.struct(F.lit("lower").alias("level"), F.col("lower_height").alias("h")), F.struct(F.lit("tween").alias("level"), F.col("upper_height").alias("h")))).otherwise(
        F.array(F.struct(F.lit(None).cast("string").alias("level"), F.col("height").alias("h")))
    )
    b = ok.withColumn("_l", F.explode(levels))
    volume = F.col("length") * F.col("breadth") * F.col("_l.h")
    b = b.withColumn("volume_m3", volume).withColumn("_total", F.sum("volume_m3").over(W.partitionBy("vessel_id")))
    share = F.col("volume_m3") / F.greatest(F.col("_total"), F.lit(EPS))
    dw = F.col(deadweight_kg) if deadweight_kg else F.lit(None).cast("double")
    ceiling = F.when(dw > 0, dw * USABLE * share).otherwise(F.col("volume_m3") * DENSITY)
    name = F.concat_ws("_", F.col("id").cast("string"), F.col("_l.level"))
    return b.select("vessel_id", F.col("id").alias("hold_id"), name.alias("bin_id"), F.col("_l.level").alias("level"), "length", F.col("breadth").alias("width"), F.col("_l.h").alias("height"), "volume_m3", ceiling.alias("max_weight_kg"))


def hold_weights(placements: DataFrame, keys: list[str]) -> DataFrame:
    """Placed weight per hold; unplaced rows (null hold) are left out."""
    return placements.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.coalesce(F.sum("weight_kg"), F.lit(0.0)).alias("weight_kg"))


def weight_targets(bins: DataFrame, totals: DataFrame, group: str, hold: str = "hold_id", volume: str = "volume_m3") -> DataFrame:
    """The group's total weight shared over its holds by volume: (group, hold, target_kg)."""
    w = W.partitionBy(group)
    b = bins.withColumn("_share", F.col(volume) / F.greatest(F.sum(volume).over(w), F.lit(EPS)))
    return b.join(totals, group).groupBy(group, hold).agg(F.sum(F.col("_share") * F.col("weight_kg")).alias("target_kg"))


def balance_scores(targets: DataFrame, actuals: DataFrame, group: str, hold: str = "hold_id") -> DataFrame:
    """(group, balance): 100 where every hold has its target, down by the mean deviation over the largest target, 0 at least.

    Holds with weight but no target play no part; a group with weights but without targets has 100.
    """
    j = targets.join(actuals, [group, hold], "left")
    g = j.groupBy(group).agg(F.avg(F.abs(zero("weight_kg") - F.col("target_kg"))).alias("_dev"), F.max("target_kg").alias("_max"))
    top = F.when(F.col("_max") == 0, F.lit(1.0)).otherwise(F.col("_max"))
    scored = g.select(group, F.greatest(F.lit(0.0), F.bround(100.0 * (1.0 - F.col("_dev") / top), 2)).alias("balance"))
    every = targets.select(group).union(actuals.select(group)).distinct()
    return every.join(scored, group, "left").select(group, F.coalesce("balance", F.lit(100.0)).alias("balance"))


def fill_rates(placed: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """Per hold the mean of its levels' fill (``mean_fill``) and the fill by volume (``volume_fill``), in per cent."""
    used = placed.groupBy(*keys, "level").agg(F.sum(zero("l") * zero("w") * zero("h")).alias("used"))
    b, u = bins.alias("b"), used.alias("u")
    cond = [F.col(f"b.{k}") == F.col(f"u.{k}") for k in keys] + [F.col("b.level").eqNullSafe(F.col("u.level"))]
    j = b.join(u, cond, "left").select(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b.volume_m3").alias("v"), zero("u.used").alias("used"))
    return j.groupBy(*keys).agg(F.avg(100.0 * F.col("used") / F.col("v")).alias("mean_fill"), (100.0 * F.sum("used") / F.sum("v")).alias("volume_fill"))


def overlaps(a: DataFrame, b: DataFrame, group: list[str], lateral: float = 0.0, stack: float = 0.0) -> DataFrame:
    """Pairs of boxes that overlap or are nearer than the clearances: (group, a_id, b_id), a_id < b_id.

    Boxes are bucketed into cells along the length and joined per cell, so a hold
    with very many boxes is spread over tasks and only near pairs meet; each pair
    is reported by the one cell that holds the start of its common span.
    """
    def boxes(df: DataFrame, p: str) -> DataFrame:
        has = df.where((zero("l") > 0) & (zero("w") > 0) & (zero("h") > 0))
        cols = [F.col(c).alias(f"{p}_{c}") for c in ("id", "x", "y", "z", "l", "w", "h")]
        first, last = F.floor(F.col("x") / CELL), F.floor((F.col("x") + F.col("l") + lateral) / CELL)
        return has.select(*group, *cols, F.explode(F.sequence(first, last)).alias("_cell"))

    x, y = boxes(a, "a").alias("p"), boxes(b, "b").alias("q")
    cond = [F.col(f"p.{g}").eqNullSafe(F.col(f"q.{g}")) for g in group] + [F.col("p._cell") == F.col("q._cell"), F.col("a_id") < F.col("b_id")]
    apart = F.lit(False)
    for at, span, gap in (("x", "l", lateral), ("y", "h", stack), ("z", "w", lateral)):
        apart = apart | (F.col(f"a_{at}") + F.col(f"a_{span}") + gap <= F.col(f"b_{at}") + EPS) | (F.col(f"b_{at}") + F.col(f"b_{span}") + gap <= F.col(f"a_{at}") + EPS)
    owner = F.floor(F.greatest("a_x", "b_x") / CELL) == F.col("p._cell")
    return x.join(y, cond).where(~apart & owner).select(*[F.col(f"p.{g}").alias(g) for g in group], "a_id", "b_id")


def check_placements(moves: DataFrame, holds: DataFrame, others: DataFrame, group: list[str], lateral: float = LATERAL, stack: float = STACK) -> DataFrame:
    """(id, reason): the first rule each proposed placement breaks, null if none.

    ``moves``: id, group keys, hold_id, level, x, y, z, rotation_deg, raw l, w, h
    and can_rotate. Rules in order: rotation, measures, hold, level, bounds in
    each direction, overlap with other boxes of the same hold and level (the
    box's own old place apart). Holds are matched on their id and on those group
    keys that ``holds`` carries, so equal ids of two vessels stay apart.
    """
    l, w, h = rotated(zero("m.l"), zero("m.w"), zero("m.h"), F.col("m.rotation_deg"))
    same = F.col("m.hold_id") == F.col("h.id")
    for k in group:
        if k in holds.columns and k not in ("hold_id", "level"):
            same = same & F.col(f"m.{k}").eqNullSafe(F.col(f"h.{k}"))
    j = moves.alias("m").join(holds.alias("h"), same, "left")
    top = level_height(F.col("m.level"), F.col("h.has_tween"), zero("h.lower_height"), zero("h.upper_height"), zero("h.height"))
    d = j.select("m.id", *[F.col(f"m.{g}").alias(g) for g in group], "m.x", "m.y", "m.z", l.alias("l"), w.alias("w"), h.alias("h"), F.pmod(F.coalesce("m.rotation_deg", F.lit(0)), F.lit(360)).alias("_r"), F.coalesce("m.can_rotate", F.lit(True)).alias("_can"), zero("h.length").alias("_L"), zero("h.breadth").alias("_B"), top.alias("_H"))
    reason = (
        F.when(~F.col("_r").isin(0, 90), "rotation")
        .when((F.col("_r") == 90) & ~F.col("_can"), "may not rotate")
        .when((F.col("l") <= 0) | (F.col("w") <= 0) | (F.col("h") <= 0), "no measures")
        .when((F.col("_L") <= 0) | (F.col("_B") <= 0), "no hold")
        .when(F.col("_H").isNull(), "no such level")
        .when((F.col("x") < -EPS) | (F.col("y") < -EPS) | (F.col("z") < -EPS), "negative corner")
        .when(F.col("x") + F.col("l") > F.col("_L") + EPS, "beyond length")
        .when(F.col("z") + F.col("w") > F.col("_B") + EPS, "beyond breadth")
        .when(F.col("y") + F.col("h") > F.col("_H") + EPS, "beyond height")
    )
    d = d.withColumn("_reason", reason)
    free = d.where("_reason is null")
    both = free.select("id", *group, "x", "y", "z", "l", "w", "h").withColumn("id", F.concat(F.lit("m"), F.col("id").cast("string")))
    rest = others.select("id", *group, "x", "y", "z", "l", "w", "h").withColumn("id", F.concat(F.lit("o"), F.col("id").cast("string")))
    hit = overlaps(both, rest, group, lateral, stack)
    own = F.substring("a_id", 2, 30) == F.substring("b_id", 2, 30)
    hits = hit.where(~own).select(F.substring("a_id", 2, 30).alias("_id")).distinct().withColumn("_hit", F.lit("overlap"))
    out = d.join(hits, F.col("id").cast("string") == F.col("_id"), "left")
    return out.select("id", F.coalesce("_reason", "_hit").alias("reason"))


def parse_deadweight_kg(text: Column) -> Column:
    """Kilograms of a free text: its first figure without commas, tonnes below 100,000."""
    v = F.nullif(F.regexp_extract(F.regexp_replace(F.lower(text), ",", ""), r"([\d.]+)", 1), F.lit("")).try_cast("double")
    return F.when(v < 100_000, v * 1000).otherwise(v)


def flexible_number(text: Column) -> Column:
    """A cell as a number: unit letters at the end go; a lone comma is a decimal one, beside a point it separates thousands."""
    s = F.trim(F.regexp_replace(F.trim(text), r"[a-zA-Z]+\s*$", ""))
    s = F.when(F.contains(s, F.lit(",")) & ~F.contains(s, F.lit(".")), F.replace(s, F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    return F.nullif(s, F.lit("")).try_cast("double")


def metres(value: Column, header: Column) -> Column:
    """A dimension in metres by its header's unit; without one, figures above 30 are millimetres. Null is 0."""
    h = F.lower(F.coalesce(header, F.lit("")))
    return F.when(value.isNull(), 0.0).when(h.rlike("mm|millim"), value / 1000).when(h.rlike("cm|centim"), value / 100).when(value > 30, value / 1000).otherwise(value)


def kilograms(value: Column, header: Column) -> Column:
    """A weight in kilograms; tonnes where the header names them and no kilograms. Null is 0."""
    h = F.lower(F.coalesce(header, F.lit("")))
    tonnes = h.rlike(r"\b(t|tonne|metric\s*ton)\b") & ~h.contains("kg")
    return F.when(value.isNull(), 0.0).when(tonnes, value * 1000).otherwise(value)


#: Cell texts that flag dangerous goods (fixed values).
DANGEROUS = ("Y", "YES", "TRUE", "1", "X", "IMO", "IMDG", "DG", "DANGEROUS")


def flagged(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)).isin(*DANGEROUS), F.lit(False))


def unpack(packed: DataFrame, positions: DataFrame, on: tuple[str, ...] = ("position",)) -> DataFrame:
    """A joint layout back to the manifests its items came from, by position (in the vessel, where ``on`` names it); items that the layout lacks stay, with nulls."""
    return positions.join(packed, list(on), "left")


def footprint_overlap(a: str, b: str) -> Column:
    """Area that the footprints (x, z, l, w) of two boxes share, by the prefixes of their columns."""
    def common(at: str, span: str) -> Column:
        low = F.greatest(F.col(f"{a}{at}"), F.col(f"{b}{at}"))
        high = F.least(F.col(f"{a}{at}") + zero(f"{a}{span}"), F.col(f"{b}{at}") + zero(f"{b}{span}"))
        return F.greatest(F.lit(0.0), high - low)

    return common("x", "l") * common("z", "w")


def global_positions(items: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position``, the rank over all rows by ``order`` from 0.

    Rows are range-partitioned by the order, so partitions follow each other; only
    their sizes reach the driver. Ties beyond the order columns are ranked at will.
    """
    spark = items.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = cut_lineage(items.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    off = spark.createDataFrame(offsets or [(0, 0)], "_p int, _off long")
    w = W.partitionBy("_p").orderBy(*order)
    return ranged.join(F.broadcast(off), "_p").withColumn("position", F.row_number().over(w) - 1 + F.col("_off")).drop("_p", "_off")
