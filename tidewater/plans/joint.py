"""Joint stowage: all manifests of a vessel packed together, and the layout handed back to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import cargo as cg
from tidewater.operators import ordered as od
from tidewater.operators.stowage import Weights, stow_vessels
from tidewater.operators.structure import palette

COLOURS = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b"]


def joint_stowage(manifests: DataFrame, items: DataFrame, bins: DataFrame, weights: Weights | None = None, colours: list[str] | None = None) -> DataFrame:
    """The layout of every vessel over all its manifests: one row per item, with its manifest.

    ``manifests``: vessel_id, manifest_id. ``items``: manifest_id, id, position, l, w,
    h, weight_kg, can_stack, can_rotate, pinned, bin_id, x, y, z, rotation_deg.
    ``bins``: vessel_id, bin_id, length, width, height, volume_m3, max_weight_kg.

    Items get a position in their vessel (by manifest, position, id), by which ties
    are broken and the layout is handed back. Pinned items keep their place and are
    obstacles to all others; each bin's share of the vessel's weight, by volume, is
    its target. Result: (vessel_id, manifest_id, id, colour, bin_id, x, y, z, l, w,
    h, rotation_deg, weight_kg, pinned, reason); ``reason`` tells why an item has no
    place. Items of manifests without a vessel give no row; those of vessels without
    bins have no place.
    """
    order = od.numbered(manifests.distinct(), ["vessel_id"], ["manifest_id"], "_m")
    own = items.join(order, "manifest_id")
    own = od.numbered(own, ["vessel_id"], ["manifest_id", "position", "id"], "at").withColumn("at", F.col("at") - 1)
    joint = own.select("vessel_id", F.col("at").alias("id"), F.col("at").alias("position"), "l", "w", "h", "weight_kg", "can_stack", "can_rotate", "pinned", "bin_id", "x", "y", "z", "rotation_deg")
    packed = stow_vessels(bins, joint, weights).withColumnRenamed("item_id", "at")
    back = cg.unpack(packed, own.select("vessel_id", "at", "manifest_id", "id", "weight_kg", F.coalesce("pinned", F.lit(False)).alias("pinned"), (F.col("_m") - 1).alias("_m")), ("vessel_id", "at"))
    reason = F.when(F.col("bin_id").isNull(), F.coalesce("reason", F.lit("no hold")))
    return back.select("vessel_id", "manifest_id", "id", palette(F.col("_m"), colours or COLOURS).alias("colour"), "bin_id", "x", "y", "z", "l", "w", "h", "rotation_deg", "weight_kg", "pinned", reason.alias("reason"))


def vessel_summary(layout: DataFrame, bins: DataFrame, hold: str = "bin_id") -> DataFrame:
    """(vessel_id, placed, unplaced, weight_kg, balance): counts, placed weight, and the balance of the holds against their targets."""
    g = layout.groupBy("vessel_id").agg(F.count("bin_id").alias("placed"), F.count_if(F.col("bin_id").isNull()).alias("unplaced"), F.coalesce(F.sum(F.when(F.col("bin_id").isNotNull(), F.col("weight_kg"))), F.lit(0.0)).alias("weight_kg"))
    totals = layout.groupBy("vessel_id").agg(F.coalesce(F.sum("weight_kg"), F.lit(0.0)).alias("weight_kg"))
    actual = layout.where("bin_id is not null").groupBy("vessel_id", hold).agg(F.coalesce(F.sum("weight_kg"), F.lit(0.0)).alias("weight_kg"))
    return g.join(cg.balance_scores(cg.weight_targets(bins, totals, "vessel_id", hold), actual, "vessel_id", hold), "vessel_id", "left")


def manifest_summary(layout: DataFrame) -> DataFrame:
    """(vessel_id, manifest_id, colour, placed, unplaced, pinned, weight_kg, volume_m3) of each manifest's share of the layout."""
    on = F.col("bin_id").isNotNull()
    return layout.groupBy("vessel_id", "manifest_id", "colour").agg(
        F.count_if(on).alias("placed"), F.count_if(~on).alias("unplaced"), F.count_if(F.col("pinned") & on).alias("pinned"),
        F.coalesce(F.sum(F.when(on, F.col("weight_kg"))), F.lit(0.0)).alias("weight_kg"), F.coalesce(F.sum(F.when(on, F.col("l") * F.col("w") * F.col("h"))), F.lit(0.0)).alias("volume_m3"),
    )
