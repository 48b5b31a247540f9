"""Cargo queries on placed_items and cargo_bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import cargo as cg
from tidewater.operators.stowage import stow_vessels
from tidewater.queries.registry import Registry
from tidewater.sources.tables import first_rows, table

query = Registry()

COLUMNS = ["manifest_id", "item_position", "bin_type", "bin_id", "hold_id", "level", "x", "y", "z", "l", "w", "h", "rotation_deg", "weight_kg", "can_stack", "is_pinned"]
_ITEMS = "(SELECT * FROM placed_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "placed_items"), "id", COLUMNS).drop("first_loaded")


@query("manifest_totals", f"SELECT manifest_id, count(*) AS items, round(coalesce(sum(weight_kg), 0), 3) AS weight_kg, round(coalesce(sum(coalesce(l,0)*coalesce(w,0)*coalesce(h,0)), 0), 4) AS volume_m3 FROM {_ITEMS} GROUP BY 1")
def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    t = cg.manifest_totals(items(spark, d))
    return t.select("manifest_id", "items", F.round("weight_kg", 3).alias("weight_kg"), F.round("volume_m3", 4).alias("volume_m3"))


@query("hold_weights", f"SELECT manifest_id, hold_id, round(coalesce(sum(weight_kg), 0), 3) AS weight_kg FROM {_ITEMS} WHERE hold_id IS NOT NULL GROUP BY 1, 2")
def hold_weights(spark: SparkSession, d: str) -> DataFrame:
    return cg.hold_weights(items(spark, d), ["manifest_id", "hold_id"]).withColumn("weight_kg", F.round("weight_kg", 3))


def levels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Placed items, and one bin per manifest, hold and level that they use, of the manifest's container type."""
    p = items(spark, d).where("hold_id is not null")
    b = p.select("manifest_id", "hold_id", "level", "bin_type").distinct().join(F.broadcast(table(spark, d, "cargo_bins")), "bin_type")
    return p, b.withColumn("volume_m3", F.col("length") * F.col("width") * F.col("height"))


_PLACED = f"(SELECT * FROM {_ITEMS} WHERE hold_id IS NOT NULL)"
_BINS = f"(SELECT DISTINCT manifest_id, hold_id, level, length * width * height AS v FROM {_PLACED} JOIN cargo_bins USING (bin_type))"


@query(
    "hold_fill",
    f"""
SELECT b.manifest_id, b.hold_id, round(avg(100.0 * coalesce(u.used, 0) / b.v), 6) AS mean_fill, round(100.0 * sum(coalesce(u.used, 0)) / sum(b.v), 6) AS volume_fill
FROM {_BINS} b LEFT JOIN (SELECT manifest_id, hold_id, level, sum(coalesce(l,0)*coalesce(w,0)*coalesce(h,0)) AS used FROM {_PLACED} GROUP BY 1, 2, 3) u
  ON u.manifest_id = b.manifest_id AND u.hold_id = b.hold_id AND u.level IS NOT DISTINCT FROM b.level GROUP BY 1, 2
""",
)
def hold_fill(spark: SparkSession, d: str) -> DataFrame:
    p, b = levels(spark, d)
    f = cg.fill_rates(p, b, ["manifest_id", "hold_id"])
    return f.select("manifest_id", "hold_id", F.round("mean_fill", 6).alias("mean_fill"), F.round("volume_fill", 6).alias("volume_fill"))


@query(
    "hold_balance",
    f"""
WITH t AS (SELECT manifest_id, sum(weight_kg) AS total FROM {_PLACED} GROUP BY 1),
s AS (SELECT manifest_id, coalesce(level, 'main') AS lv, v / sum(v) OVER (PARTITION BY manifest_id) AS share FROM {_BINS}),
g AS (SELECT s.manifest_id, s.lv, sum(s.share * t.total) AS target FROM s JOIN t USING (manifest_id) GROUP BY 1, 2),
a AS (SELECT manifest_id, coalesce(level, 'main') AS lv, sum(weight_kg) AS actual FROM {_PLACED} GROUP BY 1, 2)
SELECT g.manifest_id, greatest(0.0, round_even(100.0 * (1.0 - avg(abs(coalesce(a.actual, 0) - g.target)) / CASE WHEN max(g.target) = 0 THEN 1 ELSE max(g.target) END), 2)) AS balance
FROM g LEFT JOIN a USING (manifest_id, lv) GROUP BY 1
""",
)
def hold_balance(spark: SparkSession, d: str) -> DataFrame:
    """Balance over the levels of a manifest's hold."""
    p, b = levels(spark, d)
    name = F.coalesce("level", F.lit("main")).alias("lv")
    totals = p.groupBy("manifest_id").agg(F.sum("weight_kg").alias("weight_kg"))
    targets = cg.weight_targets(b.withColumn("lv", name), totals, "manifest_id", "lv")
    actuals = p.withColumn("lv", name).groupBy("manifest_id", "lv").agg(F.sum("weight_kg").alias("weight_kg"))
    return cg.balance_scores(targets, actuals, "manifest_id", "lv")


@query(
    "box_overlaps",
    f"""
SELECT a.manifest_id, a.hold_id, a.level, a.id AS a_id, b.id AS b_id
FROM {_PLACED} a JOIN {_PLACED} b ON a.manifest_id = b.manifest_id AND a.hold_id = b.hold_id AND a.level IS NOT DISTINCT FROM b.level AND a.id < b.id
WHERE a.l > 0 AND a.w > 0 AND a.h > 0 AND b.l > 0 AND b.w > 0 AND b.h > 0
  AND NOT (a.x + a.l <= b.x + 1e-6 OR b.x + b.l <= a.x + 1e-6 OR a.y + a.h <= b.y + 1e-6 OR b.y + b.h <= a.y + 1e-6 OR a.z + a.w <= b.z + 1e-6 OR b.z + b.w <= a.z + 1e-6)
""",
)
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    p = items(spark, d).where("hold_id is not null")
    return cg.overlaps(p, p, ["manifest_id", "hold_id", "level"])


@query(
    "placement_check",
    f"""
WITH m AS (SELECT i.*, b.length, b.width, b.height, CASE WHEN ((coalesce(rotation_deg, 0) % 360) + 360) % 360 IN (90, 270) THEN coalesce(w, 0) ELSE coalesce(l, 0) END AS ll,
    CASE WHEN ((coalesce(rotation_deg, 0) % 360) + 360) % 360 IN (90, 270) THEN coalesce(l, 0) ELSE coalesce(w, 0) END AS ww
  FROM {_PLACED} i JOIN cargo_bins b USING (bin_type))
SELECT id, CASE WHEN coalesce(rotation_deg, 0) NOT IN (0, 90) THEN 'rotation' WHEN ll <= 0 OR ww <= 0 OR coalesce(h, 0) <= 0 THEN 'no measures'
  WHEN x < -1e-6 OR y < -1e-6 OR z < -1e-6 THEN 'negative corner' WHEN x + ll > length + 1e-6 THEN 'beyond length'
  WHEN z + ww > width + 1e-6 THEN 'beyond breadth' WHEN y + h > height + 1e-6 THEN 'beyond height' END AS reason FROM m
""",
)
def placement_check(spark: SparkSession, d: str) -> DataFrame:
    """Rules of every stored placement but the overlaps."""
    p = items(spark, d).where("hold_id is not null")
    b = table(spark, d, "cargo_bins").select(F.col("bin_type").alias("id"), "length", F.col("width").alias("breadth"), "height", F.lit(False).alias("has_tween"), F.lit(0.0).alias("lower_height"), F.lit(0.0).alias("upper_height"))
    moves = p.select("id", "manifest_id", F.col("bin_type").alias("hold_id"), F.lit(None).cast("string").alias("level"), "x", "y", "z", "rotation_deg", "l", "w", "h", F.lit(True).alias("can_rotate"))
    none = p.where("false").select("id", "manifest_id", F.col("bin_type").alias("hold_id"), F.lit(None).cast("string").alias("level"), "x", "y", "z", "l", "w", "h")
    return cg.check_placements(moves, b, none, ["manifest_id", "hold_id", "level"])


@query(
    "placement_join",
    f"SELECT i.manifest_id, i.id, i.level, b.max_weight_kg, i.weight_kg / b.max_weight_kg AS load FROM {_PLACED} i JOIN cargo_bins b USING (bin_type) WHERE i.is_pinned",
)
def placement_join(spark: SparkSession, d: str) -> DataFrame:
    """Pinned placements with the capacity of their container."""
    p = items(spark, d).where("hold_id is not null and is_pinned")
    j = p.join(F.broadcast(table(spark, d, "cargo_bins")), "bin_type")
    return j.select("manifest_id", "id", "level", "max_weight_kg", (F.col("weight_kg") / F.col("max_weight_kg")).alias("load"))


@query(
    "global_positions",
    f"SELECT id, row_number() OVER (ORDER BY manifest_id, item_position, id) - 1 AS position FROM {_ITEMS}",
)
def global_positions(spark: SparkSession, d: str) -> DataFrame:
    return cg.global_positions(items(spark, d), ["manifest_id", "item_position", "id"]).select("id", F.col("position").cast("long").alias("position"))


@query(
    "deadweight_kg",
    """
SELECT id, CASE WHEN v < 100000 THEN v * 1000 ELSE v END AS kg
FROM (SELECT id, TRY_CAST(nullif(regexp_extract(replace(lower(dwat), ',', ''), '([0-9.]+)', 1), '') AS DOUBLE) AS v FROM (SELECT id, arg_min(dwat, loaded_at) AS dwat FROM vessels GROUP BY id))
""",
)
def deadweight_kg(spark: SparkSession, d: str) -> DataFrame:
    v = first_rows(table(spark, d, "vessels"), "id", ["dwat"])
    return v.select("id", cg.parse_deadweight_kg(F.col("dwat")).alias("kg"))


@query("stowage")
def stowage(spark: SparkSession, d: str) -> DataFrame:
    """Every manifest stowed afresh into one container of its type."""
    it = items(spark, d)
    b = it.select("manifest_id", "bin_type").distinct().join(F.broadcast(table(spark, d, "cargo_bins")), "bin_type")
    bins = b.select(F.col("manifest_id").alias("vessel_id"), F.col("bin_type").alias("bin_id"), "length", "width", "height", (F.col("length") * F.col("width") * F.col("height")).alias("volume_m3"), "max_weight_kg")
    own = it.select(F.col("manifest_id").alias("vessel_id"), "id", F.col("item_position").alias("position"), "l", "w", "h", "weight_kg", "can_stack", F.lit(True).alias("can_rotate"), F.lit(False).alias("pinned"), "bin_id", "x", "y", "z", "rotation_deg")
    return stow_vessels(bins, own)
