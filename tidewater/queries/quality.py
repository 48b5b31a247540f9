"""Queries of the general data-quality operators: p1 and p3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.references import find_orphans, orphan_report
from tidewater.operators.units import COMMON, normalise_units
from tidewater.queries.registry import Registry
from tidewater.sources.tables import table

query = Registry()

#: Referencing table, its column, the parent table and its key.
REFERENCES = [
    ("document_chunks", "document_id", "document_files", "id"),
    ("chat_messages", "session_id", "chat_sessions", "id"),
    ("dossier_section_configs", "client_id", "client_configs", "client_id"),
]


def all_orphans(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for child, ref, parent, key in REFERENCES:
        found = find_orphans(table(spark, d, child), table(spark, d, parent), "id", ref, key)
        parts.append(found.select(F.lit(child).alias("table_name"), "row_id", "ref_key", "first_loaded", "reason"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SQL_ONE = """
SELECT '{child}' AS table_name, c.id AS row_id, c.seen,
  CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' ELSE 'late' END AS reason
FROM (SELECT id, min(loaded_at) AS seen, arg_min({ref}, loaded_at) AS k FROM {child} GROUP BY id) c
LEFT JOIN (SELECT {key} AS k, min(loaded_at) AS seen,
             max(struct_pack(t := loaded_at, d := (deleted_at IS NOT NULL))).d AS gone
           FROM {parent} GROUP BY {key}) p ON p.k = c.k
WHERE c.k IS NOT NULL AND (p.k IS NULL OR p.gone OR p.seen > c.seen)
"""
_SQL_ALL = " UNION ALL ".join(_SQL_ONE.format(child=c, ref=r, parent=p, key=k) for c, r, p, k in REFERENCES)


@query("p1_found", f"SELECT table_name, row_id FROM ({_SQL_ALL}) x")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return all_orphans(spark, d).select("table_name", "row_id")


@query("p1_report", f"SELECT table_name, strftime(seen, '%Y-%m') AS month, reason, count(*) AS n FROM ({_SQL_ALL}) x GROUP BY ALL")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(all_orphans(spark, d))


def units_of_vessels(spark: SparkSession, d: str) -> DataFrame:
    return normalise_units(table(spark, d, "vessels"), table(spark, d, "spec_sources"))


@query("p3_values")
def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return units_of_vessels(spark, d)


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    common = [F.struct(F.lit(f).alias("field"), F.lit(u).alias("unit")) for f, u in COMMON.items()]
    return units_of_vessels(spark, d).where(~F.struct("field", "unit").isin(*common)).select("vessel_id", "field")
