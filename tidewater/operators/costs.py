"""Nested cost statements: categories of items of costs with comments.

A statement is (statement_id, currency, categories), where categories is an array
of struct(name, items array of struct(name, costs array of struct(stage, persona,
amount), comments array of struct(text, author))). ``STATEMENT`` is its schema for
``from_json``. Missing names read ``Unknown``; null amounts count 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATEMENT = (
    "categories array<struct<name: string, items: array<struct<name: string, costs: array<struct<stage: string, persona: string, amount: double>>, "
    "comments: array<struct<text: string, author: string>>>>>>"
)


def cost_items(statements: DataFrame) -> DataFrame:
    """One row per item: (statement_id, currency, pos, category, item, costs, comments), ``pos`` in document order."""
    c = statements.select("statement_id", "currency", F.posexplode_outer("categories").alias("_ci", "_c"))
    i = c.select("statement_id", "currency", "_ci", F.coalesce("_c.name", F.lit("Unknown")).alias("category"), F.posexplode_outer("_c.items").alias("_ii", "_i"))
    kept = i.where("_i is not null")
    return kept.select("statement_id", "currency", F.struct("_ci", "_ii").alias("pos"), "category", F.coalesce("_i.name", F.lit("Unknown")).alias("item"), F.coalesce("_i.costs", F.array().cast("array<struct<stage: string, persona: string, amount: double>>")).alias("costs"), "_i.comments")


def amount_of(costs: Column, stage: str, persona: str) -> Column:
    """The last amount of the stage and persona, null if there is none."""
    hits = F.filter(costs, lambda c: (c["stage"] == stage) & (c["persona"] == persona))
    return F.try_element_at(F.transform(hits, lambda c: F.coalesce(c["amount"], F.lit(0.0))), F.lit(-1))


def selected_amount(costs: Column, stage: str = "PDA", persona: str = "OPERATOR") -> Column:
    """The chosen stage's amount, else the other stage's for the operator, else the sum of all."""
    other = "FDA" if stage.upper() == "PDA" else "PDA"
    total = F.aggregate(costs, F.lit(0.0), lambda s, c: s + F.coalesce(c["amount"], F.lit(0.0)))
    return F.coalesce(amount_of(costs, stage.upper(), persona.upper()), amount_of(costs, other, "OPERATOR"), total)


def breakdown(statements: DataFrame, stage: str = "PDA", persona: str = "OPERATOR") -> DataFrame:
    """Items with their selected amount and all amounts by stage and persona (the last of each key)."""
    i = cost_items(statements)
    keys = F.array_distinct(F.transform("costs", lambda c: F.concat_ws("_", c["stage"], c["persona"])))
    value = lambda k: F.try_element_at(F.transform(F.filter("costs", lambda c: F.concat_ws("_", c["stage"], c["persona"]) == k), lambda c: c["amount"]), F.lit(-1))
    return i.select("statement_id", "pos", "category", "item", "currency", selected_amount(F.col("costs"), stage, persona).alias("amount"), F.map_from_arrays(keys, F.transform(keys, value)).alias("by_key"), F.coalesce("comments", F.array().cast("array<struct<text: string, author: string>>")).alias("comments"))


def meaningful(rows: DataFrame) -> DataFrame:
    """Items with an amount or comments, and ``content_score``: ten per comment, one for an amount."""
    n = F.size("comments")
    return rows.where((F.col("amount") > 0) | (n > 0)).withColumn("content_score", n * 10 + F.when(F.col("amount") > 0, 1).otherwise(0))


def positive_rows(rows: DataFrame) -> DataFrame:
    """Items with a positive amount; amounts that are no numbers count 0."""
    return rows.where(F.coalesce(F.col("amount").cast("string").try_cast("double"), F.lit(0.0)) > 0)


def statement_totals(rows: DataFrame) -> DataFrame:
    """(statement_id, total, currency of the last positive row)."""
    p = positive_rows(rows)
    return p.groupBy("statement_id").agg(F.sum("amount").alias("total"), F.max_by("currency", "pos").alias("currency"))


def notes(rows: DataFrame, most: int = 180) -> DataFrame:
    """(statement_id, note): category totals in alphabetical order as text."""
    t = rows.groupBy("statement_id", "category").agg(F.sum("amount").alias("total"))
    g = t.groupBy("statement_id").agg(F.sort_array(F.collect_list(F.struct("category", "total"))).alias("_t"))
    lines = F.transform(F.slice("_t", 1, most), lambda x: F.concat(F.lit("- "), x["category"], F.lit(": "), F.format_number(x["total"], 2)))
    return g.select("statement_id", F.array_join(lines, "\n").alias("note"))


def exact_or_fuzzy(rows: DataFrame, key: str, exact: Column, fuzzy: Column) -> DataFrame:
    """Per key its exact hits; its fuzzy ones only where it has no exact one."""
    hits = rows.withColumn("_e", exact).withColumn("_f", fuzzy).where("_e or _f")
    any_exact = hits.groupBy(key).agg(F.bool_or("_e").alias("_any"))
    return hits.join(any_exact, key).where(F.col("_e") | ~F.col("_any")).drop("_e", "_f", "_any")


def commonest(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the commonest value; of equals the first seen by ``order``."""
    g = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("_o"))
    best = g.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_o"))).alias("r"))
    return best.select(key, f"r.{value}", "r.n")


def first_known(record: Column, names: list[str]) -> Column:
    """The first non-null field of a map under alternative names."""
    return F.coalesce(*[F.try_element_at(record, F.lit(n)) for n in names])
