"""Every query of the subpackage runs on the smallest tables, has the agreed columns, and equals its SQL where it has one."""

import pytest

from tests.oracle import connect, same
from tidewater.llm import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.sql()
COLUMNS = {
    "p2_found": [("item_row_id", "bigint")], "p4_found": [("chunk_id", "bigint")], "p5_found": [("chunk_id", "bigint")], "p6_found": [("session_id", "bigint")], "p7_found": [("chunk_id", "bigint")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() == df.distinct().count() or not name.endswith("_found")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert QUERIES[name](spark, sf).dtypes == COLUMNS[name]


def test_token_ids_round_trip(spark, sf):
    import os

    from tidewater.llm.tokenizing import TOKENIZERS, VOCABULARY, vocabulary

    v = vocabulary(os.path.join(TOKENIZERS, VOCABULARY))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    ids = {r.doc_id: r.ids for r in QUERIES["p8_ids"](spark, sf).collect()}
    assert ids.keys() == texts.keys() and all(v.decode(ids[k]) == (t or "").encode() for k, t in texts.items())
