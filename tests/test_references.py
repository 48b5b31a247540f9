"""Orphan references against brute force, and its defined edge cases."""

from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.operators.references import compress_runs, find_orphans

T = [datetime(2024, 1, d) for d in range(1, 10)]
REF = "id long, ref long, loaded_at timestamp_ntz, key string"
PAR = "key long, loaded_at timestamp_ntz, deleted_at timestamp_ntz, ref string"


def brute(refs, parents):
    first = {}
    for i, r, t in refs:
        if i is not None and (i not in first or (t or datetime.max) < (first[i][1] or datetime.max)):
            first[i] = (r, t)
    seen, last = {}, {}
    for k, t, g in parents:
        if k is None:
            continue
        seen[k] = min(seen.get(k, t), t)
        last[k] = max(last.get(k, (t, g is not None)), (t, g is not None))
    out = {}
    for i, (r, t) in first.items():
        if r is None:
            continue
        if r not in seen:
            out[i] = "missing"
        elif last[r][1]:
            out[i] = "deleted"
        elif t is not None and seen[r] > t:
            out[i] = "late"
    return out


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 30)), st.one_of(st.none(), st.integers(-3, 300)), st.sampled_from(T)), max_size=40),
    st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 300)), st.sampled_from(T), st.one_of(st.none(), st.sampled_from(T))), max_size=60),
)
def test_against_brute_force(spark, refs, parents):
    refs = list({(r[0], r[2]): r for r in refs}.values())
    parents = list({(p[0], p[1]): p for p in parents}.values())
    r = spark.createDataFrame([(*x, "k") for x in refs], REF)
    p = spark.createDataFrame([(*x, "r") for x in parents], PAR)
    got = {x.row_id: x.reason for x in find_orphans(r, p, "id", "ref", "key").collect()}
    assert got == brute(refs, parents)


def test_runs_are_contiguous_and_cut_at_blocks(spark):
    p = spark.createDataFrame([(k, T[0], None, "") for k in (1, 2, 3, 7, 8, 127, 128, 129)], PAR)
    runs = sorted((r["start"], r["end"]) for row in compress_runs(p, "key").collect() for r in row.runs)
    assert runs == [(1, 3), (7, 8), (127, 127), (128, 129)]


def test_string_keys_compare_exactly(spark):
    p = spark.createDataFrame([("acme_007", T[0], None), ("acme_08", T[0], None), ("plain", T[0], None)], "client_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    r = spark.createDataFrame([(i, k, T[1]) for i, k in enumerate(["acme_007", "acme_07", "acme_7", "ACME_007", " acme_007", "acme_08", "plain", "", None, "plain\n"])], "id long, client_id string, loaded_at timestamp_ntz")
    got = {x.row_id for x in find_orphans(r, p, "id", "client_id", "client_id").collect()}
    assert got == {1, 2, 3, 4, 7, 9}


def test_empty_tables_and_hot_parent(spark):
    p = spark.createDataFrame([], PAR)
    r = spark.createDataFrame([(i, 5, T[1], "") for i in range(50)], REF)
    assert find_orphans(r, p, "id", "ref", "key").count() == 50
    assert find_orphans(r.where("false"), p, "id", "ref", "key").count() == 0
