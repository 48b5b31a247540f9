"""Blocked windows equal plain ones."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.operators import analytics as an
from tidewater.operators import ordered as od


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(-50, 50), st.one_of(st.none(), st.integers(0, 5))), max_size=60, unique_by=lambda r: (r[0], r[1])))
def test_equal_to_windows(spark, rows):
    df = spark.createDataFrame(rows, "g int, o int, v int")
    w = W.partitionBy("g").orderBy("o")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    want = df.select("g", "o", F.lag("v").over(w).alias("lag"), F.coalesce(F.sum("v").over(up), F.lit(0)).alias("sum"), F.row_number().over(w).alias("n"), F.last("v", True).over(up).alias("fill"))
    got = od.lagged(df, ["g"], ["o"], "v", "lag", 7)
    got = od.running_sum(got, ["g"], ["o"], "v", "sum", 7)
    got = od.numbered(got, ["g"], ["o"], "n", 7)
    got = od.filled(got, ["g"], ["o"], "v", "fill", 7).select("g", "o", "lag", "sum", "n", "fill")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    top = od.top_rows(df, ["g"], [F.col("o").desc()], 3, F.col("o"), 4)
    assert sorted(top.select("g", "o").collect(), key=key) == sorted(df.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy(F.col("o").desc()))).where("k <= 3").select("g", "o").collect(), key=key)


def test_sliding_sum_across_blocks(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t + timedelta(seconds=7 * i), 1) for i in range(300)] + [("a", None, 5), ("b", t, None)], "k string, ts timestamp_ntz, v int")
    got = an.sliding_sum(df, "k", "ts", "v", 60, 2).collect()
    assert len(got) == 302
    sums = [r.window_sum for r in sorted((r for r in got if r.k == "a" and r.ts), key=lambda r: r.ts)]
    assert sums == [min(i + 1, 9) for i in range(300)]
    assert [r.window_sum for r in got if r.ts is None] == [5] and [r.window_sum for r in got if r.k == "b"] == [None]
