import math

import pandas as pd
import pytest

import tallywise as tw

ROWS = [
    ("a", "x", 1.0, "p"),
    ("a", "x", 2.0, "q"),
    ("a", "y", None, "p"),
    ("b", "y", math.nan, None),
    ("b", "x", None, "r"),
    ("c", None, 5.0, "p"),
    (None, "z", 7.0, "p"),
    ("d", "w", None, "s"),
    ("d", "x", 4.0, "s"),
    ("d", "x", 4.0, "s"),
]
COLUMNS = ["k", "c", "v", "t"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k string, c string, v double, t string").cache()


def expected(agg, column=None):
    function = {"SUM": "sum", "COUNT": "count", "COUNT_UNIQUE": pd.Series.nunique, "MEAN": "mean", "MEDIAN": "median"}
    table = pd.pivot_table(
        pd.DataFrame(ROWS, columns=COLUMNS), index="k", columns=column, values="v", aggfunc=function[agg], fill_value=0
    )
    return table.reset_index()


@pytest.mark.parametrize("agg", ["SUM", "COUNT", "COUNT_UNIQUE", "MEAN", "MEDIAN"])
@pytest.mark.parametrize("column", [None, "c"])
def test_pivot_drops_and_fills_like_pandas(df, agg, column):
    want = expected(agg, column)
    got = tw.pivot(df, "k", "v", agg.lower(), column).toPandas()
    assert got.columns.tolist() == want.columns.tolist()
    assert got.values.tolist() == want.values.tolist()


def test_count_of_text(df):
    got = {r["k"]: r["t"] for r in tw.pivot(df, "k", "t", "COUNT_UNIQUE").collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_order_and_limit(df):
    top = tw.pivot(df, "k", "v", "SUM", order_by="v", direction="DESC", limit=2).collect()
    assert [r["k"] for r in top] == ["d", "c"]
    by_label = tw.pivot(df, "k", "v", "SUM", "c", order_by="x", direction="DESC").collect()
    assert [r["k"] for r in by_label] == ["d", "a", "b"]
    assert [r["k"] for r in tw.pivot(df, "k", "v", "COUNT", limit="3").collect()] == ["a", "b", "c"]
    assert {r["k"] for r in tw.pivot(df, "k", "v", "COUNT", sort=False).collect()} == {"a", "b", "c", "d"}


def test_where_comes_first(df):
    got = tw.pivot(df, "k", "v", "SUM", "c", where=tw.ne("k", "d")).toPandas()
    assert got.columns.tolist() == ["k", "x", "y"]


def test_booleans_are_numbers(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (2, None)], "k int, b boolean")
    assert [tuple(r) for r in tw.pivot(df, "k", "b", "SUM").collect()] == [(1, 1), (2, 1)]
    assert [tuple(r) for r in tw.pivot(df, "k", "b", "MEDIAN").collect()] == [(1, 0.5), (2, 1.0)]
    assert tw.pivot(df, "k", "k", "COUNT", "b").columns == ["k", "False", "True"]


def test_labels(spark):
    rows = [(2.5, "A"), (2.5, "a"), (-1.0, "a"), (math.nan, "a"), (None, "b"), (10.0, "A")]
    df = spark.createDataFrame(rows, "x double, s string")
    assert tw.pivot_labels(df, "x") == [-1.0, 2.5, 10.0]
    assert tw.pivot_labels(df, "s") == ["A", "a", "b"]
    # Labels that differ in case only, and labels that are numbers.
    assert tw.pivot(df, "x", "x", "COUNT", "s", order_by="a", direction="DESC").columns == ["x", "A", "a"]
    wide = tw.pivot(df, "s", "x", "COUNT", "x", order_by=2.5)
    assert wide.columns == ["s", "-1.0", "2.5", "10.0"]
    assert [tuple(r) for r in wide.collect()] == [("A", 0, 1, 1), ("a", 1, 1, 0)]


def test_too_many_labels(spark):
    spark.conf.set("spark.sql.pivotMaxValues", 5)
    try:
        with pytest.raises(ValueError):
            tw.pivot_labels(spark.range(10), "id")
        assert len(tw.pivot_labels(spark.range(5), "id")) == 5
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_nothing_left(df):
    empty = tw.pivot(df, "k", "v", "MEAN", "c", where=tw.eq("k", "b"))
    assert empty.columns == ["k"] and empty.collect() == []
    assert tw.pivot(df, "k", "v", "SUM", where=tw.eq("k", "none")).collect() == []


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], ["a.b", "kind/Other`Name", "v 1"])
    got = tw.pivot(df, "kind/Other`Name", "v 1", "SUM", "a.b")
    assert got.columns == ["kind/Other`Name", "1"]
    assert got.collect() == [("x", 2.0)]


@pytest.mark.parametrize(
    "call, error",
    [
        (lambda df: tw.pivot(df, "nope", "v", "SUM"), ValueError),
        (lambda df: tw.pivot(df, "k", "nope", "SUM"), ValueError),
        (lambda df: tw.pivot(df, "k", "v", "SUM", "nope"), ValueError),
        (lambda df: tw.pivot(df, "k", "v", "MODE"), ValueError),
        (lambda df: tw.pivot(df, "k", "t", "SUM"), TypeError),
        (lambda df: tw.pivot(df, "k", "t", "MEDIAN"), TypeError),
        (lambda df: tw.pivot(df, "k", "v", "SUM", order_by="k"), ValueError),
        (lambda df: tw.pivot(df, "k", "v", "SUM", "c", order_by="v"), ValueError),
        (lambda df: tw.pivot(df, "k", "v", "SUM", "k"), ValueError),
        (lambda df: tw.pivot(df, "k", "v", "SUM", order_by="v", direction="down"), ValueError),
        (lambda df: tw.pivot(df, "k", "v", "SUM", limit=0), ValueError),
        (lambda df: tw.pivot_labels(df, "nope"), ValueError),
    ],
)
def test_errors(df, call, error):
    with pytest.raises(error):
        call(df)


def test_a_label_may_have_the_row_columns_name(df):
    shown = tw.pivot(df.withColumnRenamed("k", "x"), "x", "v", "SUM", "c")
    plain = tw.pivot(df, "k", "v", "SUM", "c")
    assert shown.columns == ["x", *[c + "'" if c == "x" else c for c in plain.columns[1:]]]
    assert shown.collect() == plain.collect()


@pytest.mark.parametrize("order_by, direction", [(None, "ASC"), ("v", "DESC"), ("v", "ASC")])
def test_large_pivot_limit_is_located_not_gathered(spark, order_by, direction):
    df = spark.range(90_000).selectExpr("id % 30000 AS k", "CAST(id * 7919 % 101 AS BIGINT) AS v")
    result = tw.pivot(df, "k", "v", "SUM", order_by=order_by, direction=direction, limit=20_000)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "CollectLimit" not in plan and "SinglePartition" not in plan
    sums = {}
    for i in range(90_000):
        sums[i % 30000] = sums.get(i % 30000, 0) + i * 7919 % 101
    if order_by is None:
        want = sorted(sums.items())[:20_000]
    else:
        sign = -1 if direction == "DESC" else 1
        want = sorted(sums.items(), key=lambda kv: (sign * kv[1], kv[0]))[:20_000]
    assert [tuple(r) for r in result.collect()] == want


def test_approximate_count_unique_is_close_and_sketches_merge(spark):
    from pyspark.sql import functions as F

    from tallywise.functions.aggregates import sketch_of

    df = spark.range(200_000).selectExpr("id % 3 AS k", "id % 5 AS c", "id * 7 % 60013 AS v")
    exact = {tuple(r[:1]): r[1:] for r in tw.pivot(df, "k", "v", "COUNT_UNIQUE", "c").collect()}
    rough = {tuple(r[:1]): r[1:] for r in tw.pivot(df, "k", "v", "COUNT_UNIQUE", "c", approximate=True).collect()}
    assert exact.keys() == rough.keys()
    for key in exact:
        for a, b in zip(exact[key], rough[key]):
            assert abs(b - a) <= 0.05 * a
    one = tw.pivot(df, "k", "v", "COUNT_UNIQUE", approximate=True).collect()
    assert [r.k for r in one] == [0, 1, 2] and all(abs(r.v - 60013) <= 0.05 * 60013 for r in one)
    # Sketches of parts merge into the sketch of the whole.
    parts = df.groupBy("c").agg(sketch_of(F.col("v")).alias("s"))
    merged = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("e")).first().e
    whole = df.agg(F.hll_sketch_estimate(sketch_of(F.col("v"))).alias("e")).first().e
    assert merged == whole
