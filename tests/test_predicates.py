import math

import pytest
from pyspark.sql import types as T

import tallywise as tw

SCHEMA = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("odd name/x", T.IntegerType()),
    ]
)
ROWS = [
    (1, 1.5, "Andes", True, 1),
    (2, math.nan, "180+", False, 2),
    (None, None, None, None, None),
    (4, -2.0, "1800", True, 4),
    (5, math.inf, "ÉCOLE and", None, 5),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def kept(df, predicate):
    """0-based row numbers, told by the value of the first column (None is row 2)."""
    rows = [r["n"] for r in tw.where(df, predicate).collect()]
    return sorted(4 if n == 5 else 3 if n == 4 else 2 if n is None else n - 1 for n in rows)


@pytest.mark.parametrize(
    "predicate, expected",
    [
        (tw.eq("n", 2), [1]),
        (tw.eq("n", "2.0"), [1]),
        (tw.eq("n", 2.5), []),
        (tw.ne("n", 2.5), [0, 1, 2, 3, 4]),
        (tw.ne("n", 2), [0, 2, 3, 4]),
        (tw.gt("n", 1.5), [1, 3, 4]),
        (tw.ge("n", 1.5), [1, 3, 4]),
        (tw.gt("n", 2), [3, 4]),
        (tw.lt("n", 2.5), [0, 1]),
        (tw.le("n", 2.5), [0, 1]),
        (tw.lt("n", 2), [0]),
        (tw.gt("x", 0), [0, 4]),
        (tw.ge("x", -2), [0, 3, 4]),
        (tw.lt("x", 1e308), [0, 3]),
        (tw.le("x", "inf"), [0, 3, 4]),
        (tw.eq("x", 1.5), [0]),
        (tw.ne("x", 1.5), [1, 2, 3, 4]),
        (tw.eq("x", "nan"), []),
        (tw.ne("x", "nan"), [0, 1, 2, 3, 4]),
        (tw.gt("n", "nan"), []),
        (tw.gt("n", 1e300), []),
        (tw.eq("b", 1), [0, 3]),
        (tw.ne("b", "1"), [1, 2, 4]),
        (tw.eq("s", "180+"), [1]),
        (tw.eq("s", "andes"), []),
        (tw.ne("s", "180+"), [0, 2, 3, 4]),
        (tw.like("s", "180+"), [1]),
        (tw.like("s", "AND"), [0, 4]),
        (tw.like("s", "école"), [4]),
        (tw.like("s", "%"), []),
        (tw.regex_like("s", "180+"), [1, 3]),
        (tw.regex_like("s", "^é"), [4]),
        (tw.all_of(tw.gt("n", 1), tw.any_of(tw.lt("x", 0), tw.like("s", "ecole"), tw.eq("s", "180+"))), [1, 3]),
        (tw.any_of(tw.all_of(tw.eq("n", 1), tw.gt("x", 1)), tw.all_of(tw.eq("n", 4), tw.gt("x", 1))), [0]),
        (tw.gt("n", 1) & (tw.eq("n", 2) | tw.eq("n", 5)), [1, 4]),
        (tw.gt("odd name/x", 3), [3, 4]),
    ],
    ids=lambda v: "" if isinstance(v, list) else None,
)
def test_predicate(df, predicate, expected):
    assert kept(df, predicate) == expected


def test_match_count(df):
    assert tw.match_count(df, tw.gt("n", 1)).collect() == [(3,)]
    assert tw.match_count(df, tw.gt("n", 100)).collect() == [(0,)]


@pytest.mark.parametrize(
    "predicate, error",
    [
        (tw.eq("nope", 1), ValueError),
        (tw.eq("N", 1), ValueError),
        (tw.gt("n", "many"), TypeError),
        (tw.eq("x", None), TypeError),
        (tw.gt("s", 1), TypeError),
        (tw.like("n", "1"), TypeError),
        (tw.regex_like("b", "t"), TypeError),
    ],
)
def test_predicate_errors(df, predicate, error):
    with pytest.raises(error):
        tw.where(df, predicate)


def test_empty_group():
    with pytest.raises(ValueError):
        tw.all_of()


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(1, 9007199254740992, "1.10", 0.1, "5", "2024-05-01"), (2, 9007199254740993, "2.00", 0.5, "05", "2024-05-02")]
    raw = spark.createDataFrame(rows, "id long, big long, d string, f double, s string, day string")
    casts = ["id", "big", "CAST(d AS DECIMAL(20, 2)) d", "CAST(f AS FLOAT) f", "s", "CAST(day AS DATE) day"]
    return raw.selectExpr(*casts)


@pytest.mark.parametrize(
    "predicate, want",
    [
        (tw.eq("big", 9007199254740993), [2]),
        (tw.eq("big", "9007199254740993"), [2]),
        (tw.gt("big", 9007199254740992), [2]),
        (tw.lt("big", 10**30), [1, 2]),
        (tw.gt("big", 10**30), []),
        (tw.ne("big", 10**30), [1, 2]),
        (tw.ge("big", -float("inf")), [1, 2]),
        (tw.gt("d", 1.1), [2]),
        (tw.ge("d", "1.101"), [2]),
        (tw.le("d", 1.999), [1]),
        (tw.eq("d", 1.105), []),
        (tw.eq("f", 0.1), [1]),
        (tw.eq("s", 5), [1]),
        (tw.ne("s", 5), [2]),
        (tw.eq("day", "2024-05-02"), [2]),
    ],
)
def test_literals_keep_the_columns_type(typed, predicate, want):
    assert sorted(r["id"] for r in tw.where(typed, predicate).collect()) == want


def test_literals_that_cannot_be_dates_raise(typed):
    for value in ("soon", 5):
        with pytest.raises(TypeError):
            tw.where(typed, tw.eq("day", value))
