"""Order statistics against sorting, with thresholds low enough to take the distributed path."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import tallywise as tw
from tallywise.operators.grouping import aggregate, spread_median
from tallywise.operators.selection import positions

PROBS = [0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 0.999, 1]


def check(spark, values, kind, sortable, parts=5):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(parts)
    got = tw.exact_quantiles(df, "v", PROBS, sortable=sortable)
    want = pd.Series(values).quantile(PROBS).tolist()
    assert got == pytest.approx(want, rel=1e-12, abs=1e-8, nan_ok=True)


def skewed(n, seed=7):
    rng = random.Random(seed)
    return [3.25 if rng.random() < 0.35 else round(rng.lognormvariate(1, 2), 2) for _ in range(n)]


@pytest.mark.parametrize("sortable", [10**6, 200, 5])
def test_quantiles_of_skewed_values(spark, sortable):
    check(spark, skewed(4_000), "double", sortable)


@pytest.mark.parametrize("sortable", [10**6, 40])
def test_quantiles_of_few_values(spark, sortable):
    check(spark, [i % 7 for i in range(1_000)], "long", sortable)
    check(spark, [5] * 300, "long", sortable)
    check(spark, [1.5], "double", sortable)


def test_quantiles_of_integers_beyond_double_precision(spark):
    base = 2**62
    values = [base + random.Random(1).randrange(3_000) for _ in range(50)] + [base + i for i in range(2_000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    found = positions(df, ["v"], len(values), [0, 700, 1_500, len(values) - 1], sortable=20)
    ordered = sorted(values)
    for rank, place in found.items():
        assert place.keys == (ordered[rank],)
        assert place.first == ordered.index(ordered[rank])
        assert place.rows == ordered.count(ordered[rank])


def test_quantiles_with_infinities(spark):
    values = [math.inf] * 100 + [-math.inf] * 100 + [float(i) for i in range(100)] + [1.7976931348623157e308] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    ranks = [0, 99, 100, 150, 240, 249, 250, len(values) - 1]
    found = positions(df, ["v"], len(values), ranks, sortable=20)
    assert [found[r].keys[0] for r in ranks] == [ordered[r] for r in ranks]


@pytest.mark.parametrize("few_values", [False, True])
@pytest.mark.parametrize("sortable", [10**6, 300, 10])
def test_positions_in_a_chain_of_keys(spark, sortable, few_values):
    rng = random.Random(3)
    rows = [(float(rng.choice([1, 1, 1, 2, 9])), rng.randrange(40), rng.randrange(3)) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "a double, b long, c long").repartition(4)
    ordered = sorted(rows)
    ranks = list(range(0, 2_000, 97)) + [1_999]
    found = positions(df, ["a", "b", "c"], len(rows), ranks, [500], sortable, few_values)
    for rank in ranks:
        place = found[rank]
        assert place.keys == ordered[rank][: len(place.keys)]
        same = [i for i, row in enumerate(ordered) if row[: len(place.keys)] == place.keys]
        assert (place.first, place.rows) == (same[0], len(same))
        # A shortened key must end exactly at the rank asked for.
        assert len(place.keys) == 3 or place.last == rank
    assert found[500].keys[0] == ordered[500][0]


def test_quantiles_ignore_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,), (4.0,)], "v double")
    assert tw.exact_quantiles(df, "v", [0, 0.5, 1]) == [1.0, 2.5, 4.0]
    assert tw.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    with pytest.raises(ValueError):
        tw.exact_quantiles(df, "v", [1.5])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, -0.0, 1.0, 2.5]), min_size=1, max_size=120),
    st.sampled_from([3, 25, 10**6]),
)
def test_quantiles_property(spark, values, sortable):
    check(spark, values, "double", sortable, parts=3)


def test_median_of_a_hot_group_without_gathering_it(spark):
    rng = random.Random(5)
    rows = [("hot", 7.0 if rng.random() < 0.3 else round(rng.gauss(7, 3), 1)) for _ in range(6_000)]
    rows += [(f"g{i % 50}", float(rng.randrange(100))) for i in range(500)] + [("single", 4.5), ("pair", 1.0), ("pair", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k").v.median().to_dict()
    spread = {r["k"]: r["m"] for r in spread_median(df, ["k"], "v", "m", len(rows)).collect()}
    assert spread == pytest.approx(want)
    chosen = {r["k"]: r["m"] for r in aggregate(df, ["k"], "v", "MEDIAN", "m", group_rows=1_000).collect()}
    assert chosen == pytest.approx(want)


@pytest.mark.parametrize("sampled", [0.01, 1])
def test_results_do_not_depend_on_the_sample(spark, monkeypatch, sampled):
    from tallywise.operators import selection

    monkeypatch.setattr(selection, "SAMPLED_PER_SPLIT", sampled)
    check(spark, skewed(3_000), "double", 50)
    rows = [(i % 2, v) for i, v in enumerate(skewed(3_000))]
    df = spark.createDataFrame(rows, "k int, v double")
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k").v.median().to_dict()
    assert {r["k"]: r["m"] for r in spread_median(df, ["k"], "v", "m", len(rows)).collect()} == pytest.approx(want)


def test_iqr(spark):
    values = [float(i) for i in range(100)] + [1e4, -1e4, None, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert tw.iqr_filter(df, "v").count() == 100
    s = pd.Series(values).dropna()
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    report = tw.iqr_report(df, "v").first()
    assert tuple(report) == pytest.approx((q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), 100, 2))
    with pytest.raises(ValueError):
        tw.iqr_report(df.limit(0), "v")


def test_profile_and_value_counts(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,), (math.nan,)], "v double")
    assert tuple(tw.profile(df, "v").first()) == ("double", 1.0, 2.0, 2, 5, 2)
    assert tw.profile(df, "v", approximate=True).first()["distinct_values"] == 2
    assert [tuple(r) for r in tw.value_counts(df, "v").collect()] == [(1.0, 2), (2.0, 1)]
    with pytest.raises(TypeError):
        tw.exact_quantiles(df.selectExpr("string(v) v"), "v", [0.5])


def test_numpy_agrees_on_interpolation(spark):
    values = np.random.default_rng(2).normal(size=501).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = np.linspace(0, 1, 37).tolist()
    assert tw.exact_quantiles(df, "v", probs) == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-14)


def test_one_hot_and_many_small_groups(spark):
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, -1, id) AS k", "id * 7919 % 30011 * 1.0D AS v")
    plain, spread = (
        {r["k"]: r["m"] for r in aggregate(df, ["k"], "v", "MEDIAN", "m", group_rows=n).collect()} for n in (10**6, 1_000)
    )
    assert spread == plain and len(plain) == 20_001


def test_long_decimals_are_not_ranked(spark):
    import tallywise as tw

    df = spark.range(20).selectExpr("CAST(id AS DECIMAL(38, 10)) / 3 AS d", "CAST(id AS DECIMAL(12, 2)) AS short")
    for call in (lambda c: tw.exact_quantiles(df, c, [0.5]), lambda c: tw.equal_count_bins(df, c)):
        with pytest.raises(TypeError):
            call("d")
        call("short")


def test_median_cells_split_again_until_small(spark, monkeypatch):
    """Few first ranges make the middle cells hold thousands of rows; with a bound of 40 rows they
    are split again twice or more, and the medians stay exact (ties, a hot value, an even count)."""
    import random

    from tallywise.operators import grouping

    monkeypatch.setattr(grouping, "MEDIAN_RANGES", 2)
    monkeypatch.setattr(grouping, "SPLITS", 2)
    rng = random.Random(5)
    rows = [("hot", float(rng.randint(0, 10**6))) for _ in range(30_000)]
    rows += [("hot", 7.0)] * 4_000 + [("even", float(i % 997)) for i in range(20_000)] + [("one", 3.0)] * 50
    df = spark.createDataFrame(rows, "k string, v double")
    rounds = []
    original = grouping.stored

    def noted(table, name):
        if name == "median_parts":
            rounds.append(name)
        return original(table, name)

    monkeypatch.setattr(grouping, "stored", noted)
    got = {r["k"]: r["m"] for r in grouping.spread_median(df, ["k"], "v", "m", len(rows), cell_rows=40).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        want[key] = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    assert got == want
    assert len(rounds) >= 2
