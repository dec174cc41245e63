import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import tallywise as tw

FUNCTIONS = {"SUM": "sum", "COUNT": "count", "COUNT_UNIQUE": pd.Series.nunique, "MEAN": "mean", "MEDIAN": "median"}


def cut(frame, column):
    """Equal-width bins by pandas: labels D1 to Dk."""
    frame = frame.dropna(subset=[column]).copy()
    k = min(10, frame[column].nunique())
    edges = np.linspace(frame[column].min(), frame[column].max(), k + 1)
    edges[-1] = frame[column].max() + 1e-10
    names = [f"D{i + 1}" for i in range(k)]
    frame["decile"] = pd.cut(frame[column], bins=edges, labels=names, include_lowest=True)
    labels = {n: f"{n} [{a:.4f}, {b:.4f})" for n, a, b in zip(names, edges, edges[1:])}
    return frame, labels


def records(n=600, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = rng.choice([None, math.nan]) if rng.random() < 0.05 else round(rng.expovariate(0.05), 1)
        g = None if rng.random() < 0.2 else rng.choice("pqr")
        v = None if x is None or x > 60 or rng.random() < 0.2 else rng.randrange(20)
        rows.append((i, x, g, v))
    return rows


SCHEMA = "id long, x double, g string, v long"


def same(got, want):
    assert got.columns.tolist() == want.columns.tolist()
    for a, b in zip(got.values.tolist(), want.values.tolist()):
        assert a == pytest.approx(b, nan_ok=True) if not isinstance(a[0], str) else a[0] == b[0]
        assert [float(x) for x in a[1:]] == pytest.approx([float(x) for x in b[1:]], nan_ok=True)
    assert len(got) == len(want)


@pytest.mark.parametrize("agg", list(FUNCTIONS))
def test_deciles_like_pandas(spark, agg):
    rows = records()
    frame, labels = cut(pd.DataFrame(rows, columns=["id", "x", "g", "v"]), "x")
    want = frame.groupby("decile", observed=False)["v"].agg(FUNCTIONS[agg]).reset_index(name=agg.lower())
    want["decile"] = want["decile"].map(labels).astype(str)
    same(tw.deciles(spark.createDataFrame(rows, SCHEMA), "x", "v", agg).toPandas(), want)


@pytest.mark.parametrize("agg", list(FUNCTIONS))
def test_decile_crosstab_like_pandas(spark, agg):
    rows = records()
    frame, labels = cut(pd.DataFrame(rows, columns=["id", "x", "g", "v"]), "x")
    want = pd.pivot_table(
        frame, index="decile", columns="g", values="v", aggfunc=FUNCTIONS[agg], fill_value=0, observed=False
    ).reset_index()
    want["decile"] = want["decile"].map(labels).astype(str)
    same(tw.deciles(spark.createDataFrame(rows, SCHEMA), "x", "v", agg, "g").toPandas(), want)


def test_values_on_the_edges(spark):
    rows = [(float(i),) for i in range(11) for _ in range(i + 1)]
    df = spark.createDataFrame(rows, "x double")
    frame, _ = cut(pd.DataFrame(rows, columns=["x"]), "x")
    want = frame.decile.cat.codes.add(1).value_counts().to_dict()
    got = {r["bin"]: r["count"] for r in tw.equal_width_bins(df, "x").groupBy("bin").count().collect()}
    assert got == want


@pytest.mark.parametrize("values", [[1, 2], [1, 2, 2, 9], [3, 1, 2, 7, 5, 6, 4, 8, 9]])
def test_fewer_bins_for_fewer_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    got = tw.deciles(df, "x", "x", "COUNT").toPandas()
    frame, labels = cut(pd.DataFrame({"x": values}), "x")
    assert got["decile"].tolist() == list(labels.values())
    assert got["count"].tolist() == frame.decile.value_counts(sort=False).tolist()


def expected_bins(n):
    return np.maximum(1, (10 * np.arange(n) + n - 2) // (n - 1))


@pytest.mark.parametrize("sortable", [10**6, 50])
def test_equal_count_bins_match_the_quantile_rule(spark, sortable):
    values = random.Random(9).sample(range(10_000), 997)
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
    got = {r["x"]: r["bin"] for r in tw.equal_count_bins(df, "x", "x", sortable=sortable).collect()}
    want = pd.qcut(pd.Series(values), 10, labels=False) + 1
    assert [got[v] for v in values] == want.tolist()


@pytest.mark.parametrize("tiebreak", ["id", ["id", "g"], None, "g", "day", "ratio"])
@pytest.mark.parametrize("sortable", [10**6, 60])
def test_equal_count_bins_with_heavy_ties(spark, tiebreak, sortable):
    rng = random.Random(2)
    rows = [(i, 5.0 if rng.random() < 0.4 else float(rng.randrange(12)), rng.choice("pqr")) for i in range(1_003)]
    df = spark.createDataFrame(rows, "id long, x double, g string").selectExpr(
        "*", "date_add(date '2024-01-01', int(id % 50)) day", "IF(id % 3 = 0, NULL, id / 7) ratio"
    )
    binned = tw.equal_count_bins(df, "x", tiebreak, sortable=sortable).toPandas().sort_values(["x", "bin"])
    assert binned["bin"].tolist() == expected_bins(len(rows)).tolist()
    assert sorted(binned["id"]) == list(range(len(rows)))
    if tiebreak == "id":
        in_order = binned.sort_values(["x", "id"])
        assert in_order["bin"].is_monotonic_increasing
    shuffled = tw.equal_count_bins(df.repartition(7), "x", tiebreak, sortable=sortable).toPandas()
    assert shuffled.set_index("id")["bin"].sort_index().tolist() == binned.set_index("id")["bin"].sort_index().tolist()


@pytest.mark.parametrize("sortable", [10**6, 60])
def test_identical_rows_are_split_by_number(spark, sortable):
    rows = [(7.0, "p", 1)] * 500 + [(float(i), "q", i) for i in range(20)] + [(7.0, "q", 2)] * 130 + [(30.0, None, None)] * 80
    df = spark.createDataFrame(rows, "x double, g string, v int").repartition(4)
    n = len(rows)
    binned = tw.equal_count_bins(df, "x", sortable=sortable).toPandas()
    assert np.sort(binned["bin"]).tolist() == expected_bins(n).tolist()
    assert sorted(map(str, binned[["x", "g", "v"]].values.tolist())) == sorted(
        map(str, pd.DataFrame(rows, columns=["x", "g", "v"]).values.tolist())
    )
    counts = tw.percentiles(df, "x", "x", "COUNT", sortable=sortable).toPandas()["count"].tolist()
    assert counts == np.bincount(expected_bins(n))[1:].tolist()
    total = tw.percentiles(df, "x", "v", "SUM", "g", sortable=sortable).toPandas()
    assert total["p"].sum() == 500 and total["q"].sum() == sum(range(20)) + 260


def test_copies_with_any_column_names_and_maps(spark):
    df = spark.range(300).selectExpr("double(least(id % 30, 20)) first", "1 n", "map('a', id % 2) batch", "array(1) share")
    binned = tw.equal_count_bins(df, "first", out="part")
    sizes = binned.groupBy("part").count().toPandas().sort_values("part")["count"]
    assert sizes.tolist() == [30] * 10 and binned.columns == ["first", "n", "batch", "share", "part"]


def test_copies_come_back_in_batches(spark, monkeypatch):
    from tallywise.operators import parts

    monkeypatch.setattr(parts, "_COPY_BATCH", 7)
    df = spark.range(1_000).selectExpr("double(least(id, 20)) x")
    counts = tw.equal_count_bins(df, "x").groupBy("bin").count().toPandas().sort_values("bin")["count"]
    assert counts.tolist() == np.bincount(expected_bins(1_000))[1:].tolist()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=60, max_size=200), st.sampled_from([8, 10**6]))
def test_bin_sizes_differ_by_at_most_one(spark, values, sortable):
    values = values + list(range(10))
    df = spark.createDataFrame(list(enumerate(values)), "id long, x long")
    binned = tw.equal_count_bins(df, "x", "id", sortable=sortable).toPandas()
    sizes = binned["bin"].value_counts()
    assert len(sizes) == 10 and sizes.max() - sizes.min() <= 1
    assert binned.sort_values(["x", "id"])["bin"].is_monotonic_increasing


def test_percentile_labels_and_aggregate(spark):
    rng = random.Random(8)
    rows = [(i, rng.random() * 50, rng.randrange(9)) for i in range(500)]
    frame = pd.DataFrame(rows, columns=["id", "x", "v"])
    frame["p"], edges = pd.qcut(frame.x, 10, labels=[f"P{i * 10}" for i in range(10)], retbins=True)
    labels = {f"P{i * 10}": f"P{i * 10} [{edges[i]:.4f}, {edges[i + 1]:.4f})" for i in range(10)}
    want = frame.groupby("p", observed=False).v.mean()
    got = tw.percentiles(spark.createDataFrame(rows, "id long, x double, v long"), "x", "v", "MEAN").toPandas()
    assert got["percentile"].tolist() == list(labels.values())
    assert got["mean"].tolist() == pytest.approx(want.tolist())


def test_outliers_are_left_out(spark):
    rows = [(float(i), i) for i in range(100)] + [(1e6, 1), (-1e6, 2)]
    df = spark.createDataFrame(rows, "x double, v long")
    for analysis in (tw.deciles, tw.percentiles):
        got = analysis(df, "x", "v", "COUNT", ignore_outliers=True).toPandas()
        assert got["count"].tolist() == [10] * 10
        assert analysis(df, "x", "v", "COUNT").toPandas()["count"].sum() == 102
    assert tw.equal_width_bins(df, "x", ignore_outliers=True).count() == 100


def test_sorting_and_limit(spark):
    df = spark.createDataFrame([(float(i), i % 3, "ab"[i % 2]) for i in range(100)], "x double, v long, g string")
    natural = [t.split()[0] for t in tw.deciles(df, "x", "v", "SUM").toPandas()["decile"]]
    assert natural == [f"D{i}" for i in range(1, 11)]
    by_text = tw.deciles(df, "x", "v", "SUM", order_by="decile", limit=3).toPandas()["decile"]
    assert [t.split()[0] for t in by_text] == ["D1", "D10", "D2"]
    ties = tw.percentiles(df, "x", "v", "COUNT", order_by="count", direction="DESC").toPandas()["percentile"]
    assert [t.split()[0] for t in ties] == [f"P{i * 10}" for i in range(10)]
    by_label = tw.deciles(df, "x", "v", "SUM", "g", order_by="b", direction="DESC", limit=2).toPandas()
    assert by_label["b"].tolist() == sorted(tw.deciles(df, "x", "v", "SUM", "g").toPandas()["b"], reverse=True)[:2]


def test_missing_means_sort_last(spark):
    df = spark.createDataFrame([(0.0, 5), (0.1, 7), (10.0, 3), (9.0, None)] + [(float(i), 1) for i in range(2, 9)], "x double, v long")
    means = tw.deciles(df, "x", "v", "MEAN", order_by="mean", direction="DESC").toPandas()["mean"]
    assert means.isna().tolist() == [False] * (10 - means.isna().sum()) + [True] * means.isna().sum()
    assert means.isna().sum() >= 1


def test_binned_column_may_be_the_value_or_have_any_name(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(30)], ["a.b `c`", "flag"])
    assert tw.percentiles(df, "a.b `c`", "a.b `c`", "SUM").toPandas()["sum"].sum() == sum(range(30))
    assert tw.deciles(df, "flag", "flag", "COUNT").toPandas()["count"].tolist() == [15, 15]


def test_an_existing_bin_column_is_replaced(spark):
    df = spark.range(20).selectExpr("id", "id AS bin")
    assert tw.equal_count_bins(df, "id", "id").columns == ["id", "bin"]
    assert tw.equal_width_bins(df, "id", out="d").columns == ["id", "bin", "d"]


@pytest.mark.parametrize(
    "call, error",
    [
        (lambda df: tw.deciles(df, "nope", "v", "SUM"), ValueError),
        (lambda df: tw.deciles(df, "x", "nope", "SUM"), ValueError),
        (lambda df: tw.deciles(df, "x", "v", "SUM", "nope"), ValueError),
        (lambda df: tw.deciles(df, "s", "v", "SUM"), TypeError),
        (lambda df: tw.percentiles(df, "s", "v", "SUM"), TypeError),
        (lambda df: tw.deciles(df, "x", "s", "MEAN"), TypeError),
        (lambda df: tw.deciles(df, "x", "v", "AVG"), ValueError),
        (lambda df: tw.deciles(df, "one", "v", "SUM"), ValueError),
        (lambda df: tw.deciles(df, "none", "v", "SUM"), ValueError),
        (lambda df: tw.deciles(df, "none", "v", "SUM", ignore_outliers=True), ValueError),
        (lambda df: tw.deciles(df, "endless", "v", "SUM"), ValueError),
        (lambda df: tw.percentiles(df, "nine", "v", "SUM"), ValueError),
        (lambda df: tw.percentiles(df, "x", "v", "SUM", tiebreak="nope"), ValueError),
        (lambda df: tw.deciles(df, "x", "v", "SUM", order_by="v"), ValueError),
        (lambda df: tw.deciles(df, "x", "v", "SUM", order_by="percentile"), ValueError),
        (lambda df: tw.deciles(df, "x", "v", "SUM", "s", order_by="sum"), ValueError),
        (lambda df: tw.deciles(df, "x", "v", "SUM", direction="UP"), ValueError),
        (lambda df: tw.deciles(df, "x", "v", "SUM", limit="0"), ValueError),
        (lambda df: tw.deciles(df, "x", "v", "SUM", where=tw.lt("x", -1)), ValueError),
    ],
)
def test_errors(spark, call, error):
    df = spark.range(40).selectExpr(
        "double(id) x",
        "id v",
        "string(id) s",
        "1 one",
        "double(NULL) none",
        "IF(id = 0, double('inf'), id) endless",
        "id % 9 nine",
    )
    with pytest.raises(error):
        call(df)
