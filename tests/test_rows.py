import math

import pytest
from pyspark.sql import functions as F

import tallywise as tw


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, 3.0, "c"), (2, math.nan, "a"), (3, 1.0, None), (4, None, "b"), (5, 2.0, "a")]
    return spark.createDataFrame(rows, "id long, x double, s string").cache()


def ids(result):
    return [r["id"] for r in result.collect()]


def test_view_and_project(df):
    assert tw.view(df).columns == ["id", "x", "s"]
    assert tw.show(df, ["s", "id"]).columns == ["s", "id"]


def test_missing_values_sort_last_in_both_directions(df):
    assert ids(tw.order_by(df, "x"))[:3] == [3, 5, 1]
    assert ids(tw.order_by(df, "x", "DESC"))[:3] == [1, 5, 3]
    assert ids(tw.order_by(df, "s", "desc", ["id"])) == [1, 4, 2, 5, 3]


def test_top_k_ties_follow_the_tiebreak(df):
    assert ids(tw.top_k(df, "s", "ASC", 2, ["id"])) == [2, 5]
    assert ids(tw.top_k(df, "x", "DESC", "4", ["id"])) == [1, 5, 3, 2]


def test_clause_order(df):
    shown = tw.show(df, ["s", "x"], where=tw.gt("id", 1), order_by="x", direction="DESC", limit=1)
    assert shown.collect() == [("a", 2.0)]
    assert ids(tw.show(df, where=tw.ne("s", "a"), order_by="id", direction="DESC")) == [4, 3, 1]


def test_limit_keeps_file_order(spark, tmp_path):
    path = str(tmp_path / "many files")
    spark.range(0, 5_000, 1, 16).withColumn("odd", F.col("id") % 2).write.parquet(path)
    table = spark.read.parquet(path)
    assert ids(tw.limit(table, 700)) == list(range(700))
    assert ids(tw.limit(table.filter("odd = 1"), 3)) == [1, 3, 5]
    assert ids(tw.limit(table.filter("id >= 4000"), 2)) == [4000, 4001]
    assert ids(tw.limit(table, 10_000)) == list(range(5_000))
    assert tw.limit(table, 3).columns == ["id", "odd"]
    assert ids(tw.show(table, ["id"], where=tw.eq("odd", 1), limit=2)) == [1, 3]


@pytest.mark.parametrize("n", [60, 500, 999, 1_000, 1_800])
def test_large_limits_are_filters(spark, tmp_path, monkeypatch, n):
    from tallywise.operators import rows

    monkeypatch.setattr(rows, "GATHERED_ROWS", 50)
    path = str(tmp_path / "t")
    spark.range(0, 2_000, 1, 7).write.parquet(path)
    even = spark.read.parquet(path).filter("id % 2 = 0")
    first = tw.limit(even, n)
    assert ids(first) == list(range(0, 2_000, 2))[:n]
    assert "Limit" not in first._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("direction", ["ASC", "DESC"])
@pytest.mark.parametrize("column", ["x", "n", "day", "b", "at"])
@pytest.mark.parametrize("n", [60, 700, 1_100, 5_000])
def test_large_top_k_equals_the_sorted_head(spark, monkeypatch, direction, column, n):
    from tallywise.operators import rows

    df = spark.range(1_200).selectExpr(
        "id",
        "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 11 = 0 THEN double('nan') WHEN id % 3 = 0 THEN 2.5D ELSE id % 89 - 40D END x",
        "IF(id % 5 = 0, NULL, id * 7919 % 101 - 50) n",
        "date_add(date '1970-01-01', int(id % 40) - 20) day",
        "id % 2 = 0 b",
        "timestamp_ntz '1969-12-31 23:59:59.5' + make_dt_interval(0, 0, 0, id * 97 % 500 * 0.25) at",
    )
    want = ids(tw.top_k(df, column, direction, n, ["id"]))
    monkeypatch.setattr(rows, "GATHERED_ROWS", 50)
    assert ids(tw.top_k(df, column, direction, n, ["id"])) == want
    assert len(ids(tw.top_k(df, column, direction, n))) == min(n, 1_200)


def test_small_limit_reads_few_files(spark, tmp_path):
    from tallywise.sources.position import leading_files

    path = str(tmp_path / "files")
    spark.range(0, 5_000, 1, 32).write.parquet(path)
    table = spark.read.parquet(path)
    assert leading_files(table, 10).select("_metadata.file_path").distinct().count() == 1
    assert leading_files(table, 1_000).select("_metadata.file_path").distinct().count() == 8


def test_limit_of_a_table_with_a_path_column(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 3).selectExpr("id", "'x' file_path", "-id file_block").write.parquet(path)
    first = tw.limit(spark.read.parquet(path), 40)
    assert first.columns == ["id", "file_path", "file_block"] and ids(first) == list(range(40))


def test_limit_of_a_table_without_files(spark):
    assert ids(tw.limit(spark.range(10), 3)) == [0, 1, 2]


def test_position_of_csv_rows(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    spark.range(0, 3_000, 1, 4).write.option("header", True).csv(path)
    table = tw.read_csv(spark, path)
    assert ids(tw.limit(table, 900)) == list(range(900))
    placed = tw.with_position(table).orderBy("file_path", "file_block", "row_in_block")
    assert ids(placed) == list(range(3_000))


def test_position_needs_files(spark):
    with pytest.raises(ValueError):
        tw.with_position(spark.range(3))


@pytest.mark.parametrize(
    "call",
    [
        lambda df: tw.show(df, ["id", "nope"]),
        lambda df: tw.show(df, []),
        lambda df: tw.show(df, "id"),
        lambda df: tw.show(df, ["id"], order_by="x"),
        lambda df: tw.show(df, order_by="x", direction="UP"),
        lambda df: tw.order_by(df, "nope"),
        lambda df: tw.order_by(df, "x", tiebreak=["nope"]),
        lambda df: tw.limit(df, 0),
        lambda df: tw.limit(df, -1),
        lambda df: tw.limit(df, "ten"),
        lambda df: tw.limit(df, 1.5),
        lambda df: tw.limit(df, True),
        lambda df: tw.top_k(df, "x", "ASC", None),
    ],
)
def test_argument_errors(df, call):
    with pytest.raises(ValueError):
        call(df)


def test_limit_respects_a_sort_before_it(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1_000, 1, 5).selectExpr("id", "id * 7919 % 1009 AS x").write.parquet(path)
    table = spark.read.parquet(path)
    want = [r.id for r in sorted(table.collect(), key=lambda r: -r.x)[:5]]
    assert ids(tw.limit(tw.order_by(table, "x", "DESC"), 5)) == want
    assert ids(tw.show(tw.order_by(table, "x", "DESC"), limit=5)) == want
    assert ids(tw.limit(tw.order_by(table, "x", "DESC").filter("id >= 0").select("id"), 5)) == want


@pytest.mark.parametrize("direction", ["ASC", "DESC"])
@pytest.mark.parametrize("column, tiebreak", [("tie", ["gap", "id"]), ("d", ["id"]), ("s", ["id"]), ("wide", ["s", "id"])])
def test_rows_do_not_depend_on_the_route(spark, monkeypatch, direction, column, tiebreak):
    from tallywise.operators import rows

    df = spark.range(1_500).selectExpr(
        "id",
        "1 AS tie",
        "IF(id % 2 = 0, NULL, id % 7 - 3.5D) AS gap",
        "CAST(id * 7919 % 1009 - 500 AS DECIMAL(38, 10)) / 3 AS d",
        "IF(id % 50 = 0, NULL, CAST(id * 7919 % 1009 - 500 AS DECIMAL(12, 2))) AS wide",
        "IF(id % 9 = 0, NULL, repeat(chr(97 + int(id % 5)), int(id % 17))) AS s",
    )
    want = ids(tw.top_k(df, column, direction, 800, tiebreak))
    monkeypatch.setattr(rows, "GATHERED_ROWS", 50)
    located = tw.top_k(df, column, direction, 800, tiebreak)
    assert ids(located) == want
    assert "TakeOrdered" not in located._jdf.queryExecution().executedPlan().toString()


def test_sorted_rows_come_in_order(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = [r.o_totalprice for r in tw.order_by(orders, "o_totalprice", "DESC").collect()]
    assert got == sorted(got, reverse=True)
    shown = tw.show(orders, ["o_orderkey", "o_totalprice"], where=tw.lt("o_totalprice", 50000.5), order_by="o_totalprice")
    got = [r.o_totalprice for r in shown.collect()]
    assert got == sorted(got)


def test_large_top_k_keys_only_the_rows_up_to_its_rank(spark, monkeypatch):
    from tallywise.operators import rows

    keyed, chain = [], rows.order_chain
    monkeypatch.setattr(rows, "order_chain", lambda df, *a: keyed.append(df.count()) or chain(df, *a))
    df = spark.range(60_000).selectExpr(
        "CAST(CASE WHEN id % 100 <> 0 THEN pmod(id * 7919, 20011) - 500 + 0.0000000001 * (id % 3) END AS DECIMAL(38, 10)) AS price",
        "id || '/' AS line",
    )
    for direction in ("ASC", "DESC"):
        got = {r.line for r in rows.top_k(df, "price", direction, 11_000, ["line"]).collect()}
        sign = 1 if direction == "ASC" else -1
        every = [(sign * r.price, r.line) for r in df.filter("price IS NOT NULL").collect()]
        assert got == {line for _, line in sorted(every)[:11_000]}
    assert max(keyed) < 11_010
    assert rows.top_k(df, "price", "ASC", 59_500, ["line"]).count() == 59_500
