"""The physical plans that the operators are written for."""

import pytest

import tallywise as tw


@pytest.fixture(scope="module")
def lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 1_000)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(lineitem):
    text = plan(
        tw.show(
            lineitem,
            ["l_orderkey"],
            where=tw.all_of(tw.gt("l_linenumber", 2.5), tw.ge("l_quantity", 10), tw.eq("l_returnflag", "A")),
        )
    )
    for pushed in ("GreaterThan(l_linenumber,2)", "GreaterThanOrEqual(l_quantity,10.0)", "EqualTo(l_returnflag,A)"):
        assert pushed in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text
    assert "Exchange" not in text


def test_or_is_pushed_as_a_whole(lineitem):
    text = plan(tw.where(lineitem, tw.any_of(tw.eq("l_linenumber", 1), tw.lt("l_suppkey", 10))))
    assert "Or(EqualTo(l_linenumber,1),LessThan(l_suppkey,10))" in text


def test_top_k_never_sorts_the_table(lineitem):
    text = plan(tw.top_k(lineitem, "l_extendedprice", "DESC", 10))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_file_order_limit_never_sorts_the_table(lineitem):
    text = plan(tw.limit(lineitem, 10))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_full_sort_tells_equal_values_apart(lineitem):
    text = plan(tw.order_by(lineitem, "l_returnflag"))
    assert text.count("Exchange rangepartitioning(l_returnflag") == 1
    assert "SPARK_PARTITION_ID" in text


@pytest.mark.parametrize("agg", ["SUM", "COUNT", "MEAN"])
def test_pivot_combines_before_its_only_hash_shuffle(lineitem, agg):
    text = plan(tw.pivot(lineitem, "l_suppkey", "l_quantity", agg, sort=False))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_" in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text


def test_count_unique_shuffles_by_key_and_value(lineitem):
    text = plan(tw.pivot(lineitem, "l_returnflag", "l_partkey", "COUNT_UNIQUE", sort=False))
    assert "partial_count(distinct" in text
    assert text.count("Exchange hashpartitioning(row_key") == 2


@pytest.mark.parametrize("analysis", [tw.deciles, tw.percentiles])
def test_binning_happens_in_the_scan_stage(events, analysis):
    text = plan(analysis(events, "value", "user_id", "SUM"))
    # One shuffle of partial sums, at most ten per task; nothing is ranked, sorted or joined by rows.
    assert text.count("Exchange hashpartitioning") == 1
    assert "Exchange rangepartitioning" not in text and "SinglePartition" not in text and "Window" not in text
    assert "BroadcastHashJoin" in text and "Range (1, 11" in text
    assert "partial_sum" in text


def test_row_level_bins_need_no_shuffle(events):
    for binned in (tw.equal_width_bins(events, "value"), tw.equal_count_bins(events, "value", "event_id")):
        assert "Exchange" not in plan(binned)


def test_outlier_filter_is_pushed(events):
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value" in plan(tw.iqr_filter(events, "value"))


def test_json_records_stay_in_the_scan_stage(events):
    text = plan(tw.to_json_records(events))
    assert "Exchange" not in text and "Python" not in text


def test_decimal_comparisons_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("CAST(id AS DECIMAL(20, 2)) AS d").write.parquet(path)
    found = tw.where(spark.read.parquet(path), tw.gt("d", 3.001))
    assert "GreaterThan(d,3.00)" in found._jdf.queryExecution().executedPlan().toString()
