import io
import json
import math

import pandas as pd
import pytest

import tallywise as tw
from tallywise.sources.csv import header_names

TYPES = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "uint64": "decimal(20,0)"}


def read(spark, tmp_path, text, **options):
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8")
    return tw.read_csv(spark, str(path), **options)


@pytest.mark.parametrize(
    "text",
    [
        "a,b,c\n1,2.5,x\n-3,1e5,y\n",
        "a\n 5\n6 \n+7\n",
        "a\n.5\n5.\n-1E+3\n",
        "a\nInfinity\n-inf\n+INF\n",
        "a\ntrue\nFALSE\ntRue\n",
        "a,b\n1,NA\n,2\nn/a,3\n",
        "a,b\n,\n,\n",
        "a\n9223372036854775808\n1\n",
        "a\n99999999999999999999999\n1\n",
        "a\n1.5\n99999999999999999999999\n",
        "a,b\n99999999999999999999999,1\n,1\n",
        "a\n9223372036854775808\n1.5\n",
        "a\n-1\n9223372036854775808\n",
        "a\n1\nTrue\n",
        "a\n1\n2.5\nx\n",
        "a\n5d\n1\n",
        "a\n0x10\n1\n",
        "a\n1_000\n1\n",
        "a\n1e400\n1\n",
        "a\nyes\nno\n",
        "a\n00012\n7\n",
        "day,t\n2024-01-01,10:00\n2024-01-02,11:00\n",
        'a,b\n"x,""y""",1\n" NA",2\n',
        'a\n"NA"\n"1"\n',
        "a,b\n1,2\n   \n\n3,4\n",
        "a,b\n1,2\n3\n",
        "a,a,a.1,,b\n1,2,3,4,5\n",
        ' a ,"b c",x/y,p.q\n1,2,3,4\n',
        "ü,b\nß,é\n",
        "a\n#N/A\nNULL\nNone\n<NA>\nnan\n-1.#IND\nz\n",
    ],
)
def test_types_and_values_like_pandas(spark, tmp_path, text):
    want = pd.read_csv(io.StringIO(text))
    got = read(spark, tmp_path, text)
    assert got.columns == list(want.columns)
    assert [t for _, t in got.dtypes] == [TYPES[str(t)] for t in want.dtypes]
    for a, b in zip([tuple(r) for r in got.collect()], want.itertuples(index=False)):
        want_row = [None if isinstance(x, float) and math.isnan(x) else x for x in b]
        # pandas' own number parser may be off in the last digit.
        assert [pytest.approx(x, rel=1e-14) if isinstance(x, float) else x for x in want_row] == list(a)
    assert got.count() == len(want)


def test_booleans_with_gaps_stay_boolean(spark, tmp_path):
    got = read(spark, tmp_path, "a,b\nTrue,1\nNA,2\n")
    assert got.dtypes[0] == ("a", "boolean")
    assert [r["a"] for r in got.collect()] == [True, None]


def test_rows_longer_than_the_header_are_rejected(spark, tmp_path):
    with pytest.raises(ValueError, match="1 row"):
        read(spark, tmp_path, "a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError):
        read(spark, tmp_path, "")


def test_line_breaks_inside_quotes(spark, tmp_path):
    got = read(spark, tmp_path, 'a,b\n"x\ny",1\nz,2\n', multi_line=True)
    assert [tuple(r) for r in got.collect()] == [("x\ny", 1), ("z", 2)]


def test_header_names():
    assert header_names(["a", None, "a", "a.1", "", "a"]) == ["a", "Unnamed: 1", "a.2", "a.1", "Unnamed: 4", "a.3"]


def test_a_missing_file_is_spark_s_own_error(spark, tmp_path):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        tw.read_csv(spark, str(tmp_path / "none.csv"))


def test_normalise_missing(spark):
    df = spark.createDataFrame([("NA", math.nan, 1), ("x", 2.0, None), ("", None, 3)], "s string, x double, n int")
    assert [tuple(r) for r in tw.normalise_missing(df).collect()] == [(None, None, 1), ("x", 2.0, None), (None, None, 3)]
    assert [tuple(r) for r in tw.drop_missing(df, "x").collect()] == [("x", 2.0, None)]


JSON_ROWS = [(1, "é\"/", 1.23456789012345, True), (2, None, math.nan, None), (3, "x", math.inf, False)]


def test_json_records(spark):
    df = spark.createDataFrame(JSON_ROWS, "id long, s string, x double, b boolean")
    texts = [r["json"] for r in tw.to_json_records(df).collect()]
    assert [json.loads(t) for t in texts] == json.loads(
        pd.DataFrame(JSON_ROWS, columns=["id", "s", "x", "b"]).to_json(orient="records")
    )
    assert all(t.isascii() for t in texts)


def test_write_json(spark, tmp_path):
    df = spark.createDataFrame(JSON_ROWS * 50, "id long, s string, x double, b boolean").repartition(4)
    path = str(tmp_path / "out")
    tw.write_json(df, path, ["s", "id"], where=tw.ne("id", 2), order_by="id", direction="DESC")
    lines = [line for part in sorted((tmp_path / "out").glob("part-*")) for line in part.read_text().splitlines()]
    assert [json.loads(line) for line in lines] == [{"s": "x", "id": 3}] * 50 + [{"s": "é\"/", "id": 1}] * 50
    tw.write_json(df, path, limit=7, mode="overwrite")
    assert spark.read.json(path).count() == 7
    with pytest.raises(ValueError):
        tw.write_json(df, path, ["s"], order_by="id")


@pytest.mark.parametrize("row", ["3,4,NA", "3,4,", "3,4,,x", '3,"4,5",', '"3","4","5"'])
def test_surplus_fields_raise_whatever_they_hold(spark, tmp_path, row):
    path = tmp_path / "t.csv"
    path.write_text(f"a,b\n1,2\n{row}\n")
    with pytest.raises(ValueError, match="more fields"):
        tw.read_csv(spark, str(path))


def test_short_rows_are_padded(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x,y"\n2\n3,z\n')
    assert [tuple(r) for r in tw.read_csv(spark, str(path)).orderBy("a").collect()] == [(1, "x,y"), (2, None), (3, "z")]


@pytest.mark.parametrize("headers", [("a,b", "b,a"), ("a,a", "a,b")])
def test_files_with_different_headers_raise(spark, tmp_path, headers):
    for i, header in enumerate(headers):
        (tmp_path / f"{i}.csv").write_text(f"{header}\n1,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        tw.read_csv(spark, str(tmp_path)).collect()


def test_work_folder_must_be_shared(spark):
    from types import SimpleNamespace

    from tallywise.sources.workspace import fresh_path

    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert fresh_path(session("spark://host:7077", "hdfs://x/work/"), "t").startswith("hdfs://x/work/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        fresh_path(session("spark://host:7077", None), "t")


def test_large_limit_on_csv_is_a_filter_in_file_order(spark, tmp_path):
    """Beyond the gathered bound a limit on CSV counts rows per block and numbers one block only."""
    import os

    from tallywise.operators import rows as row_ops

    path = str(tmp_path / "t")
    spark.range(0, 30_000).selectExpr("id", "id % 7 AS k").coalesce(3).write.option("header", True).csv(path)
    lines = []
    for name in sorted(f for f in os.listdir(path) if f.endswith(".csv")):
        with open(os.path.join(path, name)) as handle:
            lines += [tuple(int(x) for x in line.strip().split(",")) for line in handle.readlines()[1:]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = tw.read_csv(spark, path)
        for n in [row_ops.GATHERED_ROWS + 1, 20_000, 29_999, 40_000]:
            result = tw.limit(df, n)
            plan = result._jdf.queryExecution().executedPlan().toString()
            assert "SinglePartition" not in plan and "CollectLimit" not in plan and "TakeOrdered" not in plan
            assert [tuple(r) for r in result.collect()] == lines[:n]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
