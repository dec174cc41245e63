"""Top-k by a text column beyond the gathered bound: radix narrowing on the bytes, against sorting."""

import pytest
from pyspark.sql import functions as F

from tallywise.operators import rows, text_order
from tallywise.operators.rows import top_k


@pytest.fixture()
def narrow(monkeypatch):
    """Small bounds, so that a few hundred rows go through every step of the narrowing."""
    monkeypatch.setattr(rows, "GATHERED_ROWS", 10)
    monkeypatch.setattr(text_order, "FEW_ROWS", 7)
    monkeypatch.setattr(text_order, "WINDOW", 40_000)


def sorted_texts(texts, descending):
    present = sorted((t for t in texts if t is not None), key=lambda t: t.encode(), reverse=descending)
    return present + [t for t in texts if t is None]


@pytest.mark.parametrize("direction", ["ASC", "DESC"])
def test_long_texts_with_shared_prefixes(spark, narrow, direction):
    long = "x" * 100_000
    texts = [long + f"{i:03d}" for i in range(40)] + [long] * 5 + [long[:50_000] + "y", "é" * 3, "", None, None]
    texts += [f"w{i % 17}" for i in range(60)] + ["\U0001f600", "z", "Z"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i long")
    want = sorted_texts(texts, direction == "DESC")
    for n in [11, 45, 47, len(texts) - 1, len(texts) + 3]:
        got = [r.t for r in top_k(df, "t", direction, n).collect()]
        assert got == want[:n], n


def test_ties_go_by_the_tiebreaks_then_any_copy(spark, narrow):
    data = [("same", i % 3, i) for i in range(30)] + [("same", None, 99)] * 4 + [("a", 1, 1)] * 3 + [(None, 0, 0)] * 12
    df = spark.createDataFrame(data, "t string, k long, i long")
    want = sorted(data, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0, r[2]))
    for n in [11, 33, 37, 45]:
        got = [tuple(r) for r in top_k(df, "t", "ASC", n, ["k", "i"]).collect()]
        assert got == want[:n], n
    assert top_k(df, "t", "DESC", 25).filter(F.col("t") == "same").count() == 25


def test_one_more_row_is_one_more_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey || '/' || l_linenumber || '/' || l_partkey AS line"
    )
    at = {r.line for r in top_k(docs, "line", "DESC", 10_000).collect()}
    after = [r.line for r in top_k(docs, "line", "DESC", 10_001).collect()]
    assert len(after) == 10_001 and at < set(after)
    assert after == sorted(after, key=lambda t: t.encode(), reverse=True)
