"""Queries that go through files: CSV in, file order, JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import limit, order_by
from ..sources.csv import read_csv
from ..sources.json import to_json_records, write_json
from ..sources.position import with_position
from .query import Query, fresh_path, on, read_table


def through_csv(df: DataFrame) -> DataFrame:
    """Write a table as CSV into a new shared folder and read it back with inferred types."""
    path = fresh_path(df.sparkSession, "table.csv")
    df.write.option("header", True).option("escape", '"').csv(path)
    return read_csv(df.sparkSession, path)


def _inference(df: DataFrame) -> DataFrame:
    return through_csv(
        df.select(
            "event_id",
            F.date_format("ts", "yyyy-MM-dd").alias("day"),
            "event_type",
            F.when(F.col("event_id") % 2 == 0, "True").otherwise("FALSE").alias("even"),
            F.concat(F.lit("+"), F.col("user_id")).alias("user_id"),
            F.format_string("%.2fe1", F.col("value")).alias("value"),
            "props",
        )
    )


# Some of the texts that stand for "missing".
_TOKENS = ("NA", "n/a", "null", "NaN", "", "<NA>", "#N/A")


def _missing(df: DataFrame) -> DataFrame:
    token = F.element_at(F.array(*[F.lit(t) for t in _TOKENS]), (F.col("event_id") % len(_TOKENS) + 1).cast("int"))
    gap = F.col("event_id") % 3 == 0
    return through_csv(
        df.select(
            "event_id",
            F.when(gap, token).otherwise(F.col("user_id").cast("string")).alias("user_id"),
            F.when(gap, token).otherwise(F.col("event_type")).alias("event_type"),
            token.alias("nothing"),
        )
    )


def _json_records(df: DataFrame) -> DataFrame:
    shown = df.select("o_orderkey", "o_orderstatus", "o_totalprice")
    record = F.from_json("json", "o_orderkey long, o_orderstatus string, o_totalprice double")
    return to_json_records(shown).select(record.alias("r")).select("r.*")


def _json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "orders.json")
    orders = read_table(spark, sf_dir, "orders")
    write_json(
        orders,
        path,
        ["o_orderkey", "o_totalprice", "o_orderpriority"],
        order_by="o_totalprice",
        direction="DESC",
        limit=100,
        tiebreak=["o_orderkey"],
    )
    return spark.read.schema("o_orderkey long, o_totalprice double, o_orderpriority string").json(path)


def _json_table(df: DataFrame) -> DataFrame:
    path = fresh_path(df.sparkSession, "table.json")
    write_json(df, path)
    return df.sparkSession.read.schema("doc_id long, text string, lang string, source string, n_chars long").json(path)


def _csv_sorted(df: DataFrame) -> DataFrame:
    return order_by(through_csv(df.select("p_partkey", "p_name", "p_retailprice")), "p_retailprice", "DESC")


def _csv_limit_large(df: DataFrame) -> DataFrame:
    ordered = df.select("l_orderkey", "l_linenumber", "l_quantity").orderBy("l_orderkey", "l_linenumber")
    return limit(through_csv(ordered), 20_000)


QUERIES: dict[str, Query] = {
    "csv_limit_large": on(
        "lineitem",
        _csv_limit_large,
        """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem
           ORDER BY l_orderkey, l_linenumber LIMIT 20000""",
    ),
    "csv_roundtrip": on(
        "part",
        through_csv,
        "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    ),
    "csv_sorted": on("part", _csv_sorted, "SELECT p_partkey, p_name, p_retailprice FROM part"),
    "csv_inference": on(
        "events",
        _inference,
        """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_type, event_id % 2 = 0 AS even, user_id,
                  CAST(printf('%.2fe1', value) AS DOUBLE) AS value, props FROM events""",
    ),
    "csv_missing": on(
        "events",
        _missing,
        """SELECT event_id, CAST(CASE WHEN event_id % 3 <> 0 THEN user_id END AS DOUBLE) AS user_id,
                  CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type,
                  CAST(NULL AS DOUBLE) AS nothing FROM events""",
    ),
    "file_position": on(
        "orders",
        lambda df: with_position(df).select("o_orderkey", F.col("file_block").alias("row_index")),
        "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders",
    ),
    "json_records": on("orders", _json_records, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "json_roundtrip": Query(
        _json_roundtrip,
        """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
           ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    ),
    "json_table": on("documents", _json_table, "SELECT doc_id, text, lang, source, n_chars FROM documents"),
}
