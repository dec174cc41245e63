"""Queries that group and cross-tabulate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import AGGREGATES, UNDEFINED_WHEN_EMPTY
from ..functions.predicates import all_of, ge, lt
from ..operators.crosstab import pivot, pivot_labels
from ..operators.grouping import aggregate
from .query import Query, numbered, on, one_column, read_table, rounded, sql_aggregate

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _pivot(agg: str) -> Query:
    return on(
        "lineitem",
        lambda df: rounded(pivot(df, "l_returnflag", "l_quantity", agg), agg),
        f"SELECT l_returnflag, {sql_aggregate(agg, 'l_quantity')} AS l_quantity FROM lineitem GROUP BY l_returnflag",
    )


def _cells(agg: str, value: str, column: str, labels: Sequence, integer: bool = False) -> str:
    def cell(label) -> str:
        literal = f"'{label}'" if isinstance(label, str) else label
        return f'{sql_aggregate(agg, value, f"{column} = {literal}", integer, fill=True)} AS "{label}"'

    return ", ".join(cell(label) for label in labels)


def _crosstab(agg: str) -> Query:
    cells = _cells(agg, "l_quantity", "l_linestatus", ("F", "O"))
    return on(
        "lineitem",
        lambda df: rounded(pivot(df, "l_returnflag", "l_quantity", agg, "l_linestatus"), agg),
        f"SELECT l_returnflag, {cells} FROM lineitem GROUP BY l_returnflag",
    )


def events_with_gaps(df: DataFrame) -> DataFrame:
    """Missing row keys u, missing labels g, and missing values v (all of user 3's)."""
    return df.select(
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END").alias("g"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END").alias("u"),
        F.expr("CASE WHEN event_id % 7 = 0 OR user_id = 3 THEN NULL ELSE value END").alias("v"),
    )


GAPS_SQL = """SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS g,
                     CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS u,
                     CASE WHEN event_id % 7 = 0 OR user_id = 3 THEN NULL ELSE value END AS v
              FROM events"""


def _pivot_nulls(agg: str) -> Query:
    having = "HAVING count(v) > 0" if agg in UNDEFINED_WHEN_EMPTY else ""
    return on(
        "events",
        lambda df: rounded(pivot(events_with_gaps(df), "u", "v", agg), agg),
        f"""SELECT u, {sql_aggregate(agg, 'v')} AS v
            FROM ({GAPS_SQL}) WHERE u IS NOT NULL GROUP BY u {having}""",
    )


def _crosstab_nulls(agg: str) -> Query:
    valued = "AND v IS NOT NULL" if agg in UNDEFINED_WHEN_EMPTY else ""
    cells = ", ".join(
        f'{sql_aggregate(agg, "v", f"g = {t!r}", fill=True)} AS "{t}"' for t in EVENT_TYPES
    )
    return on(
        "events",
        lambda df: rounded(pivot(events_with_gaps(df), "u", "v", agg, "g"), agg),
        f"SELECT u, {cells} FROM ({GAPS_SQL}) WHERE u IS NOT NULL AND g IS NOT NULL {valued} GROUP BY u",
    )


QUERIES: dict[str, Query] = {
    **{f"pivot_{agg.lower()}": _pivot(agg) for agg in AGGREGATES},
    **{f"crosstab_{agg.lower()}": _crosstab(agg) for agg in AGGREGATES},
    **{f"pivot_nulls_{agg.lower()}": _pivot_nulls(agg) for agg in AGGREGATES},
    **{f"crosstab_nulls_{agg.lower()}": _crosstab_nulls(agg) for agg in AGGREGATES},
    "crosstab_numeric_labels": on(
        "lineitem",
        lambda df: pivot(df, "l_returnflag", "l_quantity", "SUM", "l_linenumber"),
        f"""SELECT l_returnflag, {_cells('SUM', 'l_quantity', 'l_linenumber', range(1, 8))}
            FROM lineitem GROUP BY l_returnflag""",
    ),
    "crosstab_text_count": on(
        "orders",
        lambda df: pivot(df, "o_orderpriority", "o_custkey", "COUNT_UNIQUE", "o_orderstatus"),
        f"""SELECT o_orderpriority, {_cells('COUNT_UNIQUE', 'o_custkey', 'o_orderstatus', ('F', 'O', 'P'))}
            FROM orders GROUP BY o_orderpriority""",
    ),
    "pivot_row_is_value": on(
        "lineitem",
        lambda df: pivot(df, "l_linenumber", "l_linenumber", "SUM"),
        """SELECT l_linenumber, CAST(sum(l_linenumber) AS BIGINT) AS "sum" FROM lineitem GROUP BY l_linenumber""",
    ),
    # The route of groups too large for a task, here taken by the larger suppliers.
    "median_of_large_groups": on(
        "lineitem",
        lambda df: rounded(
            aggregate(df.select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", "MEDIAN", "m", group_rows=590)
        ),
        "SELECT l_suppkey, round(median(l_extendedprice), 7) AS m FROM lineitem GROUP BY l_suppkey",
    ),
    "pivot_ordered_limit": on(
        "lineitem",
        lambda df: numbered(
            pivot(df, "l_suppkey", "l_quantity", "SUM", order_by="l_quantity", direction="DESC", limit=10)
        ),
        """SELECT l_suppkey, sum(l_quantity) AS l_quantity,
                  CAST(row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey) AS INTEGER) AS rank
           FROM lineitem GROUP BY l_suppkey ORDER BY l_quantity DESC, l_suppkey LIMIT 10""",
    ),
    "pivot_limit": on(
        "lineitem",
        lambda df: pivot(df, "l_partkey", "l_orderkey", "COUNT", limit=20),
        "SELECT l_partkey, count(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey ORDER BY l_partkey LIMIT 20",
    ),
    "crosstab_ordered_limit": on(
        "lineitem",
        lambda df: numbered(
            pivot(df, "l_suppkey", "l_quantity", "SUM", "l_linestatus", order_by="F", direction="DESC", limit=10)
        ),
        f"""SELECT *, CAST(row_number() OVER (ORDER BY "F" DESC, l_suppkey) AS INTEGER) AS rank
            FROM (SELECT l_suppkey, {_cells('SUM', 'l_quantity', 'l_linestatus', ('F', 'O'))}
                  FROM lineitem GROUP BY l_suppkey)
            ORDER BY "F" DESC, l_suppkey LIMIT 10""",
    ),
    "pivot_large_limit": on(
        "lineitem",
        lambda df: numbered(pivot(df, "l_orderkey", "l_quantity", "SUM", order_by="l_quantity", direction="DESC", limit=12_000)),
        """SELECT l_orderkey, sum(l_quantity) AS l_quantity,
                  CAST(row_number() OVER (ORDER BY sum(l_quantity) DESC, l_orderkey) AS INTEGER) AS rank
           FROM lineitem GROUP BY l_orderkey ORDER BY l_quantity DESC, l_orderkey LIMIT 12000""",
    ),
    "pivot_where": on(
        "lineitem",
        lambda df: rounded(
            pivot(
                df,
                "l_returnflag",
                "l_extendedprice",
                "MEAN",
                where=all_of(ge("l_quantity", 10), lt("l_discount", 0.05)),
            )
        ),
        """SELECT l_returnflag, round(avg(l_extendedprice), 7) AS l_extendedprice FROM lineitem
           WHERE l_quantity >= 10 AND l_discount < 0.05 GROUP BY l_returnflag""",
    ),
    "crosstab_where": on(
        "lineitem",
        lambda df: pivot(df, "l_linenumber", "l_suppkey", "COUNT_UNIQUE", "l_returnflag", where=ge("l_quantity", 40)),
        f"""SELECT l_linenumber, {_cells('COUNT_UNIQUE', 'l_suppkey', 'l_returnflag', ('A', 'N', 'R'))}
            FROM lineitem WHERE l_quantity >= 40 GROUP BY l_linenumber""",
    ),
    "pivot_labels": Query(
        lambda spark, sf_dir: one_column(
            spark, "label", "string", pivot_labels(read_table(spark, sf_dir, "events"), "event_type")
        ),
        "SELECT DISTINCT event_type AS label FROM events",
    ),
    "pivot_labels_numeric": Query(
        lambda spark, sf_dir: one_column(
            spark, "label", "int", pivot_labels(read_table(spark, sf_dir, "lineitem"), "l_linenumber")
        ),
        "SELECT DISTINCT l_linenumber AS label FROM lineitem",
    ),
}
