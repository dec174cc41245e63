"""Queries on the distribution of a column: quantiles, outliers, deciles, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import AGGREGATES
from ..functions.missing import drop_missing
from ..functions.predicates import any_of, gt, lt
from ..operators.bins import deciles, equal_count_bins, equal_width_bins, percentiles
from ..operators.statistics import exact_quantiles, iqr_filter, iqr_report, profile, value_counts
from .crosstabs import EVENT_TYPES, GAPS_SQL, events_with_gaps
from .query import Query, numbered, on, read_table, rounded, sql_aggregate

_PROBS = (0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0)


def _quantiles(table: str, column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = exact_quantiles(read_table(spark, sf_dir, table), column, _PROBS)
        return rounded(spark.createDataFrame(list(zip(_PROBS, values)), "prob double, quantile double"))

    each = " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont({column}, {p}), 7) AS quantile FROM {table}"
        for p in _PROBS
    )
    return Query(run, each)


# --- SQL for binned analyses: source rows -> bin per row -> labels -> aggregate per label ---


def _fenced(source: str, column: str) -> str:
    return f"""SELECT s.* FROM ({source}) s,
        (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM ({source}))
        WHERE {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""


def _decile_steps(source: str, column: str) -> str:
    return f"""WITH source AS ({source}),
        span AS (SELECT min({column}) AS lo, max({column}) AS hi, least(10, count(DISTINCT {column})) AS k FROM source),
        binned AS (SELECT source.*, greatest(1, list_sum(list_transform(range(0, k),
                lambda i: CAST({column} > lo + i * ((hi - lo) / k) AS INTEGER)))) AS bin
            FROM source, span WHERE {column} IS NOT NULL),
        bins AS (SELECT i + 1 AS bin, printf('D%d [%.4f, %.4f)', i + 1, lo + i * ((hi - lo) / k),
                CASE WHEN i + 1 = k THEN hi + 1e-10 ELSE lo + (i + 1) * ((hi - lo) / k) END) AS decile
            FROM span, range(0, 10) t(i) WHERE i < k)"""


def _percentile_steps(source: str, column: str, tiebreak: str) -> str:
    probs = ", ".join(str(i / 10) for i in range(11))
    return f"""WITH source AS ({source}),
        placed AS (SELECT *, row_number() OVER (ORDER BY {column}, {tiebreak}) - 1 AS r, count(*) OVER () AS n
            FROM source WHERE {column} IS NOT NULL),
        binned AS (SELECT *, greatest(1, (10 * r + n - 2) // (n - 1)) AS bin FROM placed),
        cuts AS (SELECT quantile_cont({column}, [{probs}]) AS q FROM source),
        bins AS (SELECT i + 1 AS bin, printf('P%d [%.4f, %.4f)', i * 10, q[i + 1], q[i + 2]) AS percentile
            FROM cuts, range(0, 10) t(i))"""


def _by_bin(steps: str, name: str, agg: str, value: str, integer: bool) -> str:
    cell = sql_aggregate(agg, value, integer=integer)
    return f"""{steps} SELECT {name}, {cell} AS {agg.lower()}
        FROM bins LEFT JOIN binned ON binned.bin = bins.bin GROUP BY {name}"""


def _by_bin_and_label(steps: str, name: str, agg: str, value: str, label: str, labels, integer: bool) -> str:
    """Cross-tab by bin: SUM and COUNT list every bin, the others bins that have such a cell."""
    join = "LEFT JOIN" if agg in ("SUM", "COUNT") else "JOIN"
    needed = f"AND {value} IS NOT NULL" if agg in ("MEAN", "MEDIAN") else ""

    def cell(text: str) -> str:
        return sql_aggregate(agg, value, f"{label} = '{text}'", integer, fill=True)

    cells = ", ".join(f'{cell(t)} AS "{t}"' for t in labels)
    return f"""{steps} SELECT {name}, {cells}
        FROM bins {join} (SELECT * FROM binned WHERE {label} IS NOT NULL {needed}) b ON b.bin = bins.bin
        GROUP BY {name}"""


_EVENTS = "SELECT * FROM events"
_DECILES = _decile_steps(_EVENTS, "value")
_PERCENTILES = _percentile_steps(_EVENTS, "value", "event_id")

# Rows at both ends of the value range, without values in the upper bins: some bins stay empty.
_ENDS = any_of(lt("value", 20), gt("value", 250))


def _ends(df: DataFrame) -> DataFrame:
    return df.select(
        "value",
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END").alias("g"),
        F.expr("CASE WHEN value >= 300 OR event_id % 7 = 0 THEN NULL ELSE user_id END").alias("v"),
    )


_ENDS_SQL = """SELECT value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS g,
        CASE WHEN value >= 300 OR event_id % 7 = 0 THEN NULL ELSE user_id END AS v
    FROM events WHERE value < 20 OR value > 250"""


def _deciles(agg: str) -> Query:
    return on(
        "events",
        lambda df: rounded(deciles(df, "value", "user_id", agg)),
        _by_bin(_DECILES, "decile", agg, "user_id", True),
    )


def _deciles_crosstab(agg: str) -> Query:
    return on(
        "events",
        lambda df: rounded(deciles(df, "value", "user_id", agg, "event_type")),
        _by_bin_and_label(_DECILES, "decile", agg, "user_id", "event_type", EVENT_TYPES, True),
    )


def _percentiles(agg: str) -> Query:
    return on(
        "events",
        lambda df: rounded(percentiles(df, "value", "user_id", agg, tiebreak="event_id")),
        _by_bin(_PERCENTILES, "percentile", agg, "user_id", True),
    )


def _percentiles_crosstab(agg: str) -> Query:
    return on(
        "events",
        lambda df: rounded(percentiles(df, "value", "user_id", agg, "event_type", tiebreak="event_id")),
        _by_bin_and_label(_PERCENTILES, "percentile", agg, "user_id", "event_type", EVENT_TYPES, True),
    )


def _deciles_empty(agg: str) -> Query:
    return on(
        "events",
        lambda df: rounded(deciles(_ends(df), "value", "v", agg, where=_ENDS)),
        _by_bin(_decile_steps(_ENDS_SQL, "value"), "decile", agg, "v", True),
    )


def _deciles_empty_crosstab(agg: str) -> Query:
    return on(
        "events",
        lambda df: rounded(deciles(_ends(df), "value", "v", agg, "g", where=_ENDS)),
        _by_bin_and_label(_decile_steps(_ENDS_SQL, "value"), "decile", agg, "v", "g", EVENT_TYPES, True),
    )


_DECILES_SORTED = f"""SELECT *, CAST(row_number() OVER (ORDER BY sum DESC) AS INTEGER) AS rank
    FROM ({_by_bin(_DECILES, 'decile', 'SUM', 'user_id', True)}) ORDER BY sum DESC LIMIT 4"""

QUERIES: dict[str, Query] = {
    "drop_missing": on(
        "events",
        lambda df: drop_missing(events_with_gaps(df), "v"),
        f"SELECT * FROM ({GAPS_SQL}) WHERE v IS NOT NULL",
    ),
    "quantiles": _quantiles("events", "value"),
    "quantiles_few_values": _quantiles("lineitem", "l_discount"),
    "quantiles_balance": _quantiles("customer", "c_acctbal"),
    "iqr_filter": on(
        "events",
        lambda df: iqr_filter(df, "value").select("event_id", "value"),
        f"SELECT event_id, value FROM ({_fenced(_EVENTS, 'value')})",
    ),
    "iqr_report": on(
        "events",
        lambda df: rounded(iqr_report(df, "value")),
        """SELECT round(q1, 7) AS q1, round(q3, 7) AS q3, round(q1 - 1.5 * (q3 - q1), 7) AS lower_bound,
                  round(q3 + 1.5 * (q3 - q1), 7) AS upper_bound,
                  count(*) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS kept,
                  count(*) FILTER (WHERE value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS removed
           FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
           GROUP BY q1, q3""",
    ),
    "profile": on(
        "events",
        lambda df: profile(events_with_gaps(df), "v"),
        f"""SELECT 'double' AS data_type, min(v) AS min_value, max(v) AS max_value,
                   count(DISTINCT v) AS distinct_values, count(*) AS total_rows,
                   count(*) FILTER (WHERE v IS NULL) AS missing_rows FROM ({GAPS_SQL})""",
    ),
    "value_counts": on(
        "events",
        lambda df: value_counts(events_with_gaps(df), "v"),
        f"""SELECT v, count(*) AS "count" FROM ({GAPS_SQL}) WHERE v IS NOT NULL GROUP BY v ORDER BY 2 DESC, v""",
    ),
    "equal_width_bins": on(
        "events",
        lambda df: equal_width_bins(df, "value").select("event_id", "bin"),
        f"{_DECILES} SELECT event_id, CAST(bin AS INTEGER) AS bin FROM binned",
    ),
    "equal_count_bins": on(
        "events",
        lambda df: equal_count_bins(df, "value", "event_id").select("event_id", "bin"),
        f"{_PERCENTILES} SELECT event_id, CAST(bin AS INTEGER) AS bin FROM binned",
    ),
    "bin_labels": on(
        "customer",
        lambda df: deciles(df, "c_acctbal", "c_custkey", "COUNT").select("decile"),
        f"{_decile_steps('SELECT * FROM customer', 'c_acctbal')} SELECT decile FROM bins",
    ),
    **{f"deciles_{agg.lower()}": _deciles(agg) for agg in AGGREGATES},
    **{f"deciles_crosstab_{agg.lower()}": _deciles_crosstab(agg) for agg in AGGREGATES},
    **{f"percentiles_{agg.lower()}": _percentiles(agg) for agg in AGGREGATES},
    **{f"percentiles_crosstab_{agg.lower()}": _percentiles_crosstab(agg) for agg in AGGREGATES},
    **{f"deciles_empty_bins_{agg.lower()}": _deciles_empty(agg) for agg in AGGREGATES},
    **{f"deciles_empty_bins_crosstab_{agg.lower()}": _deciles_empty_crosstab(agg) for agg in AGGREGATES},
    "deciles_no_outliers": on(
        "events",
        lambda df: rounded(deciles(df, "value", "user_id", "MEAN", ignore_outliers=True)),
        _by_bin(_decile_steps(_fenced(_EVENTS, "value"), "value"), "decile", "MEAN", "user_id", True),
    ),
    "percentiles_no_outliers": on(
        "events",
        lambda df: rounded(percentiles(df, "value", "value", "SUM", tiebreak="event_id", ignore_outliers=True), "SUM"),
        _by_bin(
            _percentile_steps(_fenced(_EVENTS, "value"), "value", "event_id"), "percentile", "SUM", "value", False
        ),
    ),
    "percentiles_crosstab_no_outliers": on(
        "events",
        lambda df: percentiles(
            df, "value", "user_id", "COUNT_UNIQUE", "event_type", tiebreak="event_id", ignore_outliers=True
        ),
        _by_bin_and_label(
            _percentile_steps(_fenced(_EVENTS, "value"), "value", "event_id"),
            "percentile",
            "COUNT_UNIQUE",
            "user_id",
            "event_type",
            EVENT_TYPES,
            True,
        ),
    ),
    "deciles_few_values": on(
        "lineitem",
        lambda df: deciles(df, "l_tax", "l_quantity", "SUM"),
        _by_bin(_decile_steps("SELECT * FROM lineitem", "l_tax"), "decile", "SUM", "l_quantity", False),
    ),
    "deciles_edge_values": on(
        "lineitem",
        lambda df: deciles(df, "l_discount", "l_quantity", "COUNT", "l_returnflag"),
        _by_bin_and_label(
            _decile_steps("SELECT * FROM lineitem", "l_discount"),
            "decile",
            "COUNT",
            "l_quantity",
            "l_returnflag",
            ("A", "N", "R"),
            False,
        ),
    ),
    "deciles_ordered_limit": on(
        "events",
        lambda df: numbered(deciles(df, "value", "user_id", "SUM", order_by="sum", direction="DESC", limit=4)),
        _DECILES_SORTED,
    ),
    "deciles_where": on(
        "events",
        lambda df: rounded(deciles(df, "value", "user_id", "MEDIAN", where=lt("value", 100))),
        _by_bin(_decile_steps(f"{_EVENTS} WHERE value < 100", "value"), "decile", "MEDIAN", "user_id", True),
    ),
    "percentiles_where": on(
        "events",
        lambda df: rounded(
            percentiles(df, "value", "user_id", "MEAN", "event_type", tiebreak="event_id", where=gt("value", 30))
        ),
        _by_bin_and_label(
            _percentile_steps(f"{_EVENTS} WHERE value > 30", "value", "event_id"),
            "percentile",
            "MEAN",
            "user_id",
            "event_type",
            EVENT_TYPES,
            True,
        ),
    ),
    "percentiles_by_label_text": on(
        "events",
        lambda df: numbered(
            percentiles(df, "value", "event_id", "COUNT", tiebreak="event_id", order_by="percentile", direction="DESC")
        ),
        f"""SELECT *, CAST(row_number() OVER (ORDER BY percentile DESC) AS INTEGER) AS rank
            FROM ({_by_bin(_PERCENTILES, "percentile", "COUNT", "event_id", True)})""",
    ),
    "percentiles_heavy_ties": on(
        "lineitem",
        lambda df: rounded(percentiles(df, "l_discount", "l_discount", "SUM"), "SUM"),
        _by_bin(
            _percentile_steps("SELECT * FROM lineitem", "l_discount", "l_discount"),
            "percentile",
            "SUM",
            "l_discount",
            False,
        ),
    ),
}
