"""Group-by and cross-tab: aggregate a value per row key, optionally spread over a column's labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import UNDEFINED_WHEN_EMPTY, check_aggregate
from ..functions.checks import data_type, is_numeric, require_columns, require_direction, require_limit
from ..functions.missing import col, is_present, number, present
from ..functions.predicates import Predicate
from .grouping import aggregate
from ..sources.workspace import stored
from . import rows as row_ops
from .rows import sort_key
from .rows import where as keep

ROW, LABEL, VALUE, CELL = "row_key", "label", "value", "cell"


def pivot_labels(df: DataFrame, column: str) -> list:
    """The distinct present values of a column, ascending.

    Labels become columns, so their number is checked against ``spark.sql.pivotMaxValues``.
    """
    require_columns(df, [column])
    return collect_labels(df.filter(is_present(df, column)).select(col(column).alias(LABEL)))


def collect_labels(labelled: DataFrame) -> list:
    """Distinct values of LABEL, at most as many as a pivot may have."""
    most = int(labelled.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r[0] for r in labelled.select(LABEL).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} distinct labels (spark.sql.pivotMaxValues)")
    return sorted(found)


def value_column(df: DataFrame, value: str) -> Column:
    """The value to aggregate; COUNT and COUNT_UNIQUE take any type."""
    return number(df, value) if is_numeric(data_type(df, value)) else present(df, value)


def pivot(
    df: DataFrame,
    row: str,
    value: str,
    agg: str,
    column: str | None = None,
    *,
    where: Predicate | Column | None = None,
    order_by: str | None = None,
    direction: str = "ASC",
    limit: int | str | None = None,
    sort: bool = True,
    approximate: bool = False,
) -> DataFrame:
    """Aggregate ``value`` per ``row``, or per ``row`` and ``column`` as a cross-tab.

    Rows whose key is missing take no part. Without ``column`` the result holds ``row`` and the
    aggregate under the value column's name; a group without values has no mean or median and
    drops out. With ``column`` there is one result column per label, ascending, and 0 where a
    cell has no value; for MEAN and MEDIAN, rows and labels made of such cells only drop out.

    The result is ascending by ``row`` unless ``order_by`` names the value column, or with
    ``column`` a label. ``sort=False`` leaves the rows unordered, which saves a shuffle. A limit
    beyond GATHERED_ROWS stores the grouped result and locates its last row exactly (``top_k``).
    ``approximate=True`` estimates COUNT_UNIQUE from mergeable HLL sketches per cell (opt-in).
    """
    require_columns(df, [row, value] + ([column] if column is not None else []))
    agg = check_aggregate(df, value, agg)
    ascending = require_direction(direction)
    count = None if limit is None else require_limit(limit)
    if column is None and order_by not in (None, value):
        raise ValueError(f"without a pivot column the sort column must be {value!r}")
    if column == row:
        raise ValueError("the row and the pivot column must differ")
    kept = keep(df, where).filter(is_present(df, row))
    if column is not None:
        kept = kept.filter(is_present(df, column))
    rows = kept.select(
        present(df, row).alias(ROW),
        *([present(df, column).alias(LABEL)] if column is not None else []),
        value_column(df, value).alias(VALUE),
    )
    if column is None:
        result = aggregate(rows, [ROW], VALUE, agg, CELL, approximate=approximate)
        names = [agg.lower() if value == row else value]
    else:
        result, names = spread(rows, ROW, agg, approximate=approximate)
        order_by = None if order_by is None else str(order_by)
        if order_by is not None and order_by not in names:
            raise ValueError(f"sort column {order_by!r} is not among the labels {names}")
    names = apart_from(row, names)
    cells = result.columns[1:]
    key = None if order_by is None else CELL if column is None else cells[names.index(order_by)]
    if count is not None and count > row_ops.GATHERED_ROWS:
        # The grouped result is stored once; the count-th row is located in it and the rows before
        # it are a filter, sorted by a distributed sort; no task gathers them.
        grouped = stored(result, "pivot")
        if key is None:
            result = row_ops.top_k(grouped, ROW, "ASC", count)
        else:
            result = row_ops.top_k(grouped, key, direction, count, [ROW])
    elif key is not None:
        result = result.orderBy(sort_key(F.col(key), ascending), F.col(ROW))
    elif sort or count is not None:
        result = result.orderBy(ROW)
    if count is not None and count <= row_ops.GATHERED_ROWS:
        result = result.limit(count)
    return result.select(F.col(ROW).alias(row), *[F.col(c).alias(n) for c, n in zip(cells, names)])


def apart_from(key: str, labels: list[str]) -> list[str]:
    """Column names for labels; one that is the key column's name gets as many ``'`` as it takes."""
    names = list(labels)
    if key in labels:
        name = key
        while name in labels:
            name += "'"
        names[labels.index(key)] = name
    return names


def spread(
    rows: DataFrame, key: str, agg: str, row_count: int | None = None, approximate: bool = False
) -> tuple[DataFrame, list[str]]:
    """Cross-tab of (``key``, LABEL, VALUE) rows without missing keys or labels.

    Returns the wide table, whose label columns are called cell_0, cell_1, ..., and the labels'
    names. Aggregation happens in long form, so the wide step only sees one row per cell.
    """
    if agg in UNDEFINED_WHEN_EMPTY:
        rows = rows.filter(F.col(VALUE).isNotNull())
    labels = collect_labels(rows)
    if not labels:
        return rows.select(key).limit(0), []
    cells = aggregate(rows, [key, LABEL], VALUE, agg, CELL, row_count, approximate=approximate)
    names = [f"cell_{i}" for i in range(len(labels))]
    wide = cells.groupBy(key).pivot(LABEL, labels).agg(F.first(CELL)).toDF(key, *names)
    filled = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]
    return wide.select(key, *filled), [str(label) for label in labels]
