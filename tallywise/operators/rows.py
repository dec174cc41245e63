"""Row operators: view, project, filter, sort, limit, top-k, and their combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import data_type, require_columns, require_direction, require_limit
from ..functions.missing import col, present
from ..functions.predicates import Predicate
from ..sources.position import has_row_index, leading_files, position_of
from .parts import first_part, has_order_chain, hashable, number_key, order_chain, tie_keys
from .selection import positions, sql_number
from .text_order import by_hash, text_top

# Largest limit for which every task may hand that many rows to a single one.
GATHERED_ROWS = 10_000
_KEY = "__sort_key"


def view(df: DataFrame) -> DataFrame:
    """The whole table, unchanged; ``df.columns`` lists its columns."""
    return df


def condition(df: DataFrame, predicate: Predicate | Column) -> Column:
    return predicate.to_column(df) if isinstance(predicate, Predicate) else predicate


def where(df: DataFrame, predicate: Predicate | Column | None) -> DataFrame:
    """Keep the matching rows."""
    return df if predicate is None else df.filter(condition(df, predicate))


def match_count(df: DataFrame, predicate: Predicate | Column) -> DataFrame:
    """One row with the number of matching rows."""
    return where(df, predicate).agg(F.count(F.lit(1)).alias("matches"))


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The named columns in the given order; all columns for None."""
    if columns is None:
        return df
    if isinstance(columns, str) or not columns:
        raise ValueError("columns must be a non-empty list of names")
    require_columns(df, columns)
    return df.select(*[col(c) for c in columns])


def sort_key(c: Column, ascending: bool) -> Column:
    """Missing values come last in both directions."""
    return c.asc_nulls_last() if ascending else c.desc_nulls_last()


def order_by(df: DataFrame, column: str, direction: str = "ASC", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Sort by one column; ``tiebreak`` columns (ascending) settle equal values.

    The last key is the task that read the row. It leaves equal rows apart in the range
    partitioning, so a value that fills a third of the table is sorted by many tasks.
    """
    return df.orderBy(*_sort_keys(df, column, direction, tiebreak), F.spark_partition_id())


def _sort_keys(df: DataFrame, column: str, direction: str, tiebreak: Sequence[str]) -> list[Column]:
    require_columns(df, [column, *tiebreak])
    ascending = require_direction(direction)
    return [sort_key(present(df, column), ascending), *[sort_key(present(df, t), True) for t in tiebreak]]


def limit(df: DataFrame, n: int | str) -> DataFrame:
    """The first n rows in file order, or in the order of a sort that ``df`` ends with.

    For a table read from files this looks at the leading files only, as many as it takes to
    hold n matching rows. Any other table (sorted, joined, made in memory) keeps the order it has.
    """
    n = require_limit(n)
    position = position_of(df)
    if position is None:
        return df.limit(n)
    head = leading_files(df, n)
    if n > GATHERED_ROWS and has_row_index(df):
        return _before_cut(head, n).orderBy(*position)
    if n > GATHERED_ROWS:
        return _before_block_cut(head, n)
    return head.orderBy(*position).limit(n)


def _before_block_cut(head: DataFrame, n: int) -> DataFrame:
    """The first n rows of text files (no row index) as a filter, in two passes, in file order.

    Pass one counts rows per (file, block start) of the leading files; running sums over these
    counts (one per block of the leading files, never per row) find the block that holds row n.
    The blocks before it are kept by a filter on file and block; only the rows of that one block
    are numbered, by a window partitioned by the block (one task reads a block, in file order).
    The result is sorted by file, block and place in the block, a distributed sort.
    """
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    names = [col(c) for c in head.columns]
    counts = sorted(tuple(r) for r in head.groupBy(path.alias("p"), block.alias("b")).count().collect())
    before = 0
    for file, start, rows in counts:
        if before + rows >= n:
            break
        before += rows
    else:
        file, start = None, None

    def placed(rows: DataFrame) -> DataFrame:
        at = rows.select(*names, path.alias("__path"), block.alias("__block"))
        return at.withColumn("__order", F.monotonically_increasing_id())

    if file is None:
        kept = placed(head)
    else:
        earlier = (path < F.lit(file)) | ((path == F.lit(file)) & (block < F.lit(start)))
        at = placed(head.filter((path == F.lit(file)) & (block == F.lit(start))))
        numbered = at.withColumn("__row", F.row_number().over(Window.partitionBy("__block").orderBy("__order")))
        kept = placed(head.filter(earlier)).unionByName(numbered.filter(F.col("__row") <= n - before).drop("__row"))
    return kept.orderBy("__path", "__block", "__order").drop("__path", "__block", "__order")


def _before_cut(head: DataFrame, n: int) -> DataFrame:
    """The first n rows as a filter: whole files, and one file up to a row index."""
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    before = 0
    for file, rows in sorted(tuple(r) for r in head.groupBy(path).agg(F.count(F.lit(1))).collect()):
        if before + rows >= n:
            rank = n - before - 1
            in_file = head.filter(path == F.lit(file)).select(index.alias("index"))
            cut = positions(in_file, ["index"], rows, [rank])[rank].keys[0]
            return head.filter((path < F.lit(file)) | ((path == F.lit(file)) & (index <= F.lit(cut))))
        before += rows
    return head


def top_k(df: DataFrame, column: str, direction: str, n: int | str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The first n rows after sorting; pass a unique ``tiebreak`` for a repeatable result.

    Missing values come last, in the column and in the tie-breaks, whatever n is. Beyond
    GATHERED_ROWS the n-th row is located exactly and the result is a filter: a text column by
    radix narrowing on its bytes (``text_order``), whatever its length, with ties settled by the
    tie-breaks in turn and then by a hash of the row; numbers, decimals, dates, times and
    booleans by numeric keys. Other types are gathered.
    """
    n = require_limit(n)
    if n > GATHERED_ROWS:
        located = _located(df, column, direction, n, tiebreak)
        if located is not None:
            return located
    return df.orderBy(*_sort_keys(df, column, direction, tiebreak)).limit(n)


def _located(df: DataFrame, column: str, direction: str, n: int, tiebreak: Sequence[str]) -> DataFrame | None:
    """The first n rows as a filter on the table, sorted; None for types without an exact route."""
    keys = _sort_keys(df, column, direction, tiebreak)
    if isinstance(data_type(df, column), T.StringType):
        first = text_top(
            df,
            column,
            require_direction(direction),
            n,
            lambda rows, m: _first_tied(rows, m, tiebreak),
            lambda rows, m: rows.orderBy(*keys).limit(m),
        )
        return order_by(first, column, direction, tiebreak)
    if all(has_order_chain(data_type(df, c)) for c in [column, *tiebreak]):
        df = _up_to_rank(df, column, require_direction(direction), n)
        chain = order_chain(df, column, require_direction(direction))
        chain += [key for t in tiebreak for key in order_chain(df, t, True)]
        keyed = df.select("*", *[key.alias(f"{_KEY}_{i}") for i, key in enumerate(chain)], *tie_keys(df, None, hashable(df)))
        first = first_part(keyed, keyed.columns[len(df.columns) :], n).select(*[col(c) for c in df.columns])
        return order_by(first, column, direction, tiebreak)
    return None


def _up_to_rank(df: DataFrame, column: str, ascending: bool, n: int) -> DataFrame:
    """The rows up to the n-th by the column as one number, with all that tie there; all rows if these are too few.

    A double orders long decimals up to ties, so the first n rows are among these, and only
    they need the keys of the whole order.
    """
    key = F.when(present(df, column).isNotNull(), number_key(df, column))
    if not ascending:
        whole = isinstance(df.select(key).schema.fields[0].dataType, T.LongType)
        key = F.bitwise_not(key) if whole else -key
    keyed = df.select(key.alias(_KEY)).filter(F.col(_KEY).isNotNull())
    rows = keyed.count()
    if rows <= n:
        return df
    cut = positions(keyed, [_KEY], rows, [], [n - 1])[n - 1]
    return df.filter(key <= F.expr(sql_number(cut.keys[0])))


def _first_tied(rows: DataFrame, m: int, tiebreak: Sequence[str]) -> DataFrame:
    """The first m of rows that are equal in the sort column: by the tie-breaks, then any copies."""
    if m <= 0:
        return rows.limit(0)
    if not tiebreak:
        return by_hash(rows, m)
    located = _located(rows, tiebreak[0], "ASC", m, tiebreak[1:])
    return rows.orderBy(*_sort_keys(rows, tiebreak[0], "ASC", tiebreak[1:])).limit(m) if located is None else located


def show(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    where: Predicate | Column | None = None,
    order_by: str | None = None,
    direction: str = "ASC",
    limit: int | str | None = None,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Filter, project, sort and limit, in this order whatever the order of the arguments.

    The sort column must be among the projected columns; ``tiebreak`` columns need not be.
    """
    rows = df if where is None else df.filter(condition(df, where))
    shown = project(rows, columns)
    count = None if limit is None else require_limit(limit)
    require_direction(direction)
    if order_by is None:
        return shown if count is None else project(_limit(rows, count), columns)
    if order_by not in shown.columns:
        raise ValueError(f"sort column {order_by!r} is not among the selected columns")
    if count is None:
        return project(_order_by(rows, order_by, direction, tiebreak), columns)
    return project(top_k(rows, order_by, direction, count, tiebreak), columns)


# The names that arguments of ``show`` hide.
_order_by, _limit = order_by, limit
