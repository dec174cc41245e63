"""Distribution analysis: equal-width deciles and equal-count percentiles of a numeric column.

Bin boundaries are found first and enter the plan as at most eleven literals. Assigning a row
to its bin is then a comparison inside the scan stage; the table itself is never shuffled,
sorted or ranked for binning. Keys are never null there; the bin expressions say so with a
coalesce, which spares Spark a second evaluation as a null check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import UNDEFINED_WHEN_EMPTY, check_aggregate
from ..functions.checks import data_type, require_columns, require_direction, require_limit, require_rankable
from ..functions.missing import col, is_present, present
from ..functions.predicates import Predicate
from .crosstab import CELL, LABEL, VALUE, apart_from, spread, value_column
from .grouping import aggregate
from .parts import REST, TIE, Parts, divide, hashable, tie_keys
from .rows import sort_key
from .rows import where as keep
from .selection import SORTABLE_ROWS, sql_number
from .statistics import Fence, interpolate, quantile_ranks, quantiles_of, summarise

BINS = 10
# The last equal-width edge lies this much above the largest value.
EDGE_MARGIN = 1e-10

KEY, BIN = "__key", "__bin"
# Distinct values and rows per value for which values are counted before rows are sorted.
_FEW_VALUES, _MANY_PER_VALUE = 10_000, 20


@dataclass(frozen=True)
class EqualWidth:
    """Right-closed ranges of equal width; the first one includes its lower edge."""

    edges: tuple[float, ...]

    @property
    def count(self) -> int:
        return len(self.edges) - 1

    def assign(self, df: DataFrame) -> DataFrame:
        passed = " + ".join(f"int({KEY} > {sql_number(edge)})" for edge in self.edges[:-1])
        return df.withColumn(BIN, F.expr(f"coalesce(greatest(1, {passed}), {self.count})"))

    def labels(self) -> list[str]:
        return bin_labels(self.edges, [f"D{i + 1}" for i in range(self.count)])


@dataclass(frozen=True)
class EqualCount:
    """Ten bins of equal size, cut at the row positions of the 10%, 20%, ... quantiles."""

    edges: tuple[float, ...]
    parts: Parts

    count = BINS

    def assign(self, df: DataFrame) -> DataFrame:
        return self.parts.assign(df, BIN)

    def labels(self) -> list[str]:
        return bin_labels(self.edges, [f"P{i * 10}" for i in range(self.count)])


def bin_labels(edges: Sequence[float], names: Sequence[str]) -> list[str]:
    """Texts such as "D1 [0.0000, 9.5000)", one per bin."""
    return [f"{name} [{lo:.4f}, {hi:.4f})" for name, lo, hi in zip(names, edges, edges[1:])]


def equal_width_edges(low: float, high: float, distinct: int) -> tuple[float, ...]:
    """Edges of at most ten ranges of equal width, fewer if there are fewer distinct values."""
    if distinct < 2:
        raise ValueError(f"too few distinct values ({distinct}) for deciles")
    if not np.isfinite([low, high]).all():
        raise ValueError("deciles need a finite value range")
    edges = np.linspace(low, high, min(BINS, distinct) + 1)
    edges[-1] = high + EDGE_MARGIN
    if not np.all(np.diff(edges) > 0):
        raise ValueError("deciles need a value range that can be divided")
    return tuple(float(e) for e in edges)


def _survivors(df: DataFrame, ignore_outliers: bool, sortable: int) -> DataFrame:
    """The rows to bin: all of them, or those inside the outlier fence of KEY."""
    if not ignore_outliers:
        return df
    keys = df.select(KEY)
    count = keys.count()
    if count == 0:
        return df
    fence = Fence(*quantiles_of(keys, KEY, count, [0.25, 0.75], sortable))
    return df.filter(fence.inside(KEY))


def _equal_width(df: DataFrame) -> tuple[EqualWidth, int]:
    s = summarise(df, KEY)
    if s.rows == 0:
        raise ValueError("no values to bin")
    return EqualWidth(equal_width_edges(s.low, s.high, s.distinct)), s.rows


def _equal_count(df: DataFrame, sortable: int) -> tuple[EqualCount, int]:
    s = summarise(df.select(KEY), KEY)
    if s.rows == 0:
        raise ValueError("no values to bin")
    if s.distinct < BINS:
        raise ValueError(f"too few distinct values ({s.distinct}) for 10 percentiles")
    probs = [i / BINS for i in range(BINS + 1)]
    last_ranks = [i * (s.rows - 1) // BINS for i in range(1, BINS)]
    by_value = {rank for p in probs for rank in quantile_ranks(p, s.rows)[:2]}
    few_values = s.distinct <= _FEW_VALUES and s.distinct * _MANY_PER_VALUE <= s.rows
    keys = [k for k in (KEY, TIE, REST) if k in df.columns]
    parts, found = divide(df, keys, last_ranks, s.rows, by_value, sortable, few_values)
    edges = tuple(interpolate(p, s.rows, found) for p in probs)
    return EqualCount(edges, parts), s.rows


def _bin_key(df: DataFrame, column: str) -> Column:
    """The selection key of rows already known to have a value (a bare cast, hence never null)."""
    whole = isinstance(data_type(df, column), (T.IntegralType, T.BooleanType))
    return col(column).cast("long" if whole else "double").alias(KEY)


def _check_bin_column(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    require_rankable(df, column, "binning")


def equal_width_bins(
    df: DataFrame, column: str, ignore_outliers: bool = False, out: str = "bin", sortable: int = SORTABLE_ROWS
) -> DataFrame:
    """Add the number (1 to 10) of each row's equal-width bin; rows without a value are dropped."""
    _check_bin_column(df, column)
    keyed = df.filter(is_present(df, column)).select("*", _bin_key(df, column))
    rows = _survivors(keyed, ignore_outliers, sortable)
    bins, _ = _equal_width(rows.select(KEY))
    return _named(bins.assign(rows), df, out)


def equal_count_bins(
    df: DataFrame,
    column: str,
    tiebreak: str | Sequence[str] | None = None,
    ignore_outliers: bool = False,
    out: str = "bin",
    sortable: int = SORTABLE_ROWS,
) -> DataFrame:
    """Add the number (1 to 10) of each row's equal-count bin; rows without a value are dropped.

    Rows of equal value are ordered by ``tiebreak`` and then by a hash of the whole row, so
    bins come out the same however the table is partitioned. Identical rows are told apart by
    number only.
    """
    _check_bin_column(df, column)
    ties = tie_keys(df, tiebreak, hashable(df))
    keyed = df.filter(is_present(df, column)).select("*", _bin_key(df, column), *ties)
    rows = _survivors(keyed, ignore_outliers, sortable)
    bins, _ = _equal_count(rows, sortable)
    return _named(bins.assign(rows), df, out)


def _named(binned: DataFrame, df: DataFrame, out: str) -> DataFrame:
    return binned.select(*[col(c) for c in df.columns if c != out], F.col(BIN).alias(out))


def deciles(
    df: DataFrame,
    column: str,
    value: str,
    agg: str,
    pivot_column: str | None = None,
    *,
    ignore_outliers: bool = False,
    where: Predicate | Column | None = None,
    order_by: str | None = None,
    direction: str = "ASC",
    limit: int | str | None = None,
    sortable: int = SORTABLE_ROWS,
) -> DataFrame:
    """Aggregate ``value`` over ten equal-width bins of ``column``.

    The result holds ``decile`` (a label such as "D1 [0.0000, 49.0000)") and the aggregate under
    its lower-case name, or one column per label of ``pivot_column``. Bins are computed on the
    filtered rows, and on those left after outlier removal. Every bin is listed, except in a
    cross-tab of COUNT_UNIQUE, MEAN or MEDIAN, which lists bins with such a result.
    """
    request = _Request("decile", column, value, str(agg).upper(), pivot_column, order_by, direction, limit)
    request.check(df)
    rows = _survivors(request.slim(keep(df, where), []), ignore_outliers, sortable)
    bins, count = _equal_width(rows.select(KEY))
    return request.result(bins, rows, count)


def percentiles(
    df: DataFrame,
    column: str,
    value: str,
    agg: str,
    pivot_column: str | None = None,
    *,
    tiebreak: str | Sequence[str] | None = None,
    ignore_outliers: bool = False,
    where: Predicate | Column | None = None,
    order_by: str | None = None,
    direction: str = "ASC",
    limit: int | str | None = None,
    sortable: int = SORTABLE_ROWS,
) -> DataFrame:
    """Aggregate ``value`` over ten equal-count bins of ``column``; see ``deciles``.

    The label column is ``percentile``, with P0, P10, ..., P90. Rows of equal value are ordered
    by ``tiebreak``, then by a hash of the columns in use, so results are repeatable.
    """
    request = _Request("percentile", column, value, str(agg).upper(), pivot_column, order_by, direction, limit)
    request.check(df)
    ties = tie_keys(df, tiebreak, request.aggregated())
    rows = _survivors(request.slim(keep(df, where), ties), ignore_outliers, sortable)
    bins, count = _equal_count(rows, sortable)
    return request.result(bins, rows, count)


@dataclass(frozen=True)
class _Request:
    """What ``deciles`` and ``percentiles`` share: their arguments, and how a result is shaped."""

    name: str  # of the label column
    column: str
    value: str
    agg: str
    pivot_column: str | None
    order_by: str | None
    direction: str
    limit: int | str | None

    def aggregated(self) -> list[str]:
        return [self.value] if self.pivot_column is None else [self.value, self.pivot_column]

    def check(self, df: DataFrame) -> None:
        _check_bin_column(df, self.column)
        require_columns(df, self.aggregated())
        check_aggregate(df, self.value, self.agg)
        require_direction(self.direction)
        if self.limit is not None:
            require_limit(self.limit)
        if self.pivot_column is None:
            self._check_sort_column([self.agg.lower()])

    def _check_sort_column(self, names: list[str]) -> None:
        if self.order_by is not None and self.order_by not in (self.name, *names):
            raise ValueError(f"sort column {self.order_by!r} is not among {[self.name, *names]}")

    def slim(self, df: DataFrame, ties: list[Column]) -> DataFrame:
        """The rows with a value to bin, reduced to the columns in use, under internal names."""
        label = [] if self.pivot_column is None else [present(df, self.pivot_column).alias(LABEL)]
        value = value_column(df, self.value).alias(VALUE)
        return df.filter(is_present(df, self.column)).select(_bin_key(df, self.column), *label, value, *ties)

    def result(self, bins: EqualWidth | EqualCount, rows: DataFrame, count: int) -> DataFrame:
        """Aggregate per bin and join the result to the bin labels (at most ten rows)."""
        binned = bins.assign(rows)
        if self.pivot_column is None:
            table = aggregate(binned.select(BIN, VALUE), [BIN], VALUE, self.agg, CELL, count)
            names = [self.agg.lower()]
        else:
            labelled = binned.filter(F.col(LABEL).isNotNull()).select(BIN, LABEL, VALUE)
            table, names = spread(labelled, BIN, self.agg, count)
        self._check_sort_column(names)
        shown = apart_from(self.name, names)
        cells = table.columns[1:]
        every_bin = self.pivot_column is None or self.agg in ("SUM", "COUNT")
        # One aggregated row per bin, so both sides have at most ten rows.
        joined = _dimension(rows.sparkSession, bins).join(
            F.broadcast(table), BIN, "left" if every_bin else "inner"
        )
        if self.pivot_column is not None or self.agg not in UNDEFINED_WHEN_EMPTY:
            joined = joined.select(BIN, "text", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cells])
        order = [F.col(BIN)]
        if self.order_by is not None:
            key = "text" if self.order_by == self.name else cells[names.index(self.order_by)]
            order.insert(0, sort_key(F.col(key), require_direction(self.direction)))
        # The label side is a single partition, and the join keeps it so: a local sort is total.
        shaped = joined.sortWithinPartitions(*order)
        if self.limit is not None:
            shaped = shaped.limit(require_limit(self.limit))
        return shaped.select(F.col("text").alias(self.name), *[F.col(c).alias(n) for c, n in zip(cells, shown)])


def _dimension(spark: SparkSession, bins: EqualWidth | EqualCount) -> DataFrame:
    """Bin numbers with their label texts, in one partition."""
    texts = F.array(*[F.lit(text) for text in bins.labels()])
    number = F.col("id").cast("int")
    return spark.range(1, bins.count + 1, numPartitions=1).select(
        number.alias(BIN), F.element_at(texts, number).alias("text")
    )
