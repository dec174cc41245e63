"""One-column statistics: profile, value counts, exact quantiles and the IQR fence."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import data_type, require_columns, require_rankable
from ..functions.missing import col, drop_missing, is_present, number, present
from .parts import number_key
from .selection import SORTABLE_ROWS, Position, positions

# An estimate above this proves that a column has more than ten distinct values: the sketch
# behind it cannot report more than it has registers set, and ten values set at most ten.
_PLAINLY_MANY = 64


@dataclass(frozen=True)
class Summary:
    """Size and range of the present values of one numeric column."""

    rows: int
    low: float | int | None
    high: float | int | None
    distinct: int  # exact up to ten, otherwise just "more than ten"


@dataclass(frozen=True)
class Fence:
    """Quartiles and the outlier bounds 1.5 interquartile ranges beyond them."""

    q1: float
    q3: float

    @property
    def lower(self) -> float:
        return self.q1 - 1.5 * (self.q3 - self.q1)

    @property
    def upper(self) -> float:
        return self.q3 + 1.5 * (self.q3 - self.q1)

    def inside(self, name: str):
        return col(name).between(F.lit(self.lower), F.lit(self.upper))


def summarise(df: DataFrame, name: str) -> Summary:
    """One scan for size and range; few-valued columns cost a second, small one."""
    c = F.col(name)
    row = df.agg(
        F.count(c).alias("rows"),
        F.min(c).alias("low"),
        F.max(c).alias("high"),
        F.approx_count_distinct(c).alias("distinct"),
    ).first()
    distinct = row["distinct"]
    if 0 < distinct <= _PLAINLY_MANY:
        distinct = df.agg(F.count_distinct(c)).first()[0]
    return Summary(row["rows"], row["low"], row["high"], distinct)


def quantile_ranks(prob: float, rows: int) -> tuple[int, int, float]:
    """Ranks on both sides of a quantile, and how far it lies from the lower to the upper one."""
    at = prob * (rows - 1)
    low = min(int(at), rows - 1)
    return low, min(low + 1, rows - 1), at - low


def interpolate(prob: float, rows: int, found: dict[int, Position]) -> float:
    low, high, share = quantile_ranks(prob, rows)
    a, b = float(found[low].keys[0]), float(found[high].keys[0])
    if a == b:
        return a
    return a + (b - a) * share if share < 0.5 else b - (b - a) * (1 - share)


def quantiles_of(df: DataFrame, key: str, rows: int, probs: Sequence[float], sortable: int = SORTABLE_ROWS) -> list[float]:
    """Exact, linearly interpolated quantiles of a missing-free selection key."""
    ranks = {rank for p in probs for rank in quantile_ranks(p, rows)[:2]}
    found = positions(df, [key], rows, (), ranks, sortable)
    return [interpolate(p, rows, found) for p in probs]


def exact_quantiles(
    df: DataFrame, column: str, probs: Iterable[float], sortable: int = SORTABLE_ROWS
) -> list[float | None]:
    """Quantiles of a numeric column with linear interpolation, ignoring missing values."""
    require_columns(df, [column])
    require_rankable(df, column, "a quantile")
    probs = [float(p) for p in probs]
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("quantile probabilities must lie between 0 and 1")
    values = drop_missing(df, column).select(number_key(df, column).alias("v"))
    rows = values.count()
    if rows == 0:
        return [None] * len(probs)
    return quantiles_of(values, "v", rows, probs, sortable)


def iqr_fence(df: DataFrame, column: str, sortable: int = SORTABLE_ROWS) -> Fence | None:
    """The outlier fence of a column; None when it has no values."""
    q1, q3 = exact_quantiles(df, column, [0.25, 0.75], sortable)
    return None if q1 is None else Fence(q1, q3)


def iqr_filter(df: DataFrame, column: str, sortable: int = SORTABLE_ROWS) -> DataFrame:
    """Rows inside the fence, bounds included; rows with a missing value are dropped."""
    fence = iqr_fence(df, column, sortable)
    kept = drop_missing(df, column)
    if fence is None:
        return kept
    if isinstance(data_type(df, column), T.BooleanType):
        return kept.filter(number(df, column).between(F.lit(fence.lower), F.lit(fence.upper)))
    return kept.filter(fence.inside(column))


def iqr_report(df: DataFrame, column: str, sortable: int = SORTABLE_ROWS) -> DataFrame:
    """One row: quartiles, fence bounds, rows inside, and rows removed as outliers."""
    fence = iqr_fence(df, column, sortable)
    if fence is None:
        raise ValueError(f"column {column!r} has no values")
    v = number(df, column)
    inside = v.between(F.lit(fence.lower), F.lit(fence.upper))
    return drop_missing(df, column).agg(
        F.lit(fence.q1).alias("q1"),
        F.lit(fence.q3).alias("q3"),
        F.lit(fence.lower).alias("lower_bound"),
        F.lit(fence.upper).alias("upper_bound"),
        F.count_if(inside).alias("kept"),
        F.count_if(~inside).alias("removed"),
    )


def profile(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """One row: type, smallest and largest value, distinct values, rows, and missing rows.

    ``approximate`` estimates the distinct count, which is the only part that moves values.
    """
    require_columns(df, [column])
    v = present(df, column)
    distinct = F.approx_count_distinct(v) if approximate else F.count_distinct(v)
    return df.agg(
        F.lit(data_type(df, column).simpleString()).alias("data_type"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        distinct.alias("distinct_values"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~is_present(df, column)).alias("missing_rows"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value (missing excluded), most frequent first; ties in value order."""
    require_columns(df, [column])
    name = "rows" if column == "count" else "count"
    return (
        drop_missing(df, column)
        .groupBy(col(column).alias(column))
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.desc(name), col(column))
    )
