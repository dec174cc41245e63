"""Argument checks shared by the operators; every one runs before any Spark job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DIRECTIONS = ("ASC", "DESC")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Exact, case-sensitive check that every name is a column of ``df``."""
    known = set(df.columns)
    unknown = [name for name in names if name not in known]
    if unknown:
        raise ValueError(f"unknown column(s): {', '.join(map(str, unknown))}")


def require_direction(direction: str) -> bool:
    """Return True for ascending; anything but ASC/DESC is an error."""
    if not isinstance(direction, str) or direction.upper() not in DIRECTIONS:
        raise ValueError(f"sort direction must be ASC or DESC, got {direction!r}")
    return direction.upper() == "ASC"


def require_limit(limit: int | str) -> int:
    """A positive integer, also accepted as text ("10")."""
    try:
        if isinstance(limit, (bool, float)):
            raise ValueError
        n = int(limit)
    except (TypeError, ValueError):
        raise ValueError(f"limit must be a positive integer, got {limit!r}") from None
    if n <= 0:
        raise ValueError(f"limit must be a positive integer, got {limit!r}")
    return n


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_numeric(dt: T.DataType) -> bool:
    """Booleans count as numbers, as they do in pandas."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def require_numeric(df: DataFrame, name: str, purpose: str) -> None:
    dt = data_type(df, name)
    if not is_numeric(dt):
        raise TypeError(f"{purpose} needs a numeric column, {name!r} is {dt.simpleString()}")


def require_rankable(df: DataFrame, name: str, purpose: str) -> None:
    """A numeric column whose values keep their order as 64-bit numbers: decimals of at most 15 digits do."""
    require_numeric(df, name, purpose)
    dt = data_type(df, name)
    if isinstance(dt, T.DecimalType) and dt.precision > 15:
        raise TypeError(f"{purpose} needs at most 15 digits, {name!r} is {dt.simpleString()}; cast it to double or bigint")
