"""JSON export: one record per row, missing values written as null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import data_type, is_floating
from ..functions.missing import col
from ..functions.predicates import Predicate
from ..operators.rows import show

# Digits kept after the decimal point.
DECIMALS = 10
_OPTIONS = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}


def json_values(df: DataFrame) -> DataFrame:
    """Floats rounded for export; NaN and infinities, which JSON lacks, become null."""

    def exported(name: str) -> Column:
        c = col(name)
        if not is_floating(data_type(df, name)):
            return c
        finite = ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))
        return F.when(finite, F.round(c, DECIMALS)).alias(name)

    return df.select(*[exported(name) for name in df.columns])


def to_json_records(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as the text of one JSON object."""
    return json_values(df).select(F.to_json(F.struct("*"), _OPTIONS).alias(out))


def write_json(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    *,
    where: Predicate | Column | None = None,
    order_by: str | None = None,
    direction: str = "ASC",
    limit: int | str | None = None,
    tiebreak: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Write records as JSON Lines, in parallel; with ``order_by`` the part files are in order."""
    shown = show(
        df, columns, where=where, order_by=order_by, direction=direction, limit=limit, tiebreak=tiebreak
    )
    json_values(shown).write.mode(mode).options(**_OPTIONS).json(path)
