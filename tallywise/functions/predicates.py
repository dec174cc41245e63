"""Row predicates as small immutable trees that compile to one Spark ``Column``.

Comparisons follow two-valued logic: a missing value never matches, except for ``ne``,
which it always matches. A literal takes the column's own type, exactly: an integer or decimal
column is compared with an integer or decimal, so the comparison is free of casts and is pushed
to the Parquet scan. Numbers for a text column are compared as text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, datetime
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import data_type, is_floating, is_numeric, require_columns
from .missing import col

# Below this magnitude every integer is a double of its own.
EXACT_INTEGER = 2**53


class Predicate:
    """Base class; ``p & q`` and ``p | q`` are shorthands for all_of and any_of."""

    def to_column(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_of(self, other)


@dataclass(frozen=True)
class Compare(Predicate):
    column: str
    op: str
    value: object

    def to_column(self, df: DataFrame) -> Column:
        require_columns(df, [self.column])
        dt = data_type(df, self.column)
        if is_numeric(dt):
            return _compare_number(col(self.column), dt, self.op, _as_number(self.column, self.value))
        if self.op not in ("eq", "ne"):
            raise TypeError(f"{self.op} needs a numeric column, {self.column!r} is {dt.simpleString()}")
        return _equality(col(self.column), self.op, _literal(self.column, dt, self.value))


@dataclass(frozen=True)
class Text(Predicate):
    column: str
    pattern: str
    regex: bool

    def to_column(self, df: DataFrame) -> Column:
        require_columns(df, [self.column])
        dt = data_type(df, self.column)
        if not isinstance(dt, T.StringType):
            raise TypeError(f"text matching needs a string column, {self.column!r} is {dt.simpleString()}")
        c = col(self.column)
        if self.regex:
            return c.rlike("(?iU)" + self.pattern)
        return F.contains(F.lower(c), F.lower(F.lit(self.pattern)))


@dataclass(frozen=True)
class Group(Predicate):
    parts: tuple[Predicate, ...]
    every: bool

    def to_column(self, df: DataFrame) -> Column:
        columns = [part.to_column(df) for part in self.parts]
        combined = columns[0]
        for c in columns[1:]:
            combined = combined & c if self.every else combined | c
        return combined


def _as_number(column: str, value: object) -> Decimal | float:
    """Finite numbers as exact decimals, whatever type or text they come in; else inf or nan."""
    try:
        exact = Decimal(str(value).strip()) if not isinstance(value, bool) else Decimal(int(value))
        return exact if exact.is_finite() else float(value)  # type: ignore[arg-type]
    except (InvalidOperation, TypeError, ValueError):
        pass
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise TypeError(f"column {column!r} is numeric, {value!r} is not a number") from None


def _literal(column: str, dt: T.DataType, value: object) -> Column:
    """A literal of the column's own kind, so that no row can fail to convert."""
    if isinstance(dt, T.StringType):
        return F.lit(str(value))
    parse = {T.DateType: date.fromisoformat, T.TimestampType: datetime.fromisoformat}.get(type(dt))
    if parse is not None and isinstance(value, str):
        try:
            value = parse(value.strip())
        except ValueError:
            raise TypeError(f"column {column!r} is a {dt.simpleString()}, {value!r} is not") from None
    if parse is not None and not isinstance(value, date):
        raise TypeError(f"column {column!r} is a {dt.simpleString()}, {value!r} is not")
    return F.lit(value)


def _equality(c: Column, op: str, literal: Column) -> Column:
    return c == literal if op == "eq" else ~c.eqNullSafe(literal)


def _compare_number(c: Column, dt: T.DataType, op: str, value: Decimal | float) -> Column:
    """Compare on the column's own type: exact for whole numbers and decimals, and free of casts."""
    if isinstance(value, float) and math.isnan(value):
        return F.lit(op == "ne")
    if isinstance(dt, T.BooleanType):
        c, dt = c.cast("int"), T.IntegerType()
    if isinstance(dt, (T.IntegralType, T.DecimalType)):
        if isinstance(value, float):  # infinite
            return _beyond(c, op, above=value > 0)
        return _compare_exact(c, dt, op, value)
    literal = F.lit(float(value)).cast(dt)
    if op in ("eq", "ne"):
        return _equality(c, op, literal)
    test = {"gt": c > literal, "lt": c < literal, "ge": c >= literal, "le": c <= literal}[op]
    # Spark orders NaN above every number, so only > and >= can let one through.
    return test & ~F.isnan(c) if op in ("gt", "ge") and is_floating(dt) else test


def _beyond(c: Column, op: str, above: bool) -> Column:
    """A literal above or below everything that the column can hold."""
    holds = op == "ne" or (op in ("lt", "le")) == above and op != "eq"
    if op == "ne":
        return F.lit(True)
    return c.isNotNull() if holds else F.lit(False)


_DIGITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _compare_exact(c: Column, dt: T.DataType, op: str, value: Decimal) -> Column:
    """Round the literal to the column's scale in the direction that keeps the comparison true."""
    if isinstance(dt, T.DecimalType):
        step, low, high = Decimal(1).scaleb(-dt.scale), None, Decimal(10) ** (dt.precision - dt.scale)
        low = -high
    else:
        step, high = Decimal(1), Decimal(2 ** (_DIGITS[type(dt)] - 1))
        low = -high - 1
    if not low < value < high:
        return _beyond(c, op, above=value > 0)
    with localcontext() as wide:
        wide.prec = 400
        down, up = (value.quantize(step, rounding=r) for r in (ROUND_FLOOR, ROUND_CEILING))
        if op in ("eq", "ne") and down != up:
            return F.lit(op == "ne")
    bound = {"gt": down, "le": down}.get(op, up)
    if not low < bound < high:
        return _beyond(c, op, above=bound > 0)
    literal = F.lit(bound).cast(dt) if isinstance(dt, T.DecimalType) else F.lit(int(bound)).cast(dt)
    if op in ("eq", "ne"):
        return _equality(c, op, literal)
    return {"gt": c > literal, "lt": c < literal, "ge": c >= literal, "le": c <= literal}[op]


def eq(column: str, value: object) -> Predicate:
    """column = value; on a numeric column the value may be a number or its text."""
    return Compare(column, "eq", value)


def ne(column: str, value: object) -> Predicate:
    """column != value; rows whose column is missing are kept."""
    return Compare(column, "ne", value)


def gt(column: str, value: object) -> Predicate:
    return Compare(column, "gt", value)


def lt(column: str, value: object) -> Predicate:
    return Compare(column, "lt", value)


def ge(column: str, value: object) -> Predicate:
    return Compare(column, "ge", value)


def le(column: str, value: object) -> Predicate:
    return Compare(column, "le", value)


def like(column: str, text: str) -> Predicate:
    """Case-insensitive substring; every character of ``text`` stands for itself."""
    return Text(column, text, regex=False)


def regex_like(column: str, pattern: str) -> Predicate:
    """Case-insensitive regular-expression search anywhere in the text."""
    return Text(column, pattern, regex=True)


def all_of(*parts: Predicate) -> Predicate:
    """Every part holds (AND); parts may themselves be groups."""
    return _group(parts, every=True)


def any_of(*parts: Predicate) -> Predicate:
    """At least one part holds (OR); parts may themselves be groups."""
    return _group(parts, every=False)


def _group(parts: tuple[Predicate, ...], every: bool) -> Predicate:
    if not parts:
        raise ValueError("a predicate group needs at least one part")
    return Group(tuple(parts), every)
