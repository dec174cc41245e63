"""What the operators share: null-safe joins, size-checked broadcasts, group totals and row keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table of more rows than this is never broadcast; the rows are a few dozen bytes each.
BROADCAST_ROWS = 1_000_000
# A hot group is aggregated in so many parts before its parts meet.
PARTS = 64
# White space that separates words (space, and tab to carriage return), as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; the general ``lower`` agrees on ASCII texts and is faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def joined(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns where null equals null; the right side's copies of them go."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in columns else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__{c}"]) for c in columns])
    return left.join(renamed, on, how).drop(*[f"__{c}" for c in columns])


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table with a broadcast hint if a count shows that it is small; else as it is."""
    return F.broadcast(table) if table.count() <= rows else table


def with_group(
    rows: DataFrame, keys: Sequence[str], by: str, first: dict[str, Column], merge: dict[str, Column]
) -> DataFrame:
    """Add aggregates of the groups of ``keys`` to every row.

    A hot group is aggregated in PARTS parts, dealt by a hash of ``by``; then the parts are
    combined, and the result goes back part by part. No task holds a group's rows together.
    ``first`` makes the parts' aggregates, ``merge`` combines them under the same names.
    """
    parted = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    parts = parted.groupBy(*keys, "__part").agg(*[c.alias(n) for n, c in first.items()])
    whole = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
    placed = joined(parts.select(*keys, "__part"), whole, keys)
    return joined(parted, placed, [*keys, "__part"]).drop("__part")
