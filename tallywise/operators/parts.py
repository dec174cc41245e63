"""Divide the rows of a table at given ranks of an order, by comparing each row with the cuts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import data_type, require_columns
from ..functions.missing import col, number, present
from .selection import SORTABLE_ROWS, Position, positions, sql_number

TIE, REST, PART = "__tie", "__rest", "__part"
# Copies of one row are handed out again in batches of this many.
_COPY_BATCH = 65_536
_LOWEST = -(2**63)


@dataclass(frozen=True)
class Parts:
    """Parts 1, 2, ... of a table: part i ends with the row at ``last_ranks[i - 1]``.

    ``cuts`` are the positions of these ranks in the order of the numeric columns ``keys``,
    and ``rows`` is the size of the table.
    """

    keys: tuple[str, ...]
    cuts: tuple[Position, ...]
    last_ranks: tuple[int, ...]
    rows: int

    def assign(self, df: DataFrame, out: str = PART) -> DataFrame:
        """Add the part number of each row.

        A row's part follows from its own keys, except for identical rows that straddle a cut.
        """
        torn = [
            cut
            for cut in dict.fromkeys(self.cuts)
            if any(cut.first <= rank < cut.last for rank in self.last_ranks)
        ]
        if not torn:
            return df.withColumn(out, self._number())
        at_cut = {cut.first: self._equals(cut) for cut in torn}
        straddling = " OR ".join(f"({test})" for test in at_cut.values())
        apart = df.filter(f"NOT ({straddling})").withColumn(out, self._number())
        first = " ".join(f"WHEN {test} THEN {rank}L" for rank, test in at_cut.items())
        copies = df.filter(straddling).withColumn("__first", F.expr(f"CASE {first} END"))
        return apart.unionByName(self._hand_out(copies, df.columns, out))

    def _number(self) -> Column:
        passed = " + ".join(f"int({self._after(cut)})" for cut in self.cuts)
        return F.expr(f"coalesce(1 + {passed}, {len(self.cuts) + 1})")

    def _after(self, cut: Position) -> str:
        """SQL test: the row comes after the cut in the order of the keys."""
        test = ""
        for name, value in reversed(list(zip(self.keys, cut.keys))):
            v = sql_number(value)
            test = f"({name} > {v} OR ({name} = {v} AND {test}))" if test else f"{name} > {v}"
        return test

    def _equals(self, cut: Position) -> str:
        return " AND ".join(f"{name} = {sql_number(value)}" for name, value in zip(self.keys, cut.keys))

    def _hand_out(self, copies: DataFrame, names: list[str], out: str) -> DataFrame:
        """Split identical rows that straddle a cut by their number, whichever copy goes where.

        ``__first`` is the rank of the first of them. Copies are counted (combining on the map
        side), the count is divided among the parts, and the rows are repeated in batches that
        spread over all tasks.
        """
        tasks = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counted = copies.groupBy("__first", *[col(n) for n in names]).agg(F.count(F.lit(1)).alias("__n"))
        # More than one distinct row per cut only if their hashes collide.
        running = Window.partitionBy("__first").orderBy(*[col(n) for n in hashable(copies)])
        upto = F.sum("__n").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = counted.withColumn("__end", F.col("__first") + upto)
        bounds = [0, *[r + 1 for r in self.last_ranks], self.rows]
        shares = ", ".join(
            f"struct({i + 1} AS number, least(__end, {high}L) - greatest(__end - __n, {low}L) AS size)"
            for i, (low, high) in enumerate(zip(bounds, bounds[1:]))
        )
        share = F.col("__share")
        batches = F.sequence(F.lit(0).cast("long"), F.floor((share["size"] - 1) / _COPY_BATCH))
        repeat = F.least(F.lit(_COPY_BATCH), share["size"] - F.col("__batch") * _COPY_BATCH)
        return (
            placed.withColumn("__share", F.explode(F.expr(f"array({shares})")))
            .filter(share["size"] > 0)
            .withColumn("__batch", F.explode(batches))
            .repartition(tasks, "__batch", share["number"])
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), repeat.cast("int"))))
            .select(*[col(n) for n in names], share["number"].alias(out))
        )


def divide(
    df: DataFrame,
    keys: Sequence[str],
    last_ranks: Sequence[int],
    rows: int,
    ranks_by_value: Iterable[int] = (),
    sortable: int = SORTABLE_ROWS,
    few_values: bool = False,
) -> tuple[Parts, dict[int, Position]]:
    """Find the cuts behind ``last_ranks``; also returns all positions looked up on the way."""
    # The hash is only needed without a tie-break, or where the tie-break leaves rows tied.
    chains = [[k for k in keys if k != REST], list(keys)] if TIE in keys else [list(keys)]
    for chain in chains:
        found = positions(df.select(*chain), chain, rows, last_ranks, ranks_by_value, sortable, few_values)
        cuts = tuple(found[r] for r in last_ranks)
        if all(rank == cut.last for rank, cut in zip(last_ranks, cuts)):
            break
    return Parts(tuple(chain), cuts, tuple(last_ranks), rows), found


def first_part(df: DataFrame, keys: Sequence[str], n: int, sortable: int = SORTABLE_ROWS) -> DataFrame:
    """The n first rows in the order of the keys, in no particular order and on all tasks."""
    rows = df.count()
    if rows <= n:
        return df
    parts, _ = divide(df, keys, [n - 1], rows, sortable=sortable)
    return parts.assign(df).filter(F.col(PART) == 1).drop(PART)


def hashable(df: DataFrame) -> list[str]:
    """Columns that can be hashed and ordered: all but maps."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def has_number_key(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))


def number_key(df: DataFrame, name: str) -> Column:
    """A number that orders like the column: whole numbers stay exact, others become doubles."""
    dt = data_type(df, name)
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(col(name))
    if isinstance(dt, T.DateType):
        return F.unix_date(col(name)).cast("long")
    if isinstance(dt, T.TimestampNTZType):
        c = col(name)
        minutes = (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)) * 60 + F.minute(c)
        return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    whole = isinstance(dt, (T.IntegralType, T.BooleanType))
    return number(df, name).cast("long" if whole else "double")


# Bytes of a text that one number of its chain holds; digits of a decimal that fit a long.
_TEXT_BYTES, _DECIMAL_DIGITS = 7, 18


def has_order_chain(dt: T.DataType) -> bool:
    return has_number_key(dt) or isinstance(dt, T.StringType)


def order_chain(df: DataFrame, name: str, ascending: bool) -> list[Column]:
    """Numbers that, compared one after another, order rows as the column does, missing values last.

    The first says whether the value is missing. A decimal beyond 18 digits is three whole
    numbers, thirteen of its digits each. A text is its bytes, seven at a time, then its length; the
    longest text decides how many there are.
    """
    dt, c = data_type(df, name), col(name)
    missing = present(df, name).isNull()
    if isinstance(dt, T.StringType):
        longest = df.agg(F.max(F.octet_length(c))).first()[0] or 0
        raw = c.cast("binary")
        pieces = [F.hex(F.substring(raw, i + 1, _TEXT_BYTES)) for i in range(0, longest, _TEXT_BYTES)]
        digits = 2 * _TEXT_BYTES
        keys = [F.conv(F.rpad(F.concat(F.lit("0"), p), digits + 1, "0"), 16, 10).cast("long") for p in pieces]
        keys.append(F.octet_length(c).cast("long"))
    elif isinstance(dt, T.DecimalType) and dt.precision > _DECIMAL_DIGITS:
        keys = _decimal_keys(c, dt)
    elif isinstance(dt, T.DecimalType):
        keys = [(c * F.lit(10**dt.scale).cast(T.DecimalType(19, 0))).cast("long")]
    else:
        keys = [number_key(df, name)]
    if not ascending:
        whole = [isinstance(f.dataType, T.LongType) for f in df.select(*keys).schema.fields]
        keys = [F.bitwise_not(k) if w else -k for k, w in zip(keys, whole)]
    filled = [F.when(missing, F.lit(0)).otherwise(k) for k in keys]
    return [missing.cast("long"), *filled]


def _decimal_keys(c: Column, dt: T.DecimalType) -> list[Column]:
    """The digits of a decimal in three groups, from its plain text; those of a negative value are negated."""
    # Tiny values are written with an exponent otherwise.
    plain = F.format_number(F.abs(c), dt.scale)
    digits = F.lpad(F.regexp_replace(plain, "[,.]", ""), 3 * 13, "0")
    sign = F.when(c < 0, F.lit(-1)).otherwise(F.lit(1))
    return [F.substring(digits, 13 * i + 1, 13).cast("long") * sign for i in range(3)]


def tie_keys(df: DataFrame, tiebreak: str | Sequence[str] | None, rest: Sequence[str]) -> list[Column]:
    """Numeric keys that order rows of equal value: the tie-break, then a hash of ``rest``.

    Several tie-break columns, or one of text, count by their hash: an arbitrary order, but
    the same in every run.
    """
    names = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak or [])
    require_columns(df, names)
    keys = []
    if len(names) == 1 and has_number_key(data_type(df, names[0])):
        key = number_key(df, names[0])
        whole = not isinstance(data_type(df, names[0]), T.FractionalType)
        keys.append(F.coalesce(key, F.lit(_LOWEST) if whole else F.lit(float("-inf"))).alias(TIE))
    elif names:
        keys.append(F.xxhash64(*[col(n) for n in names]).alias(TIE))
    return [*keys, F.xxhash64(*[col(n) for n in rest]).alias(REST)]
