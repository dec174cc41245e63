"""Exact order statistics of a distributed column, without sorting or moving the table.

The question "which row has rank r?" is answered by narrowing. Rough quantiles of a sample
propose split points, one counting pass over all rows finds the bucket in which r falls, and
only rows of that bucket are looked at again. What leaves the executors is a count per bucket; rows are
sorted only once the bucket holds few enough of them for one ordinary task. A value that is
repeated so often that it fills a bucket alone is resolved by the next key of the chain.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import EXACT_INTEGER

# Rows that one task may sort in the last step of a narrowing.
SORTABLE_ROWS = 1_000_000
# Split points proposed per narrowing pass, and the sketch's precision relative to their distance.
SPLITS = 512
SKETCH_PRECISION = 4
# Sketches are merged by this many tasks before the driver combines their quantiles.
SKETCH_TASKS = 64
# Rows sampled per proposed split. Only where to split comes from the sample, never a result.
SAMPLED_PER_SPLIT = 2_000


@dataclass(frozen=True)
class Position:
    """Where a rank falls: the key values there, and the ranks that share these values.

    ``keys`` may be shorter than the key chain when the remaining keys make no difference.
    """

    keys: tuple
    first: int
    rows: int

    @property
    def last(self) -> int:
        return self.first + self.rows - 1


@dataclass(frozen=True)
class _Region:
    """Rows whose leading keys equal ``prefix`` and whose next key lies in [low, high]."""

    prefix: tuple
    low: float | int | None
    high: float | int | None
    below: int
    rows: int
    ranks: tuple[int, ...]

    @property
    def level(self) -> int:
        return len(self.prefix)

    @property
    def bounded(self) -> bool:
        return self.low is not None

    @property
    def one_value(self) -> bool:
        return self.bounded and self.low == self.high

    @property
    def unsplittable(self) -> bool:
        """Several values, yet no double between them: large integers that round together."""
        return (
            self.bounded
            and self.low != self.high
            and math.nextafter(float(self.low), math.inf) >= float(self.high)
        )

    def contains(self, keys: list[str]) -> str:
        """SQL test: the row belongs to the region."""
        tests = [f"{k} = {sql_number(v)}" for k, v in zip(keys, self.prefix)]
        if self.bounded:
            tests.append(f"{keys[self.level]} BETWEEN {sql_number(self.low)} AND {sql_number(self.high)}")
        return " AND ".join(tests) or "true"


def sql_number(value: float | int) -> str:
    """A literal that Spark reads back as exactly this number."""
    if isinstance(value, int):
        return f"{value}L"
    return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"


def positions(
    df: DataFrame,
    keys: list[str],
    rows: int,
    ranks: Iterable[int],
    ranks_by_value: Iterable[int] = (),
    sortable: int = SORTABLE_ROWS,
    few_values: bool = False,
) -> dict[int, Position]:
    """Locate 0-based ranks in the order given by ``keys``.

    ``keys`` are numeric columns without missing values and ``rows`` is the row count of
    ``df``. Ranks in ``ranks_by_value`` are only located by the first key, so that ties among
    the later keys are never resolved for them. ``few_values`` tells that the first key has
    many rows per value, so that counting its values comes before sorting rows.
    """
    deep = set(ranks)
    wanted = sorted(deep | set(ranks_by_value))
    found: dict[int, Position] = {}
    pending = [_Region((), None, None, 0, rows, tuple(wanted))]
    while pending:
        countable = [r for r in pending if r.unsplittable or (few_values and r.level == 0 and r.rows <= sortable)]
        sortable_now = [r for r in pending if r.rows <= sortable and r not in countable]
        if sortable_now:
            found |= _sorted_positions(df, keys, sortable_now)
        large = [r for r in pending if r not in sortable_now]
        if not large:
            break
        level = min(r.level for r in large)
        here = [r for r in large if r.level == level]
        coarse = [r for r in here if r in countable]
        pending = [r for r in large if r.level > level]
        narrowed = []
        if coarse:
            narrowed += _distinct_values(df, keys, coarse)
        if len(coarse) < len(here):
            narrowed += _narrow(df, keys, level, [r for r in here if r not in coarse])
        for region in narrowed:
            pending += _settle(region, keys, deep, found)
    return found


def _settle(region: _Region, keys: list[str], deep: set[int], found: dict[int, Position]) -> list[_Region]:
    """Record the ranks that a region already answers; return what is left to narrow."""
    if not region.one_value:
        return [region]
    here = Position((*region.prefix, region.low), region.below, region.rows)
    last_level = region.level + 1 == len(keys)
    open_ranks = []
    for rank in region.ranks:
        if last_level or rank == here.last or rank not in deep:
            found[rank] = here
        else:
            open_ranks.append(rank)
    if not open_ranks:
        return []
    return [_Region(here.keys, None, None, region.below, region.rows, tuple(open_ranks))]


def _tagged(df: DataFrame, keys: list[str], regions: list[_Region]) -> DataFrame:
    """The rows of the given regions, with the index of their region."""
    tests = [r.contains(keys) for r in regions]
    tag = " ".join(f"WHEN {test} THEN {i}" for i, test in enumerate(tests))
    return df.filter(" OR ".join(f"({test})" for test in tests)).withColumn("region", F.expr(f"CASE {tag} END"))


def _running_counts(df: DataFrame, keys: list[str], regions: list[_Region], order: list[str]) -> list:
    """Per region, the ``order`` values at its ranks: the rows up to and with them, and their number.

    A single key is counted per value first, which combines on the map side. A longer chain
    exists to tell rows apart, so its rows go to their region's task as they are.
    """
    rows = _tagged(df, keys, regions)
    in_order = Window.partitionBy("region").orderBy(*order)
    if len(order) == 1:
        upto = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = rows.groupBy("region", *order).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
        at_rank = "upto > {0} AND upto - n <= {0}"
    else:
        with_peers = in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        counts = (
            rows.select("region", *order, F.row_number().over(in_order).alias("place"))
            .withColumn("upto", F.count(F.lit(1)).over(with_peers))
            .withColumn("n", F.col("upto") - F.rank().over(in_order) + 1)
        )
        at_rank = "place = {0} + 1"
    hits = [
        f"region = {i} AND {at_rank.format(rank - r.below)}" for i, r in enumerate(regions) for rank in r.ranks
    ]
    return counts.filter(" OR ".join(hits)).collect()


def _sorted_positions(df: DataFrame, keys: list[str], regions: list[_Region]) -> dict[int, Position]:
    """Resolve regions small enough to be sorted by one task each."""
    level = min(r.level for r in regions)
    found = {}
    for row in _running_counts(df, keys, regions, keys[level:]):
        region = regions[row["region"]]
        first = region.below + row["upto"] - row["n"]
        here = Position((*region.prefix[:level], *[row[k] for k in keys[level:]]), first, row["n"])
        found |= {rank: here for rank in region.ranks if here.first <= rank <= here.last}
    return found


def _distinct_values(df: DataFrame, keys: list[str], regions: list[_Region]) -> list[_Region]:
    """Split regions into their distinct values, as far as ranks fall on them."""
    level = regions[0].level
    split = []
    for row in _running_counts(df, keys, regions, [keys[level]]):
        region = regions[row["region"]]
        below = region.below + row["upto"] - row["n"]
        ranks = tuple(rank for rank in region.ranks if below <= rank < below + row["n"])
        value = row[keys[level]]
        split.append(_Region(region.prefix, value, value, below, row["n"], ranks))
    return split


def _narrow(df: DataFrame, keys: list[str], level: int, regions: list[_Region]) -> list[_Region]:
    """One sketch pass and one counting pass: regions shrink to the buckets holding their ranks."""
    key = keys[level]
    rows = _tagged(df, keys, regions)
    splits = sketch_splits(rows, key, by=["region"], rows=min(r.rows for r in regions))
    for region in regions:
        if region.bounded:
            splits |= {float(region.low), math.nextafter(float(region.low), math.inf), float(region.high)}
    counted = (
        bucketed(rows, key, splits)
        .groupBy("region", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        .collect()
    )
    narrowed = []
    for i, region in enumerate(regions):
        below = region.below
        for row in sorted((r for r in counted if r["region"] == i), key=lambda r: r["bucket"]):
            ranks = tuple(rank for rank in region.ranks if below <= rank < below + row["n"])
            if ranks:
                narrowed.append(_Region(region.prefix, row["low"], row["high"], below, row["n"], ranks))
            below += row["n"]
    return narrowed


def sketch_splits(df: DataFrame, key: str, by: list[str], rows: int, splits: int = SPLITS) -> set[float]:
    """Approximate quantiles of ``key`` per group of ``by`` (a few groups), as split points.

    A sample suffices when each group has at least ``rows`` rows and these are plenty. Task
    outputs are sketched in SKETCH_TASKS reducers, not in one, and their quantiles are combined
    by weight. A value that repeats among the quantiles gets a bucket of its own.
    """
    share = splits * SAMPLED_PER_SPLIT / max(rows, 1)
    if share < 1:
        df = df.sample(share)
    grid = ", ".join(f"{i / splits}D" for i in range(splits + 1))
    sketches = (
        df.select(*by, F.col(key).cast("double").alias("k"), F.spark_partition_id().alias("task"))
        .groupBy(*by, F.pmod("task", F.lit(SKETCH_TASKS)).alias("task"))
        .agg(
            F.count("k").alias("n"),
            F.expr(f"percentile_approx(k, array({grid}), {SKETCH_PRECISION * splits})").alias("q"),
        )
        .collect()
    )
    points: set[float] = set()
    for group in {tuple(s[b] for b in by) for s in sketches}:
        mine = [s for s in sketches if tuple(s[b] for b in by) == group]
        weighted = sorted((q, s["n"] / len(s["q"])) for s in mine for q in s["q"])
        step = sum(w for _, w in weighted) / splits
        seen, due, previous = 0.0, 0.0, None
        for value, weight in weighted:
            seen += weight
            while due <= seen:
                due += step
                if value == previous:
                    points.add(math.nextafter(value, math.inf))
                points.add(value)
                previous = value
    return points


def bucket_bounds(splits: Iterable[float]) -> list[float]:
    """Increasing bounds; bucket i holds the keys from bound i up to, but without, bound i + 1."""
    inner = sorted(s for s in set(splits) if math.isfinite(s))
    return [-math.inf, *(inner or [0.0]), math.inf]


def one_value_buckets(splits: Iterable[float]) -> list[int]:
    """Buckets that can only hold a single value: those between two adjacent doubles."""
    bounds = bucket_bounds(splits)
    return [
        i
        for i, (a, b) in enumerate(zip(bounds, bounds[1:]))
        if abs(a) < EXACT_INTEGER and math.nextafter(a, math.inf) == b
    ]


def bucketed(df: DataFrame, key: str, splits: Iterable[float]) -> DataFrame:
    """Add ``bucket``: a pure, order-preserving function of ``key`` by binary search in the splits."""
    with_double = df.withColumn("bucket_key", F.col(key).cast("double"))
    stage = Bucketizer(splits=bucket_bounds(splits), inputCol="bucket_key", outputCol="bucket")
    return stage.transform(with_double).drop("bucket_key")
