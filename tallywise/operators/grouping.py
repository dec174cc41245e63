"""Grouped aggregation in long form: one row per key combination.

All aggregates but the median combine on the map side, so a key that holds a third of the
table costs no more than any other. The exact median needs the values of a group together;
groups too large for that are answered by counting per (group, value range) first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import UNDEFINED_WHEN_EMPTY, aggregate_column, approximate_unique
from ..sources.workspace import stored
from .selection import SPLITS, bucketed, one_value_buckets, sketch_splits

# Values of one group that a single task may hold to compute a median.
MEDIAN_GROUP_ROWS = 1_000_000
# Large groups whose keys are broadcast.
MEDIAN_HOT_GROUPS = 1_000_000
# Value ranges of the first count for medians of larger groups; middle cells above
# MEDIAN_GROUP_ROWS are split again, as often as it takes.
MEDIAN_RANGES = 8_192


def aggregate(
    df: DataFrame,
    keys: list[str],
    value: str,
    agg: str,
    out: str,
    rows: int | None = None,
    group_rows: int = MEDIAN_GROUP_ROWS,
    approximate: bool = False,
) -> DataFrame:
    """``keys`` plus the aggregate of ``value`` as ``out``; groups without a mean or median drop out.

    ``rows``, when known, is an upper bound on the number of rows of ``df``. ``approximate``
    estimates COUNT_UNIQUE from HLL sketches (``functions.aggregates.sketch_of``).
    """
    if approximate and agg == "COUNT_UNIQUE":
        return df.groupBy(*keys).agg(approximate_unique(F.col(value)).alias(out))
    if agg in UNDEFINED_WHEN_EMPTY:
        df = df.filter(F.col(value).isNotNull())
    if agg == "MEDIAN" and (rows is None or rows > group_rows):
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        hot = sizes.filter(F.col("n") > group_rows)
        groups, total = hot.agg(F.count(F.lit(1)), F.sum("n")).first()
        if groups:
            return _by_group_size(df, keys, value, out, hot.select(*keys), groups, total)
    return df.groupBy(*keys).agg(aggregate_column(F.col(value), agg).alias(out))


def _by_group_size(
    df: DataFrame, keys: list[str], value: str, out: str, hot: DataFrame, groups: int, total: int
) -> DataFrame:
    """Medians of groups too large for one task by counting, of all others by Spark's own.

    The large groups are at most one for every MEDIAN_GROUP_ROWS rows, so their keys are a
    small table; it is broadcast once its count shows it.
    """
    keyed = F.broadcast(hot) if groups <= MEDIAN_HOT_GROUPS else hot
    others = df.join(keyed, keys, "left_anti").groupBy(*keys).agg(F.median(value).alias(out))
    return spread_median(df.join(keyed, keys, "left_semi"), keys, value, out, total).unionByName(others)


def spread_median(
    df: DataFrame, keys: list[str], value: str, out: str, rows: int, cell_rows: int = MEDIAN_GROUP_ROWS
) -> DataFrame:
    """Exact median per group without bringing any group together.

    Value ranges come from quantiles of the whole column; (group, range) cells are counted, a
    running count per group finds the cells with the middle ranks, and only those are looked at
    again. A middle cell of more than ``cell_rows`` rows is split anew by quantiles of its own
    values (``_refine``), and so on until every cell left holds one value or few rows; those few
    are ordered. ``rows`` is the size of ``df``.
    """
    ranges = min(max(rows // cell_rows, SPLITS), MEDIAN_RANGES)
    splits = sketch_splits(df.select(value), value, [], rows, ranges)
    ranged = bucketed(df, value, splits)
    cells = ranged.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    in_group = Window.partitionBy(*keys)
    running = in_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (
        cells.withColumn("below", F.sum("n").over(running) - F.col("n"))
        .withColumn("total", F.sum("n").over(in_group))
        .withColumn("left", F.floor((F.col("total") - 1) / 2))
        .withColumn("right", F.floor(F.col("total") / 2))
        .filter(_holds("left") | _holds("right"))
        .select(*keys, "bucket", "n", "low", "high", "below", "left", "right")
    )
    # Cells of one value are settled by it; large ones are split again; the rest are ordered.
    settled, open_cells = _refine(ranged, keys, value, stored(middle, "median_cells"), cell_rows)
    # Repeated values are counted before they meet the cells, so a frequent one is a single row.
    counts = (
        ranged.filter(~F.col("bucket").isin(one_value_buckets(splits)))
        .groupBy(*keys, "bucket", value)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(open_cells, [*keys, "bucket"])
        .filter(F.col(value).between(F.col("low"), F.col("high")))
    )
    in_cell = (
        Window.partitionBy(*keys, "bucket", "low")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ordered = (
        counts.withColumn("below", F.col("below") + F.sum("n").over(in_cell) - F.col("n"))
        .filter(_holds("left") | _holds("right"))
        .select(*keys, *[F.when(_holds(r), F.col(value)).alias(r) for r in ("left", "right")])
    )
    return (
        settled.unionByName(ordered)
        .groupBy(*keys)
        .agg(((F.max("left").cast("double") + F.max("right").cast("double")) / 2).alias(out))
    )


# Parts a cell above the bound is split into per round; rounds before the rest is ordered anyway.
SUB_SPLITS = 64
MAX_ROUNDS = 32
# Cells whose bounds are broadcast to the rows, at most.
BROADCAST_CELLS = 1_000_000


def _refine(
    ranged: DataFrame, keys: list[str], value: str, middle: DataFrame, cell_rows: int
) -> tuple[DataFrame, DataFrame]:
    """(settled, open): middle-rank values of one-value cells, and the cells left to order.

    A cell is (keys, bucket) with all its values in [low, high]. Each round splits the cells of
    more than ``cell_rows`` rows by approximate quantiles of their own values: a value equal to a
    split point gets a part of its own (so every round splits such a cell in two at least), the
    values between two split points another; the parts are counted, and only those with the
    middle ranks go on. Cell bounds and split points are broadcast once counted small.
    """
    frame = ["low", "high", "below", "left", "right"]
    settled_parts, open_parts = [], []
    fractions = [i / SUB_SPLITS for i in range(1, SUB_SPLITS)]
    for _ in range(MAX_ROUNDS):
        one = middle.filter(F.col("low") == F.col("high"))
        settled_parts.append(one.select(*keys, *[F.when(_holds(r), F.col("low")).alias(r) for r in ("left", "right")]))
        open_parts.append(middle.filter((F.col("low") != F.col("high")) & (F.col("n") <= cell_rows)).select(*keys, "bucket", *frame))
        big = middle.filter((F.col("low") != F.col("high")) & (F.col("n") > cell_rows)).select(*keys, "bucket", *frame)
        count = big.count()
        if count == 0:
            break
        bounds = F.broadcast(big) if count <= BROADCAST_CELLS else big
        rows_in = ranged.join(bounds, [*keys, "bucket"]).filter(F.col(value).between(F.col("low"), F.col("high")))
        cell = [*keys, "bucket", "low"]
        points = rows_in.groupBy(*cell).agg(F.percentile_approx(value, fractions, 10_000).alias("points"))
        points = F.broadcast(points) if count <= BROADCAST_CELLS else points
        v = F.col(value)
        part = 2 * F.size(F.filter("points", lambda p: p < v)) + F.exists("points", lambda p: p == v).cast("int")
        parts = (
            rows_in.join(points, cell)
            .groupBy(*cell, "below", "left", "right", part.alias("part"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("part_low"), F.max(value).alias("part_high"))
        )
        running = Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        middle = stored(
            parts.withColumn("below", F.col("below") + F.sum("n").over(running) - F.col("n"))
            .filter(_holds("left") | _holds("right"))
            .select(*keys, "bucket", "n", F.col("part_low").alias("low"), F.col("part_high").alias("high"), "below", "left", "right"),
            "median_parts",
        )
    else:
        # Rounds used up: the cells left are ordered as they are (exact, on fewer tasks).
        open_parts.append(middle.filter(F.col("low") != F.col("high")).select(*keys, "bucket", *frame))
    settled = settled_parts[0]
    for more in settled_parts[1:]:
        settled = settled.unionByName(more)
    cells = open_parts[0]
    for more in open_parts[1:]:
        cells = cells.unionByName(more)
    return settled, cells


def _holds(rank: str) -> Column:
    return (F.col("below") <= F.col(rank)) & (F.col(rank) < F.col("below") + F.col("n"))
