"""Mixing sources to target weights along a curriculum.

Each source has a weight that changes over training time (0 to 1). Its integral is the source's
share; shares are capped at a number of epochs and the excess is dealt out again. The schedule
also says how much of a source's target is used up by each time: inverting that cumulative
demand at a document's place within its source gives the document's position in training.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import stored
from .shared import WORD, joined, small, text_of

# Most times that a document is used.
EPOCHS = 3
# Rows of a source ordered by one task; hot sources are dealt to as many buckets as they need.
BUCKET_ROWS = 10_000
_ROW = ["__id", "__source", "size", "__order"]


@dataclass(frozen=True)
class Schedule:
    """A weight over training time, linear between knots (time, weight) from time 0 to 1."""

    knots: tuple[tuple[float, float], ...]

    def areas(self) -> list[float]:
        return [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(self.knots, self.knots[1:])]

    @property
    def weight(self) -> float:
        """The integral of the schedule."""
        return sum(self.areas())

    def time(self, share: Column) -> Column:
        """When the given share (0 to 1) of the source's demand is used up."""
        pieces, before = [], 0.0
        for (t0, w0), (t1, w1), area in zip(self.knots, self.knots[1:], self.areas()):
            rest = F.greatest(share * self.weight - before, F.lit(0.0))
            root = F.sqrt(F.greatest(2 * rest * ((w1 - w0) / (t1 - t0)) + w0 * w0, F.lit(0.0)))
            at = F.when(rest == 0, F.lit(t0)).otherwise(F.least(2 * rest / (root + w0) + t0, F.lit(t1)))
            before += area
            pieces.append((share * self.weight <= before, at))
        out = F.lit(self.knots[-1][0])
        for inside, at in reversed(pieces):
            out = F.when(inside, at).otherwise(out)
        return out


# Dealt to the sources in turn; weights 5, 2 and 1. The heaviest fade out, the lightest come late.
CURRICULUM = (
    Schedule(((0.0, 6.0), (1.0, 4.0))),
    Schedule(((0.0, 2.0), (1.0, 2.0))),
    Schedule(((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))),
)


def targets(sizes: DataFrame, schedules: Sequence[Schedule], epochs: int = EPOCHS) -> DataFrame:
    """Per source (one row each: ``__source``, ``source_size``): its schedule's number and its target.

    Sources take schedules in turn, ordered by code point with null last. Targets share the size
    of all sources by weight; none exceeds ``epochs`` times its source, and what is over goes to
    the others by weight. Ordered by the share at which they fill up, the full sources come
    first, so the common rate follows from running sums.
    """
    turn = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(s.weight) for s in schedules])
    turned = sizes.withColumn("schedule", turn % len(schedules)).withColumn("weight", weights[F.col("schedule")])
    order = [F.col("source_size") / F.col("weight"), F.col("__source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything)
    full = F.coalesce(F.sum(F.col("source_size") * epochs).over(before), F.lit(0))
    rate = (total - full) / F.sum("weight").over(after)
    rates = turned.withColumn("rate", rate).withColumn(
        "fits", F.col("source_size") * epochs >= F.col("rate") * F.col("weight")
    )
    # The first source that does not fill up fixes the rate for all.
    common = F.coalesce(F.min_by("rate", F.when(F.col("fits"), F.col("source_size") / F.col("weight"))).over(everything), F.lit(0.0))
    target = F.least(F.col("source_size") * float(epochs), common * F.col("weight"))
    return rates.select("__source", "source_size", "schedule", target.alias("target"))


def mix(
    docs: DataFrame,
    schedules: Sequence[Schedule] = CURRICULUM,
    epochs: int = EPOCHS,
    whole: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, position, and ``uses``.

    ``size`` counts words, null and empty texts have none. A source is gone through in the order
    of a hash of the ids, again and again until its target is reached; ``taken`` adds up the
    words used. The document at the target is cut there, or with ``whole`` used whole if at
    least half of it fits, so that a source misses its target by half a document at most.
    ``uses`` lists the times (0 to 1) at which the document comes up, ``position`` is the first,
    null if it is never used; with ``whole`` a text without words is used once.
    Equal ids are ordered by size; equal rows are counted each on its own. A null source is a
    source. Results do not depend on partitioning. An empty table gives an empty result.
    """
    size = F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long")
    rows = docs.select(
        F.col(f"`{id_column}`").alias("__id"),
        F.col(f"`{source_column}`").cast("string").alias("__source"),
        size.alias("size"),
        F.sha2(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")), 256).alias("__order"),
    )
    rows = stored(rows, "sizes")
    per_source = rows.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    per_source = stored(per_source, "sources")
    plan = joined(targets(per_source.drop("__rows"), schedules, epochs), per_source.select("__source", "__rows"), ["__source"])
    placed = joined(rows, small(stored(plan, "targets")), ["__source"])
    # Order within a source: buckets by the leading digits, then all of the hash within a bucket.
    fraction = F.conv(F.substring("__order", 1, 12), 16, 10).cast("double") / float(16**12)
    bucket = F.floor(fraction * F.ceil(F.col("__rows") / BUCKET_ROWS))
    placed = placed.withColumn("__bucket", bucket)
    sums = placed.groupBy("__source", "__bucket").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__source", "__bucket", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__order", "__id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(inside), F.lit(0))
    ordered = joined(placed.withColumn("__inside", offset), starts, ["__source", "__bucket"])
    first = F.col("__ahead") + F.col("__inside")
    goal = F.round("target").cast("long")

    def used(k: int) -> Column:
        start = first + F.col("source_size") * k
        if not whole:
            return F.greatest(F.lit(0), F.least(F.col("size"), goal - start)).cast("long")
        fits = (start * 2 + F.col("size") <= goal * 2) & (F.col("size") > 0)
        return F.when(fits, F.col("size")).otherwise(F.lit(0)).cast("long")

    def at(k: int) -> Column:
        share = (first + F.col("source_size") * k) / F.col("target")
        times = [s.time(share) for s in schedules]
        return F.coalesce(F.array(*times)[F.col("schedule")], F.lit(0.0))

    uses = [F.when(used(k) > 0, at(k)) for k in range(epochs)]
    if whole:
        uses.append(F.when(F.col("size") == 0, F.lit(0.0)))
    return ordered.select(
        F.col("__id").alias(id_column),
        "size",
        "source_size",
        "target",
        sum(used(k) for k in range(epochs)).alias("taken"),
        F.array_compact(F.array(*uses)).alias("uses"),
    ).withColumn("position", F.get("uses", F.lit(0)))


def in_order(mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of a mix sorted by position over all partitions; unused documents come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), id_column)


def sequence(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents as training meets them: each row of ``docs`` as often as the mix uses it whole, range-sorted by time.

    Rows that repeat an id are matched to the mix by id, and each of them is used as the first is.
    """
    mixed = mix(docs, whole=True, id_column=id_column, **options)
    uses = mixed.groupBy(id_column).agg(F.max("uses").alias("__uses"))
    matched = joined(docs, small(stored(uses.filter(F.size("__uses") > 0), "uses")), [id_column])
    drawn = matched.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode("__uses").alias("__at"))
    return drawn.orderBy("__at", F.xxhash64(id_column)).drop("__at")
