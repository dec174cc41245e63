"""Exact deduplication by progressive refinement: length, then a hash of the opening, then a hash of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import stored
from .shared import joined, lowered, small, text_of, with_group

PREFIX_CHARS = 256
_ROW = ["__id", "__length", "__hash"]


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows as their id, compared text, and its length and 64-bit hash, which tell apart rows of one id."""
    text = lowered(text_of(text_column))
    return docs.select("*", F.col(f"`{id_column}`").alias("__id"), text.alias("__text")).select(
        "*", F.octet_length("__text").alias("__length"), F.xxhash64("__text").alias("__hash")
    )


def copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that share their text with others: row key, keep_id, group_size, and how many rows have the key.

    Each step looks closer at what the step before left over: rows whose length others have,
    rows that also share a hash of the opening, and only of these the hash of the whole text.
    """
    rows = _keyed(docs, id_column, text_column).select("__id", "__text", "__length")
    lengths = rows.groupBy("__length").count().filter("count > 1").select("__length")
    rows = rows.join(small(stored(lengths, "lengths")), "__length", "left_semi")
    rows = rows.withColumn("__opening", F.xxhash64(F.substring("__text", 1, PREFIX_CHARS)))
    openings = rows.groupBy("__length", "__opening").count().filter("count > 1").select("__length", "__opening")
    rows = rows.join(small(stored(openings, "openings")), ["__length", "__opening"], "left_semi")
    full = rows.select(
        "__id", "__length", F.xxhash64("__text").alias("__hash"), F.unhex(F.sha2("__text", 256)).alias("__content")
    )
    counted = with_group(
        stored(full, "full"),
        ["__content"],
        "__id",
        {"keep_id": F.max("__id"), "group_size": F.count(F.lit(1))},
        {"keep_id": F.max("keep_id"), "group_size": F.sum("group_size")},
    )
    one = {"keep_id": F.first("keep_id"), "group_size": F.first("group_size"), "times": F.count(F.lit(1))}
    return counted.filter("group_size > 1").groupBy(*_ROW).agg(*[c.alias(n) for n, c in one.items()])


def deduplicate(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: bool = False
) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size and kept; with ``digest`` also text_sha256.

    Texts are equal when they agree after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest id stays. A null id is smaller than any other; a group of null ids
    only has keep_id null and is kept. Rows that repeat an id and its text count each for
    group_size and share one decision. An empty table gives an empty result; no other column is read.
    """
    keyed = _keyed(docs, id_column, text_column)
    extra = [F.sha2("__text", 256).alias("text_sha256")] if digest else []
    found = copies(docs, id_column, text_column)
    every = joined(keyed.select(*_ROW, *extra), found.withColumn("__found", F.lit(True)), _ROW, "left")
    keep = F.when(F.col("__found"), F.col("keep_id")).otherwise(F.col("__id"))
    return every.select(
        F.col("__id").alias(id_column),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("__id")).alias("kept"),
        *(["text_sha256"] if digest else []),
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, with their columns unchanged; of rows of one id and text, one."""
    found = stored(copies(docs, id_column, text_column), "copies")
    dropped = stored(found.filter(~F.col("keep_id").eqNullSafe(F.col("__id"))).select(*_ROW), "dropped")
    kept = joined(_keyed(docs, id_column, text_column), small(dropped), _ROW, "left_anti")
    repeated = found.filter("times > 1").select(*_ROW)
    if not repeated.isEmpty():
        once = joined(kept, small(repeated), _ROW, "left_anti")
        kept = once.unionByName(joined(kept, small(repeated), _ROW, "left_semi").dropDuplicates(_ROW))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
