"""The first n rows by a text column, for any n and any text length, without gathering them.

Radix narrowing on the text's UTF-8 bytes (Spark orders texts by their bytes): keep a prefix P
and the rank still wanted inside the rows that start with P. Each round

1. extends P by the common prefix of the bucket, from the least and greatest of the bucket's next
   WINDOW bytes (the common prefix of all texts is that of these two), window after window;
2. counts the bucket's rows by the next byte after P (at most 257 counts: 256 bytes and "ends
   here"), and walks them in order to the one that holds the wanted rank;
3. keeps the rows of the earlier buckets as "before" and goes on inside that bucket.

It stops once the rank falls among texts equal to P, which are tied: their order comes from the
tie-break columns (the same procedure on the next column) and finally from a hash of the row.
With FEW_ROWS above 0 it also stops at a bucket of at most that many rows, which one task sorts.
The result is a filter on the table, ``before`` (one byte comparison with P) plus the chosen
rows; no key is ever split into columns, so a text of any length costs one comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import col

# A bucket of at most this many rows is sorted by one task; 0: narrow on, no task gathers rows.
FEW_ROWS = 0
# Bytes of the least and greatest text read per look at a bucket's common prefix.
WINDOW = 4_096


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    return i


def text_top(
    df: DataFrame,
    column: str,
    ascending: bool,
    n: int,
    ties: Callable[[DataFrame, int], DataFrame],
    sort_few: Callable[[DataFrame, int], DataFrame],
) -> DataFrame:
    """The first n rows of ``df`` by the text ``column`` (missing values last).

    ``ties(rows, m)`` gives the first m of rows that are equal in ``column`` (by the tie-breaks),
    ``sort_few(rows, m)`` the first m of a few rows in the full order.
    """
    c = col(column)
    raw = c.cast("binary")
    present = df.filter(c.isNotNull())
    have = present.count()
    if have <= n:
        return present.unionByName(ties(df.filter(c.isNull()), n - have))
    prefix, need, size = b"", n, have
    bucket = present
    while True:
        if size <= FEW_ROWS and FEW_ROWS > 0:
            chosen, tied = sort_few(bucket, need), False
            break
        # 1. The common prefix of the bucket.
        equal = False
        while True:
            # Least and greatest of the next WINDOW bytes only (cutting texts keeps their order), so
            # each task hands on two short windows, never whole texts.
            window = F.substring(raw, len(prefix) + 1, WINDOW)
            low, high, longest = bucket.agg(F.min(window), F.max(window), F.max(F.octet_length(raw))).first()
            low, high = bytes(low or b""), bytes(high or b"")
            common = _common(low, high)
            prefix += low[:common]
            if longest == len(prefix):
                equal = True
                break
            if common < WINDOW or len(low) < WINDOW:
                break
        if equal:
            chosen, tied = ties(bucket, need), True
            break
        bucket = present.filter(F.substring(raw, 1, len(prefix)) == F.lit(bytearray(prefix))) if prefix else present
        # 2. Counts by the next byte; an empty next byte means the text ends with the prefix.
        nxt = F.substring(raw, len(prefix) + 1, 1)
        counts = {bytes(k or b""): v for k, v in bucket.groupBy(nxt.alias("k")).count().collect()}
        order = sorted(counts, reverse=not ascending)
        # 3. The bucket that holds the rank.
        for key in order:
            if need <= counts[key]:
                break
            need -= counts[key]
        if key == b"":
            chosen, tied = ties(bucket.filter(F.octet_length(raw) == len(prefix)), need), True
            break
        prefix += key
        size = counts[key]
        bucket = present.filter(F.substring(raw, 1, len(prefix)) == F.lit(bytearray(prefix)))
    edge = F.lit(bytearray(prefix))
    if ascending:
        before = raw < edge
    elif tied:
        before = raw > edge
    else:
        before = (raw > edge) & (F.substring(raw, 1, len(prefix)) != edge)
    return present.filter(before).unionByName(chosen)


def by_hash(df: DataFrame, m: int) -> DataFrame:
    """m of rows that are tied on every key: the copies of one row are interchangeable, so any m
    rows with the smallest hashes of all their columns do; found by the exact cut of ``first_part``."""
    from .parts import REST, first_part, hashable

    if m <= 0:
        return df.limit(0)
    keyed = df.withColumn(REST, F.xxhash64(*[col(x) for x in hashable(df)]))
    return first_part(keyed, [REST], m).drop(REST)
