"""The position of a row in its source files, as an explicit ordering key."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File path, then place within the file: (row, 0) for Parquet, (block start, row) for text.
POSITION_COLUMNS = ("file_path", "file_block", "row_in_block")
# Each further look at the leading files takes this many times more of them.
_GROWTH = 8


def position_of(df: DataFrame) -> list[Column] | None:
    """Columns that order the rows of a file-backed table as its files do; None for other tables."""
    metadata = _metadata_fields(df)
    if not metadata:
        return None
    path = F.col("_metadata.file_path")
    if "row_index" in metadata:
        return [path, F.col("_metadata.row_index"), F.lit(0).cast("long")]
    return [path, F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def has_row_index(df: DataFrame) -> bool:
    """Whether rows are numbered within their file (Parquet), not just within a task."""
    return "row_index" in _metadata_fields(df)


def _metadata_fields(df: DataFrame) -> list[str]:
    if not _plain_read(df) or not df.inputFiles():
        return []
    try:
        return df.select("_metadata").schema[0].dataType.names
    except AnalysisException:  # a join of tables, or an aggregate
        return []


# Nodes of a plan that read, filter and project only.
_PLAIN_NODES = frozenset({"Project", "Filter", "LogicalRelation", "SubqueryAlias", "View"})


def _plain_read(df: DataFrame) -> bool:
    """Whether the table is read, filtered and projected only; a sort or an aggregate makes an order of its own.

    Walks the nodes of the analyzed plan; any node of another kind (also a scan of another
    kind of source) means the file order is not the table's order.
    """
    pending = [df._jdf.queryExecution().analyzed()]
    while pending:
        node = pending.pop()
        if node.nodeName() not in _PLAIN_NODES:
            return False
        children = node.children()
        pending += [children.apply(i) for i in range(children.size())]
    return True


def with_position(df: DataFrame) -> DataFrame:
    """Add the POSITION_COLUMNS; sorting by them restores file order."""
    position = position_of(df)
    if position is None:
        raise ValueError("the table does not come straight from files")
    return df.select("*", *[p.alias(c) for p, c in zip(position, POSITION_COLUMNS)])


def leading_files(df: DataFrame, n: int) -> DataFrame:
    """Restrict ``df`` to its first files, as many as needed for n rows.

    Files are tried in growing batches, so a small limit on a large table opens few of them.
    Spark prunes the other files before the scan, because the path is file metadata.
    """
    # The listing and the metadata column write local paths with three slashes and with one.
    files = sorted(re.sub("^file:/+", "file:/", path) for path in df.inputFiles())
    size = 1
    while size < len(files):
        head = df.filter(F.col("_metadata.file_path") <= F.lit(files[size - 1]))
        if head.limit(n).count() >= n:
            return head
        size *= _GROWTH
    return df
