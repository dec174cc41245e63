"""CSV source: header names, missing-value tokens and column types, all inferred."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import col, normalise_missing

# The shapes of integer, decimal and infinite number texts, and of booleans.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITY = r"(?i)^[+-]?inf(inity)?$"
BOOLEANS = ("true", "false")

# What a text looks like; the shapes seen in a column are combined as bits.
INT64, NEGATIVE, UINT64, HUGE, REAL, BOOLEAN, TEXT = (1 << i for i in range(7))

_EXTRA = "_extra_field"
# Most columns that a record may have unless the caller says otherwise.
MAX_COLUMNS = 100_000
_UINT64 = T.DecimalType(20, 0)
_UINT64_MAX = Decimal(2**64 - 1)


def read_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """Read comma-separated text with a header row into a typed table.

    Types are inferred from every row (see ``infer_types``). A row with more fields than the
    header is an error, whatever the surplus fields hold; a shorter one is padded with missing
    values. The files of a folder must agree on their header. Blank lines are skipped.
    ``multi_line`` allows line breaks inside quotes, but then a file cannot be split. More than
    ``max_columns`` columns are an error.
    """
    text = read_csv_text(spark, path, multi_line, max_columns)
    return infer_types(normalise_missing(text), reject=_EXTRA)


def read_csv_text(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """The fields as text, with one additional column: the whole record where it exceeds the header."""
    options = {"quote": '"', "escape": '"', "multiLine": multi_line, "encoding": "UTF-8", "maxColumns": max_columns}
    records = spark.read.options(header=False, **options).csv(path)
    first = records.limit(1).collect()
    if not first:
        raise ValueError(f"no header row in {path}")
    names = header_names(first[0])
    renamed = names != list(first[0])
    if renamed:
        _require_same_header(spark, path, records)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])
    # The reader puts records of another length aside; it compares headers unless names were changed.
    reader = spark.read.schema(schema).options(
        header=True, enforceSchema=renamed, mode="PERMISSIVE", columnNameOfCorruptRecord=_EXTRA, **options
    )
    table = reader.csv(path)
    return table.select(*[col(n) for n in names], F.when(_fields(col(_EXTRA)) > len(names), col(_EXTRA)).alias(_EXTRA))


def _fields(record: Column) -> Column:
    """Number of fields of a raw record: separators outside quotes, and one."""
    bare = F.regexp_replace(record, '"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _require_same_header(spark: SparkSession, path: str | list[str], records: DataFrame) -> None:
    """Headers with empty or repeated names are compared as lines of text, the first of each file."""
    if len(records.inputFiles()) < 2:
        return
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    place = F.struct(F.col("block"), F.monotonically_increasing_id())
    headers = placed.groupBy("file").agg(F.min_by("value", place).alias("header")).select("header").distinct()
    if len(headers.limit(2).collect()) > 1:
        raise ValueError(f"the files of {path} have different headers")


def header_names(fields: Row | list[str | None]) -> list[str]:
    """Name empty header fields by position and number repeated names (a, a.1, a.2, ...)."""
    given = [f if f else f"Unnamed: {i}" for i, f in enumerate(fields)]
    used: set[str] = set()
    names = []
    for name in given:
        unique, suffix = name, 0
        while unique in used or (suffix and unique in given):
            suffix += 1
            unique = f"{name}.{suffix}"
        used.add(unique)
        names.append(unique)
    return names


def infer_types(df: DataFrame, reject: str | None = None) -> DataFrame:
    """Give string columns the first type that fits all their present values.

    Tried in turn: integer, float, boolean; anything else stays text, dates included. An
    integer column with missing values becomes double, and so does a column without values.
    One pass over the table decides for all columns together. ``reject`` names a column that
    must be empty everywhere and is then dropped.
    """
    texts = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != reject
    ]
    evidence = [
        F.struct(F.count(col(name)).alias("values"), F.bit_or(_shape(name)).alias("shapes")).alias(f"c{i}")
        for i, name in enumerate(texts)
    ]
    if reject is not None:
        evidence.append(F.count(col(reject)).alias("surplus"))
    if not evidence:
        return df
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *evidence).first()
    if reject is not None and seen["surplus"]:
        raise ValueError(f"{seen['surplus']} row(s) have more fields than the header")
    chosen = {name: _choose(seen[f"c{i}"]["shapes"], seen[f"c{i}"]["values"] < seen["rows"]) for i, name in enumerate(texts)}
    return df.select(
        *[
            _converted(f.name, chosen[f.name]).alias(f.name) if f.name in chosen else col(f.name)
            for f in df.schema.fields
            if f.name != reject
        ]
    )


def _shape(name: str) -> Column:
    """What one text looks like, as a bit; null for a missing value."""
    c = col(name)
    as_long = c.try_cast("long")
    unsigned = F.trim(c).try_cast(T.DecimalType(38, 0)).between(F.lit(0), F.lit(_UINT64_MAX))
    integer = (
        F.when(as_long >= 0, F.lit(INT64))
        .when(as_long < 0, F.lit(NEGATIVE))
        .when(unsigned, F.lit(UINT64))
        .otherwise(F.lit(HUGE))
    )
    finite = F.abs(c.try_cast("double")) != F.lit(float("inf"))
    return (
        F.when(c.rlike(INTEGER), integer)
        .when(c.rlike(FLOAT) & finite, F.lit(REAL))
        .when(c.rlike(INFINITY), F.lit(REAL))
        .when(F.lower(c).isin(*BOOLEANS), F.lit(BOOLEAN))
        .when(c.isNotNull(), F.lit(TEXT))
    )


def _choose(shapes: int | None, has_missing: bool) -> T.DataType:
    """The type for a column showing these shapes."""
    if shapes is None:
        return T.DoubleType()
    if shapes == BOOLEAN:
        return T.BooleanType()
    if shapes & (BOOLEAN | TEXT):
        return T.StringType()
    if shapes & REAL:
        return T.DoubleType()
    if shapes & (UINT64 | HUGE):
        return T.StringType() if has_missing or shapes & (NEGATIVE | HUGE) else _UINT64
    return T.DoubleType() if has_missing else T.LongType()


def _converted(name: str, to: T.DataType) -> Column:
    c = col(name)
    if isinstance(to, T.StringType):
        return c
    if isinstance(to, T.BooleanType):
        return F.lower(c) == F.lit("true")
    if isinstance(to, T.DoubleType):
        # Spark knows "Infinity" and "inf" in a few spellings only.
        spelled = F.when(c.rlike(INFINITY), F.when(c.startswith("-"), F.lit("-Infinity")).otherwise("Infinity"))
        return F.coalesce(spelled, c).try_cast(to)
    return F.trim(c).try_cast(to)
