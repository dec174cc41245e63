"""One notion of "missing": SQL null, and NaN in floating-point columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import data_type, is_floating

# The field texts that a CSV reader treats as missing.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def col(name: str) -> Column:
    """A top-level column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null; other types are left bare so that pushdown works."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_floating(data_type(df, name)) else c


def is_present(df: DataFrame, name: str) -> Column:
    """Row test "not missing"; its ``IS NOT NULL`` half reaches the Parquet scan."""
    c = col(name)
    test = c.isNotNull()
    return test & ~F.isnan(c) if is_floating(data_type(df, name)) else test


def number(df: DataFrame, name: str) -> Column:
    """A numeric column ready for arithmetic: NaN is null, booleans are 0/1."""
    if isinstance(data_type(df, name), T.BooleanType):
        return col(name).cast("int")
    return present(df, name)


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn the NA tokens of string columns and the NaNs of float columns into null."""

    def clean(field: T.StructField) -> Column:
        c = col(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.when(~c.isin(*NA_TOKENS), c).alias(field.name)
        return present(df, field.name).alias(field.name)

    return df.select(*[clean(f) for f in df.schema.fields])


def drop_missing(df: DataFrame, name: str) -> DataFrame:
    """Keep the rows whose ``name`` is not missing."""
    return df.filter(is_present(df, name))
