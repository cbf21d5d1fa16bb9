"""Numeric coercion shared by cleaning, profiling and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a finite decimal or scientific literal (no "inf", "nan", "1d", "0x1").
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_double(c: Column, strip_currency: bool = False) -> Column:
    """String to double; anything that is not a number becomes NULL."""
    text = F.translate(c, "$,", "") if strip_currency else c
    text = F.regexp_replace(text, r"\s", "") if strip_currency else F.btrim(text)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def is_numeric_type(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def numeric(df: DataFrame, column: str, strip_currency: bool = False) -> Column:
    """The column as double, reading text only if the column is not numeric yet.

    NaN counts as missing.
    """
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if is_numeric_type(kind):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    return to_double(c.cast("string"), strip_currency)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric_type(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
