"""The missing-value rule: NULL, or a trimmed value that stands for "no value"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.text import strip

# The default case-sensitive markers of a missing value.
MISSING_MARKERS = (
    "N/A", "NA", "n/a", "na", "null", "NULL", "Null",
    "none", "None", "NONE", "", "-", ".", "999", "-999",
)

# Markers (lower-cased) that should not survive cleaning.
RESIDUAL_MARKERS = ("n/a", "null", "none", "nan", "na")


def is_missing(c: Column, markers: Sequence[str] | None = None) -> Column:
    """True for NULL and for markers; never NULL itself."""
    chosen = MISSING_MARKERS if markers is None else markers
    return F.coalesce(strip(c).isin(*chosen), F.lit(True)) if chosen else c.isNull()


def nullify(c: Column, markers: Sequence[str] | None = None) -> Column:
    """Trimmed value, or NULL where the value is missing."""
    return F.when(~is_missing(c, markers), strip(c))


def is_missing_cell(df: DataFrame, column: str) -> Column:
    """The same rule for a column of any type, without turning numbers into text.

    As text, an integer can equal only the numeric markers and other typed values none.
    """
    kind = df.schema[column].dataType
    c = F.col("`" + column.replace("`", "``") + "`")
    if isinstance(kind, T.StringType):
        return is_missing(c)
    if isinstance(kind, T.IntegralType):
        return c.isNull() | c.isin(999, -999)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return c.isNull() | c.isin(999, -999)
    return c.isNull()
