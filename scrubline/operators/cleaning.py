"""Cell-level cleaning steps: text, types, dates, missing values, outliers, categories."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions import dates, missing, numbers, text
from scrubline.operators.steps import Needs, Step, col


def as_text(df: DataFrame, column: str) -> Column:
    return col(column).cast("string")


class CellStep(Step):
    """A step that rewrites one column by an expression over that column."""

    def __init__(self, column: str):
        self.column = column

    def cell(self, df: DataFrame, stats: dict[str, Any]) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame, stats: dict[str, Any]) -> DataFrame:
        return df.withColumn(self.column, self.cell(df, stats))


class TrimWhitespace(CellStep):
    def cell(self, df, stats):
        return text.strip(as_text(df, self.column))


class NormalizeCase(CellStep):
    def __init__(self, column: str, case: str = "lower"):
        super().__init__(column)
        self.case = case

    def cell(self, df, stats):
        return text.change_case(as_text(df, self.column), self.case)


class FixEncoding(CellStep):
    def cell(self, df, stats):
        return text.repair_mojibake(as_text(df, self.column))


class ConvertType(CellStep):
    """To ``float``/``numeric``, ``int``, ``str`` or ``bool``; bad cells become NULL."""

    TARGETS = ("float", "numeric", "int", "str", "bool")

    def __init__(self, column: str, target_type: str, remove_chars: list[str] | None = None):
        super().__init__(column)
        self.target_type = target_type
        self.remove_chars = remove_chars

    def cell(self, df, stats):
        if self.target_type not in self.TARGETS:
            return col(self.column)
        c = text.remove_characters(text.strip(as_text(df, self.column)), self.remove_chars)
        if self.target_type == "str":
            return c
        if self.target_type == "bool":
            word = F.lower(c)
            return F.when(word.isin("true", "yes", "1", "t", "y"), True).when(
                word.isin("false", "no", "0", "f", "n"), False
            )
        x = (
            numbers.numeric(df, self.column)
            if numbers.is_numeric_type(df.schema[self.column].dataType)
            else numbers.to_double(c, strip_currency=True)
        )
        return F.bround(x, 0).try_cast("bigint") if self.target_type == "int" else x


class ParseDates(CellStep):
    """Mixed date text to one format; unparsable cells become NULL."""

    def __init__(self, column: str, target_format: str = "%Y-%m-%d"):
        super().__init__(column)
        self.target_format = target_format

    def cell(self, df, stats):
        return dates.reformat_date(as_text(df, self.column), self.target_format)


class StandardizeMissing(CellStep):
    """Markers of missing values to NULL; other cells are trimmed."""

    def __init__(self, column: str, missing_indicators: list[str] | None = None):
        super().__init__(column)
        self.missing_indicators = missing_indicators

    def cell(self, df, stats):
        return missing.nullify(as_text(df, self.column), self.missing_indicators)


def _present(df: DataFrame, column: str) -> Column:
    """The cell, or NULL if missing; numeric columns keep their type."""
    if numbers.is_numeric_type(df.schema[column].dataType):
        return F.when(~missing.is_missing_cell(df, column), col(column))
    return missing.nullify(as_text(df, column))


def _present_number(df: DataFrame, column: str) -> Column:
    if numbers.is_numeric_type(df.schema[column].dataType):
        return F.when(~missing.is_missing_cell(df, column), numbers.numeric(df, column))
    return numbers.to_double(missing.nullify(as_text(df, column)), strip_currency=True)


class FillNumber(CellStep):
    """Missing cells to the mean or median of the numeric cells; the column becomes double.

    Text that is neither missing nor a number has no place in such a column: ``text_cells="refuse"``
    raises and leaves the column alone, ``"fill"`` fills it like a missing cell.
    """

    def __init__(self, column: str, statistic: str, text_cells: str = "refuse"):
        super().__init__(column)
        if text_cells not in ("refuse", "fill"):
            raise ValueError(f"unknown text_cells {text_cells!r}")
        self.statistic, self.text_cells = statistic, text_cells

    def needs(self, df):
        x = _present_number(df, self.column)
        text_cells = F.count_if(_present(df, self.column).isNotNull() & x.isNull())
        if self.statistic == "mean":
            return Needs(aggregates={"fill": F.avg(x), "text": text_cells})
        return Needs(aggregates={"text": text_cells}, quantiles={"fill": (x, [0.5])})

    def learn(self, df, stats):
        if stats["text"] and self.text_cells == "refuse":
            raise ValueError(f"{stats['text']} cells of '{self.column}' are text; convert the column or fill with text_cells='fill'")
        return stats

    def cell(self, df, stats):
        fill = stats["fill"][0] if self.statistic == "median" else stats["fill"]
        return F.coalesce(_present_number(df, self.column), F.lit(fill).cast("double"))


class FillMode(CellStep):
    """Missing cells to the most frequent value; ties go to the smallest."""

    def learn(self, df, stats):
        value = _present(df, self.column)
        counts = df.select(value.alias("v")).where("v is not null").groupBy("v").count()
        top = counts.orderBy(F.desc("count"), "v").limit(1).collect()
        return {"fill": top[0]["v"] if top else None}

    def cell(self, df, stats):
        value = _present(df, self.column)
        return F.coalesce(value, F.lit(stats["fill"])) if stats["fill"] is not None else value


class FillConstant(CellStep):
    def __init__(self, column: str, value: Any):
        super().__init__(column)
        self.value = value

    def cell(self, df, stats):
        cell = _present(df, self.column)
        if self.value is None:
            return cell
        fits = isinstance(self.value, (int, float)) and numbers.is_numeric_type(
            df.schema[self.column].dataType
        )
        if fits:
            return F.coalesce(cell, F.lit(self.value))
        return F.coalesce(cell.cast("string"), F.lit(str(self.value)))


class DropMissing(CellStep):
    """Drop rows whose cell is missing."""

    def apply(self, df, stats):
        return df.withColumn(self.column, _present(df, self.column)).where(
            col(self.column).isNotNull()
        )


class HandleOutliers(CellStep):
    """Values outside ``[Q1 - k*IQR, Q3 + k*IQR]``: ``cap``, ``remove`` or ``flag``."""

    def __init__(self, column: str, action: str = "cap", multiplier: float = 1.5):
        super().__init__(column)
        self.action = action
        self.multiplier = float(multiplier)

    def needs(self, df):
        return Needs(quantiles={"q": (numbers.numeric(df, self.column), [0.25, 0.75])})

    def learn(self, df, stats):
        q1, q3 = stats["q"]
        if q1 is None:
            return {"lower": None, "upper": None, "any": False}
        spread = self.multiplier * (q3 - q1)
        known = {"lower": q1 - spread, "upper": q3 + spread}
        # capping a column without outliers must leave even its text untouched
        if self.action == "cap" and not numbers.is_numeric_type(df.schema[self.column].dataType):
            known["any"] = bool(df.where(self.outside(df, known)).limit(1).count())
        else:
            known["any"] = True
        return known

    def outside(self, df: DataFrame, stats: dict[str, Any]) -> Column:
        x = numbers.numeric(df, self.column)
        return F.coalesce((x < stats["lower"]) | (x > stats["upper"]), F.lit(False))

    def apply(self, df, stats):
        if not stats["any"]:
            return df
        out = self.outside(df, stats)
        if self.action == "remove":
            return df.where(~out)
        if self.action == "flag":
            return df.withColumn(self.column, F.when(~out, col(self.column)))
        if self.action == "cap":
            x = numbers.numeric(df, self.column)
            low, high = F.lit(stats["lower"]), F.lit(stats["upper"])
            capped = F.when(x < low, low).when(x > high, high).otherwise(x)
            return df.withColumn(self.column, capped)
        return df


class MapCategories(CellStep):
    """Whole-value replacement by an explicit mapping, after trimming."""

    def __init__(self, column: str, mapping: dict[str, str]):
        super().__init__(column)
        self.mapping = mapping

    def apply(self, df, stats):
        trimmed = df.withColumn(self.column, text.strip(as_text(df, self.column)))
        return map_values(trimmed, self.column, self.mapping)


# up to this many pairs, a lookup is a CASE expression; beyond, a broadcast join with the same answer
INLINE_PAIRS = 64


def look_up(df: DataFrame, column: str, pairs: dict[str, Any], kind: str, other: Column) -> DataFrame:
    """``column`` replaced by what ``pairs`` say, else by ``other``; a value of None gives NULL.

    The pairs come from a plan, so they are as small as its JSON text.
    """
    if not pairs:
        return df.withColumn(column, other)
    c = col(column)
    if len(pairs) <= INLINE_PAIRS:
        chosen = None
        for raw, value in pairs.items():
            value = F.lit(value).cast(kind)
            chosen = F.when(c == F.lit(raw), value) if chosen is None else chosen.when(c == F.lit(raw), value)
        return df.withColumn(column, chosen.otherwise(other))
    rows = df.sparkSession.createDataFrame([(k, v, True) for k, v in pairs.items()], f"__raw string, __value {kind}, __hit boolean")
    joined = df.join(F.broadcast(rows), c == F.col("__raw"), "left")
    return joined.withColumn(column, F.when(F.col("__hit"), F.col("__value")).otherwise(other)).select(*[col(x) for x in df.columns])


def map_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace values by a driver-side mapping, keeping unmapped values."""
    pairs = {str(k): None if v is None else str(v) for k, v in mapping.items()}
    return look_up(df, column, pairs, "string", col(column)) if pairs else df


class RenameColumn(Step):
    def __init__(self, column: str, new_name: str):
        self.column = column
        self.new_name = new_name

    def check(self, df):
        pass

    def apply(self, df, stats):
        return df.withColumnRenamed(self.column, self.new_name)


class DropColumn(Step):
    def __init__(self, column: str):
        self.column = column

    def check(self, df):
        pass

    def apply(self, df, stats):
        return df.drop(self.column)


def fill_step(column: str, strategy: str = "mode", value: Any = None, order_by=None, partition_by=(), text_cells: str = "refuse"):
    """The imputation step of a strategy name."""
    from scrubline.operators.fill import FillDirection

    if strategy in ("mean", "median"):
        return FillNumber(column, strategy, text_cells)
    if strategy == "mode":
        return FillMode(column)
    if strategy in ("custom", "constant"):
        return FillConstant(column, value)
    if strategy == "drop":
        return DropMissing(column)
    if strategy in ("ffill", "bfill"):
        return FillDirection(column, strategy, order_by, partition_by)
    # an unknown strategy only standardises the markers
    return StandardizeMissing(column)
