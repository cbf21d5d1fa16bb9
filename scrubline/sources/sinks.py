"""Writers and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.operators.steps import col


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header; nested cells as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = [
        F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name)
        for f in df.schema
    ]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def preview(before: DataFrame, after: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows before and after, side by side: (row_id, column_name, before, after)."""
    first = before.orderBy(row_id).limit(n)
    b, a = _cells(first, row_id, "before"), _cells(after.join(F.broadcast(first.select(row_id)), row_id, "left_semi"), row_id, "after")
    return b.join(a, [row_id, "column_name"], "full").orderBy(row_id, "column_name")


def changed_cells(before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    """(row_id, column_name, before, after) of every cell that differs; rows in both tables."""
    shared = [c for c in before.columns if c in after.columns and c != row_id]
    old = before.select(row_id, F.struct(*[col(c).cast("string").alias(c) for c in shared]).alias("__old"))
    new = after.select(row_id, F.struct(*[col(c).cast("string").alias(c) for c in shared]).alias("__new"))
    both = old.join(new, row_id)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("__old")[c].alias("before"), F.col("__new")[c].alias("after")) for c in shared])
    differ = F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))
    return both.select(row_id, F.explode(differ).alias("c")).select(row_id, "c.*")


def _cells(df: DataFrame, row_id: str, label: str) -> DataFrame:
    names = [c for c in df.columns if c != row_id]
    text = df.select(row_id, *[col(c).cast("string").alias(c) for c in names])
    return text.unpivot([row_id], [col(c) for c in names], "column_name", label)
