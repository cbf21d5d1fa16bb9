"""Exact duplicates: removal and grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.operators.lookup import ValueTable
from scrubline.operators.steps import Step, col, row_key


class RemoveDuplicates(Step):
    """Keep the first, the last or none of the rows that agree on ``subset``.

    ``order_by`` defines first and last; it is required for them unless every column is
    compared, where the copies are interchangeable. Every form is one hash or sort
    aggregate with map-side combine, so a hot group shrinks to one row per task before
    the shuffle. NULLs compare equal.
    """

    def __init__(self, keep="first", subset: Sequence[str] | None = None, order_by=None):
        if keep in ("none", "None", "False", None):
            keep = False
        if keep not in ("first", "last", False):
            raise ValueError(f"keep must be first, last or False, not {keep!r}")
        self.column = None
        self.keep = keep
        self.subset = list(subset) if subset else None
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by or [])

    def check(self, df):
        absent = [c for c in (self.subset or []) + self.order_by if c not in df.columns]
        if absent:
            raise ValueError(f"columns {absent} not found")

    def apply(self, df: DataFrame, stats) -> DataFrame:
        order = self.order_by
        keys = self.subset or [c for c in df.columns if c not in order]
        rest = [c for c in df.columns if c not in keys]
        grouped = df.groupBy(*[col(c) for c in keys])
        if not rest:
            if self.keep:
                return df.distinct()
            return grouped.agg(F.count("*").alias("__n")).where("__n = 1").select(*map(col, df.columns))
        if self.keep is False:
            row = F.struct(*[col(c) for c in rest])
            only = grouped.agg(F.count("*").alias("__n"), F.any_value(row).alias("__row"))
            only = only.where("__n = 1")
            return only.select(*[col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])
        if not order:
            raise ValueError("keep first/last of a subset needs order_by")
        # the order columns lead, so the smallest (largest) struct is the first (last) row
        lead = [c for c in order if c in rest] + [c for c in rest if c not in order]
        if all(c in keys for c in order):
            raise ValueError("order_by must not be part of subset")
        pick = F.min if self.keep == "first" else F.max
        best = grouped.agg(pick(F.struct(*[col(c) for c in lead])).alias("__row"))
        return best.select(*[col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def remove_exact_duplicates(df, keep="first", subset=None, order_by=None) -> DataFrame:
    return RemoveDuplicates(keep, subset, order_by).run(df)


def exact_duplicate_groups(df: DataFrame, row_id: str, subset: Sequence[str] | None = None) -> DataFrame:
    """Every row that has an exact copy: ``(group_id, row_id, n)``.

    One output row per member, not one list per group, so a hot group never has to fit
    in one cell. ``group_id`` is the smallest row id of the group.
    """
    keys = list(subset) if subset else [c for c in df.columns if c != row_id]
    rows = df.select(col(row_id).alias("row_id"), row_key(df, keys).alias("__body"))
    groups = rows.groupBy("__body").agg(F.min("row_id").alias("group_id"), F.count("*").alias("n"))
    table = ValueTable(groups.where("n > 1"), "__body")
    matched = table.attach(rows, "__body")
    return matched.where("n is not null").select("group_id", "row_id", "n")


def duplicate_count(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """One row: rows in duplicate groups, and rows beyond the first of each group."""
    keys = [c for c in df.columns if c not in ignore]
    sizes = df.groupBy(row_key(df, keys).alias("key")).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
    )
