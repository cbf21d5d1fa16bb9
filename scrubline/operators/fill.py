"""Forward and backward fill over a total order.

A window without partitioning would move the whole table into one task, and a window
per partition key would do the same to a hot key. Here the table is cut into ranges of
the order; the value carried into a range is found from one row per range, and the
windows run inside ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.operators.steps import Step, col
from scrubline.session import stage_table


class FillDirection(Step):
    def __init__(
        self,
        column: str,
        strategy: str,
        order_by: str | Sequence[str] | None,
        partition_by: Sequence[str] = (),
    ):
        if not order_by:
            raise ValueError(f"{strategy} needs order_by: rows have no position of their own")
        self.column = column
        self.backward = strategy == "bfill"
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        self.partition_by = [partition_by] if isinstance(partition_by, str) else list(partition_by)

    def apply(self, df: DataFrame, stats) -> DataFrame:
        from scrubline.operators.cleaning import _present

        value = _present(df, self.column)
        ranged = [*self.partition_by, *self.order_by]
        cut = stage_table(
            df.withColumn(self.column, value)
            .repartitionByRange(*[col(c) for c in ranged])
            .withColumn("__range", F.spark_partition_id()),
            "ranges",
        )
        carry = self._carry(cut)
        group = self._group()
        # backward is forward over the reversed order: a frame that grows by one row costs
        # one step per row, a frame that reaches ahead is scanned anew for every row
        turn = F.desc if self.backward else F.asc
        frame = (
            Window.partitionBy("__range", *[col(c) for c in self.partition_by])
            .orderBy(*[turn(col(c)) for c in self.order_by])
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        near = F.last(col(self.column), ignorenulls=True).over(frame)
        filled = cut.withColumn(self.column, near)
        if carry is None:
            return filled.select(*[col(c) for c in df.columns])
        # one row per range
        joined = filled.withColumn("__group", group).join(
            F.broadcast(carry), ["__range", "__group"], "left"
        )
        return joined.withColumn(self.column, F.coalesce(col(self.column), "__carry")).select(
            *[col(c) for c in df.columns]
        )

    def _group(self):
        return F.to_json(F.struct(*[col(c) for c in self.partition_by], F.lit(0).alias("__all")))

    def _carry(self, cut: DataFrame) -> DataFrame | None:
        """(range, group, value) entering each range from the ranges before it."""
        group = self._group()
        order = F.struct(*[col(c) for c in (*self.partition_by, *self.order_by)])
        c = col(self.column)
        keyed = cut.select(
            "__range", group.alias("g"), order.alias("o"), c.alias("v")
        )
        known = F.col("v").isNotNull()
        # facing the direction of travel: the group a range starts in, the group it ends
        # in, and the last known value on the way
        if self.backward:
            start, end, last = F.max_by("g", "o"), F.min_by("g", "o"), F.min_by
        else:
            start, end, last = F.min_by("g", "o"), F.max_by("g", "o"), F.max_by
        edge = F.when(known, F.col("o"))
        rows = (
            keyed.groupBy("__range")
            .agg(
                start.alias("start"),
                end.alias("end"),
                last(F.struct("g", "v"), edge).alias("last"),
            )
            .orderBy(F.desc("__range") if self.backward else "__range")
            .collect()
        )
        carried, state = [], None
        for row in rows:
            if state is not None and state[0] == row["start"]:
                carried.append((row["__range"], row["start"], state[1]))
            if row["last"] is not None and row["last"]["g"] == row["end"]:
                state = (row["end"], row["last"]["v"])
            elif state is not None and state[0] != row["end"]:
                state = None
        if not carried:
            return None
        schema = f"__range int, __group string, __carry {cut.schema[self.column].dataType.simpleString()}"
        return cut.sparkSession.createDataFrame(carried, schema)
