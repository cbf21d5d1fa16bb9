"""Joining rows to a per-value table, whatever its size and however skewed the values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.session import stage_table

# a per-value table up to this many rows travels to every executor
SMALL_TABLE_ROWS = 20_000
SMALL_TABLE_CHARS = 8_000_000
# a value with at least 1/HOT_SHARE of all rows is spread over SALTS tasks
HOT_SHARE = 100
SALTS = 32


class ValueTable:
    """A (key, ..., n) table with one row per distinct value and its row count ``n``.

    Small tables (checked by rows and characters) are gathered once and broadcast.
    Others are staged in the shared folder and joined by shuffle; values that hold a
    large share of the rows are salted. At most ``HOT_SHARE`` values can be hot.
    """

    def __init__(self, table: DataFrame, key: str):
        spark = table.sparkSession
        self.key = key
        head = table.limit(SMALL_TABLE_ROWS + 1).toArrow()
        if head.num_rows <= SMALL_TABLE_ROWS and head.nbytes <= SMALL_TABLE_CHARS:
            self.rows = spark.createDataFrame(head, schema=table.schema)
            self.small = True
            self.hot: list = []
        else:
            self.rows = stage_table(table, "values")
            self.small = False
            total = self.rows.agg(F.sum("n")).first()[0]
            heavy = self.rows.where((F.col("n") * HOT_SHARE >= total) & F.col(key).isNotNull())
            self.hot = [r[0] for r in heavy.select(key).collect()]

    def attach(self, df: DataFrame, column: str) -> DataFrame:
        """Left join on ``df[column] = key``; adds the table's other columns."""
        from scrubline.operators.steps import col

        payload = [c for c in self.rows.columns if c != self.key]
        right = self.rows.withColumnRenamed(self.key, "__key")
        if self.small:
            return df.join(F.broadcast(right), col(column) == F.col("__key"), "left").drop("__key")
        # the partition number is stable under retries and spreads copies of one row
        spread = F.pmod(F.spark_partition_id(), F.lit(SALTS))
        left = df.withColumn(
            "__salt",
            F.when(col(column).isNull() | col(column).isin(*self.hot), spread).otherwise(F.lit(0)),
        )
        salts = F.when(F.col("__key").isin(*self.hot), F.sequence(F.lit(0), F.lit(SALTS - 1)))
        right = right.withColumn("__rsalt", F.explode(F.coalesce(salts, F.array(F.lit(0)))))
        on = (col(column) == F.col("__key")) & (F.col("__salt") == F.col("__rsalt"))
        return left.join(right, on, "left").select(*[col(c) for c in df.columns], *payload)


def dense_index(distinct: DataFrame, key: str) -> DataFrame:
    """Add ``idx`` = position of each distinct key in sorted order, from 0.

    Keys are range-partitioned; only one count per partition reaches the driver.
    """
    spark = distinct.sparkSession
    parts = stage_table(
        distinct.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "sorted"
    )
    sizes = sorted((r[0], r[1]) for r in parts.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets, "__part int, __start long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return (
        parts.withColumn("__at", within)
        .join(F.broadcast(starts), "__part")
        .withColumn("idx", (F.col("__start") + F.col("__at")).cast("long"))
        .drop("__part", "__start", "__at")
    )
