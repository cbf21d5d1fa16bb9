"""Words and word shingles, on the JVM as columns and in tasks as numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubline.session import stage_table

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SHINGLE = 5
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to 1,000 rows and 8 MB: whole texts are larger than usual cells.

    Smaller settings of the caller stay.
    """
    name = "spark.sql.execution.arrow.max"
    if not 0 < int(spark.conf.get(f"{name}RecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set(f"{name}RecordsPerBatch", str(BATCH_ROWS))
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"{name}BytesPerBatch"))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(f"{name}BytesPerBatch", str(BATCH_BYTES))


def words(text: Column) -> Column:
    """Runs of non-blank characters; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def shingles(w: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of ``n`` words, repeats included; a shorter text is one shingle.

    ``w`` must be a column of the frame: an expression would be evaluated again for every run.
    """
    gram = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])
    return (
        F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), gram))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def stage_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``place``, its position from 1 in the given order.

    Rows are dealt out by ranges of the order, one count for each range reaches the driver.
    """
    ranges = stage_table(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    starts, total = [], 0
    for r in sorted(ranges.groupBy("range").count().collect()):
        starts.append((r["range"], total))
        total += r["count"]
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    offsets = df.sparkSession.createDataFrame(starts, "range int, start long")
    placed = ranges.withColumn("within", within).join(F.broadcast(offsets), "range")
    return placed.withColumn("place", (F.col("start") + F.col("within")).cast("long")).drop("range", "start", "within")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(ids: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of ``rows`` signature places: (documents, places) to (documents, bands)."""
    bands = ids.shape[1] // rows
    parts = ids[:, : bands * rows].reshape(len(ids), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a fixed number of words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def run_hashes(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive hashes; a shorter sequence is one run."""
    n = min(n, len(hashes))
    if n == 0:
        return hashes
    count = len(hashes) - n + 1
    out = np.full(count, np.uint64(n))
    for k in range(n):
        out = mix(out ^ hashes[k : k + count])
    return out
