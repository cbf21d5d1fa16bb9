"""A column of numbers as some thousand ranges with counts and sums, split further where a search needs it.

One aggregate that combines map-side makes the ranges, another splits some of them; the number of rows or of different
values never matters to the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ranges made by one aggregate
PIECES = 16_384


class Cells:
    """Disjoint ranges ``(low, high, n, total)`` in order; low and high are values of the range.

    ``values`` is a staged frame with one double column ``x`` without NULL or NaN.
    """

    def __init__(self, values: DataFrame, low: float, high: float):
        self.values = values
        self.cells: list[tuple[float, float, int, float]] = [(low, high, 0, 0.0)]
        self.split({0})

    def split(self, wanted: set[int]) -> None:
        """Cut the cells of these numbers into many; neighbours are cut as one range."""
        ranges: list[list[int]] = []
        for i in sorted(wanted):
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
        pieces = max(2, PIECES // len(ranges))
        x, place = F.col("x"), F.lit(None)
        for first, last in reversed(ranges):
            low, high = self.cells[first][0], self.cells[last][1]
            part = F.least(F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * pieces), F.lit(pieces - 1))
            place = F.when((x >= low) & (x <= high), F.struct(F.lit(first).alias("r"), part.alias("p"))).otherwise(place)
        rows = self.values.select("x", place.alias("k")).where("k is not null").groupBy("k")
        rows = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"), F.sum("x").alias("total")).drop("k").collect()
        kept = [c for i, c in enumerate(self.cells) if i not in wanted]
        self.cells = sorted(kept + [tuple(r) for r in rows])
        self.lows = [c[0] for c in self.cells]
        self.before = [(0, 0.0), *accumulate(((c[2], c[3]) for c in self.cells), lambda a, b: (a[0] + b[0], a[1] + b[1]))]

    def upto(self, x: float) -> tuple[float, float, int | None]:
        """(count, sum) of the values at or below ``x``, and the cell inside which they are estimated, if any."""
        i = bisect_right(self.lows, x) - 1
        if i < 0:
            return 0, 0.0, None
        low, high, n, _ = self.cells[i]
        if x >= high:
            return *self.before[i + 1], None
        share = n * (x - low) / (high - low)
        return self.before[i][0] + share, self.before[i][1] + share * (low + x) / 2, i
