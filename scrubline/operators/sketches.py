"""Column profiles from mergeable sketches: one pass, and no cell is shuffled.

Every task folds its cells into one row a column: counts, moments, a HyperLogLog sketch of the different values, a KLL
sketch of the numbers, a heavy-hitter sketch of the short texts. The rows of tasks, of stored partitions and of days merge
in any order, so a table that grows is profiled by sketching what is new and merging it with what is stored.

Counts, minimum, maximum and mean are exact. Bounds of the rest, with a chance of error of about one in a hundred:
different values within ``DISTINCT_ERROR`` of the true number; a quantile's rank within ``RANK_ERROR`` of all numbers, and so
outliers within four times that share; a top value's count within 3.5 / ``TOP_ITEMS`` of all cells, and exact as
long as the different texts are at most three quarters of ``TOP_ITEMS``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions import dates, numbers
from scrubline.functions.text import strip
from scrubline.operators.steps import col

# log2 of the HyperLogLog registers, and three of its standard errors
DISTINCT_BITS = 14
DISTINCT_ERROR = 0.025
# numbers that a KLL sketch keeps at its lowest level
QUANTILE_K = 2048
RANK_ERROR = 0.002
# quantiles by which the share of outliers is told
GRID = 2000
# texts that the heavy-hitter sketch follows; longer texts are no categories and would fill the task's memory
TOP_ITEMS = 4096
TOP_CHARS = 256
SAMPLES = 5

_SUMS = ("total", "missing_count", "present", "boolean_count", "numeric_count", "date_count", "integer_count")


def _cells(df: DataFrame, columns: list[str], kind: str, by: str | None) -> DataFrame:
    typed = df.select(*([col(by).alias("part")] if by else [F.lit("").alias("part")]), *[col(c).cast(kind).alias(c) for c in columns])
    return typed.unpivot(["part"], [col(c) for c in columns], "column_name", "value")


def sketch_columns(df: DataFrame, by: str | None = None) -> DataFrame:
    """One row for each column, and each value of ``by`` if given (not profiled itself), to be stored and merged."""
    from scrubline.operators.profile import columns_by_kind

    data = df.drop(by) if by else df
    parts = [_sketched(_cells(df, columns, kind, by), kind) for kind, columns in columns_by_kind(data).items()]
    return reduce(DataFrame.unionByName, parts)


def _sketched(cells: DataFrame, kind: str) -> DataFrame:
    from scrubline.operators.profile import BOOLEAN_WORDS, SEMANTIC_PATTERNS, _missing_value

    v, text, never = F.col("value"), kind == "string", F.lit(False)
    cells = cells.withColumn("here", ~_missing_value(kind))
    here = F.col("here")
    cells = cells.withColumn("x", F.when(here, numbers.to_double(v, strip_currency=True) if text else v.cast("double")))
    norm = F.lower(strip(v)) if text else v.cast("string")
    known = F.when(here, v.cast("string"))
    is_boolean = norm.isin(*BOOLEAN_WORDS) if text else v.isin(0, 1) if kind == "bigint" else never
    is_integer = strip(v).rlike(r"^\d+$") if text else v >= 0 if kind == "bigint" else never
    is_date = dates.is_date_shaped(v) if text else never
    marker = F.coalesce(strip(v) if text else F.when(~F.isnan(v.cast("double")), v.cast("string")), F.lit(""))
    short = F.when(here & (F.length(strip(v)) <= TOP_CHARS), strip(v)) if text else F.lit(None).cast("string")
    count = lambda c: F.count_if(F.coalesce(c, never))
    samples = [F.min(F.when(here, F.struct(F.xxhash64(v, F.lit(seed)).alias("h"), known.alias("v")))).alias(f"sample{seed}") for seed in range(SAMPLES)]
    return cells.groupBy("part", "column_name").agg(
        F.lit(kind).alias("kind"),
        F.count("*").alias("total"),
        count(~here).alias("missing_count"),
        F.collect_set(F.when(~here, marker)).alias("encoded_as"),
        count(here).alias("present"),
        count(here & is_boolean).alias("boolean_count"),
        F.count("x").alias("numeric_count"),
        count(here & is_date).alias("date_count"),
        count(here & is_integer).alias("integer_count"),
        *[count(here & (strip(v).rlike(p) if text else never)).alias(f"{name}_count") for name, p in SEMANTIC_PATTERNS.items()],
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg("x").alias("mean"),
        F.var_pop("x").alias("spread"),
        F.hll_sketch_agg(known, DISTINCT_BITS).alias("values"),
        F.hll_sketch_agg(F.when(here, norm), DISTINCT_BITS).alias("spellings"),
        F.kll_sketch_agg_double("x", QUANTILE_K).alias("numbers"),
        _top_agg("approx_top_k_accumulate", short).alias("tops"),
        *samples,
    )


def _top_agg(function: str, c: Column) -> Column:
    return F.call_function(function, c, F.lit(TOP_ITEMS))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row for each column, of the same columns: the sketch of all cells."""
    from scrubline.operators.profile import SEMANTIC_PATTERNS

    n, mean = F.col("numeric_count"), F.col("mean")
    sums = [F.sum(c).alias(c) for c in (*_SUMS, *[f"{name}_count" for name in SEMANTIC_PATTERNS])]
    all_n = F.sum(n)
    middle = F.sum(n * mean) / all_n
    spread = (F.sum(n * F.col("spread")) + F.sum(n * mean * mean)) / all_n - middle * middle
    return sketches.groupBy("column_name").agg(
        F.lit("").alias("part"),
        F.max("kind").alias("kind"),
        *sums,
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("encoded_as")))).alias("encoded_as"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.when(all_n > 0, middle).alias("mean"),
        F.when(all_n > 0, F.greatest(spread, F.lit(0.0))).alias("spread"),
        F.hll_union_agg("values").alias("values"),
        F.hll_union_agg("spellings").alias("spellings"),
        F.kll_merge_agg_double("numbers").alias("numbers"),
        _top_agg("approx_top_k_combine", F.col("tops")).alias("tops"),
        *[F.min(f"sample{seed}").alias(f"sample{seed}") for seed in range(SAMPLES)],
    )


def sketch_facts(merged: DataFrame, top: int = 10) -> DataFrame:
    """The profile's facts and numeric shape, from merged sketches.

    Estimates that cannot be told from a bound are taken as the bound: nearly as many different values as present cells
    are all different, and nearly as many spellings as values mean none.
    """
    near = lambda a, b: F.when(a >= b * (1 - DISTINCT_ERROR), b).otherwise(a)
    estimated = merged.withColumn("u", F.hll_sketch_estimate("values")).withColumn("w", F.hll_sketch_estimate("spellings"))
    unique = near(F.col("u"), F.col("present"))
    estimated = estimated.withColumn("unique_count", unique).withColumn("normalised_count", near(F.col("w"), F.col("unique_count")))
    some = F.col("numeric_count") > 0
    at = lambda p: F.when(some, F.kll_sketch_get_quantile_double("numbers", F.lit(p)))
    shaped = estimated.select("*", at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3")).withColumn("iqr", F.expr("q3 - q1"))
    low, high = F.expr("q1 - 1.5 * iqr"), F.expr("q3 + 1.5 * iqr")
    # the share of evenly spaced quantiles beyond the fences
    grid = F.when(some, F.kll_sketch_get_quantile_double("numbers", F.lit([(i + 0.5) / GRID for i in range(GRID)])))
    outside = F.size(F.filter(grid, lambda x: (x < low) | (x > high))) / GRID
    n = F.col("numeric_count")
    std = F.when(n > 1, F.sqrt(F.col("spread") * n / (n - 1)))
    samples = F.array(*[F.col(f"sample{seed}")["v"] for seed in range(SAMPLES)])
    tops = F.call_function("approx_top_k_estimate", F.col("tops"), F.lit(top))
    return shaped.select(
        "*",
        std.alias("std"),
        F.when(some, F.round(outside * n).cast("long")).alias("outlier_count"),
        (F.col("present") - n).alias("non_numeric_count"),
        F.filter(F.array_distinct(samples), lambda s: s.isNotNull()).alias("sample_values"),
        F.transform(F.filter(tops, lambda t: t["item"].isNotNull()), lambda t: F.struct(t["item"].alias("value"), t["count"].alias("n"))).alias("top_values"),
    )
