"""Feature analysis: shape of every column, correlations, candidates for removal."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.numbers import numeric, numeric_columns, string_columns
from scrubline.operators.profile import columns_by_kind, value_counts
from scrubline.operators.steps import col

# a spread below this share of the mean is rounding
FLAT = 1e-12

ANALYSIS_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("cardinality_ratio", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("skewness", T.DoubleType()),
        T.StructField("kurtosis", T.DoubleType()),
        T.StructField("has_negatives", T.BooleanType()),
        T.StructField("has_zeros", T.BooleanType()),
        T.StructField("coefficient_of_variation", T.DoubleType()),
        T.StructField("correlation_with_target", T.DoubleType()),
    ]
)


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct non-NULL values of many columns in one shuffle.

    Several ``count(distinct)`` in one aggregate would expand every row once per column
    and keep wide rows through the shuffle; (column, value) pairs combine map-side.
    """
    if not columns:
        return {}
    chosen = df.select(*[col(c) for c in columns])
    parts = []
    for kind, names in columns_by_kind(chosen).items():
        counts = value_counts(chosen, names, kind).where("value is not null")
        parts.append(counts.groupBy("column_name").agg(F.count("*").alias("k")))
    found = {r[0]: r[1] for r in reduce(DataFrame.unionByName, parts).collect()}
    return {c: found.get(c, 0) for c in columns}


def analyze_columns(df: DataFrame, target: str | None = None, exact_distinct: bool = True) -> DataFrame:
    """One row per column: counts, moments, signs, and correlation with the target."""
    names, nums = df.columns, set(numeric_columns(df))
    strings = set(string_columns(df))
    aggs = [F.count("*").alias("rows")]
    with_target = target is not None and target in nums
    for i, c in enumerate(names):
        aggs.append(F.count(col(c)).alias(f"n{i}"))
        if c in nums:
            x = numeric(df, c)
            aggs += [
                F.min(x).alias(f"min{i}"),
                F.max(x).alias(f"max{i}"),
                F.avg(x).alias(f"mean{i}"),
                F.stddev_samp(x).alias(f"std{i}"),
                F.bool_or(x < 0).alias(f"neg{i}"),
                F.bool_or(x == 0).alias(f"zero{i}"),
            ]
            if with_target and c != target:
                aggs.append(pearson(x, numeric(df, target)).alias(f"r{i}"))
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(col(c)).alias(f"d{i}"))
    row = df.agg(*aggs).first().asDict()
    shapes = _shapes(df, {c: row[f"mean{i}"] for i, c in enumerate(names) if c in nums})
    unique = distinct_counts(df, names) if exact_distinct else {c: row[f"d{i}"] for i, c in enumerate(names)}
    total = row["rows"]
    out = []
    for i, c in enumerate(names):
        n = row[f"n{i}"]
        info = dict.fromkeys(ANALYSIS_SCHEMA.fieldNames())
        info |= {
            "column_name": c,
            "type": "numeric" if c in nums else "categorical" if c in strings else "other",
            "null_count": total - n,
            "unique_count": unique[c],
            "cardinality_ratio": round(unique[c] / max(total, 1), 4),
        }
        if c in nums:
            mean, std = row[f"mean{i}"], row[f"std{i}"]
            info |= {
                "min": row[f"min{i}"],
                "max": row[f"max{i}"],
                "mean": _round(mean),
                "std": _round(std),
                "skewness": sample_skewness(shapes[c][0], n),
                "kurtosis": sample_kurtosis(shapes[c][1], n),
                "has_negatives": bool(row[f"neg{i}"]),
                "has_zeros": bool(row[f"zero{i}"]),
                "coefficient_of_variation": _variation(mean, std),
                "correlation_with_target": _round(row.get(f"r{i}")),
            }
        out.append(info)
    return df.sparkSession.createDataFrame(out, ANALYSIS_SCHEMA)


def _shapes(df: DataFrame, means: dict[str, float | None]) -> dict[str, tuple[float | None, float | None]]:
    """Population skewness and excess kurtosis from plain sums around known means."""
    aggs = []
    for i, (c, mean) in enumerate(means.items()):
        d = numeric(df, c) - F.lit(mean or 0.0)
        aggs += [F.avg(d * d).alias(f"a{i}"), F.avg(d * d * d).alias(f"b{i}"), F.avg(d * d * d * d).alias(f"c{i}")]
    if not aggs:
        return {}
    row, out = df.agg(*aggs).first(), {}
    for i, (c, mean) in enumerate(means.items()):
        m2, m3, m4 = row[f"a{i}"], row[f"b{i}"], row[f"c{i}"]
        varies = m2 is not None and m2 > (FLAT * abs(mean)) ** 2
        out[c] = (m3 / m2**1.5, m4 / m2**2 - 3) if varies else (None, None)
    return out


def _round(x: float | None) -> float | None:
    return None if x is None else round(float(x), 4)


def _variation(mean: float | None, std: float | None) -> float:
    if not std:
        return 0.0
    return round(abs(std / mean), 4) if mean else float("inf")


def sample_skewness(g1: float | None, n: int) -> float:
    """Bias-corrected skewness from the population moment."""
    if n < 3 or g1 is None:
        return 0.0
    return round(g1 * (n * (n - 1)) ** 0.5 / (n - 2), 4)


def sample_kurtosis(g2: float | None, n: int) -> float:
    """Bias-corrected excess kurtosis from the population moment."""
    if n < 4 or g2 is None:
        return 0.0
    return round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), 4)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; NULL if either does not vary.

    ``corr`` itself fails on a constant column in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()

    def spread(c: Column) -> Column:
        known = F.when(both, c)
        # merging partial moments leaves a trace of rounding in a constant column
        return F.when(F.stddev_pop(known) > FLAT * F.abs(F.avg(known)), F.stddev_pop(known))

    return F.covar_pop(x, y) / (spread(x) * spread(y))


def target_correlation(df: DataFrame, target: str) -> DataFrame:
    """(column_name, correlation) of every other numeric column with the target."""
    names = [c for c in numeric_columns(df) if c != target]
    y = numeric(df, target)
    wide = df.agg(*[pearson(numeric(df, c), y).alias(c) for c in names])
    return wide.unpivot([], [col(c) for c in names], "column_name", "correlation")


def correlations(df: DataFrame, columns: list[str] | None = None) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair of numeric columns, pairwise complete.

    Every batch adds its cross products, so a task sends one row per pair however many rows it
    read. Values are centred first, so the sums keep their digits. Flat columns have none.
    """
    names = columns if columns is not None else numeric_columns(df)
    if len(names) < 2:
        return {}
    k = len(names)
    xs = df.select(*[numeric(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    means = [m or 0.0 for m in xs.agg(*[F.avg(c) for c in xs.columns]).first()]
    centred = xs.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(xs.columns, means, strict=True)])
    upper = np.triu_indices(k, 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            cross, square = x.T @ m, (x * x).T @ m
            part = np.stack([m.T @ m, cross, cross.T, square, square.T, x.T @ x])
            sums = part if sums is None else sums + part
        if sums is not None:
            flat = sums[:, upper[0], upper[1]]
            yield pd.DataFrame(dict(zip(("n", "sx", "sy", "sxx", "syy", "sxy"), flat, strict=True))).assign(pair=range(flat.shape[1]))

    schema = "n double, sx double, sy double, sxx double, syy double, sxy double, pair int"
    total = centred.mapInPandas(products, schema).groupBy("pair").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    found = {}
    for row in total.where("n > 0").collect():
        n, i, j = row["n"], int(upper[0][row["pair"]]), int(upper[1][row["pair"]])
        vx, vy = row["sxx"] / n - (row["sx"] / n) ** 2, row["syy"] / n - (row["sy"] / n) ** 2
        if vx > (FLAT * means[i]) ** 2 and vy > (FLAT * means[j]) ** 2:
            found[row["pair"]] = (row["sxy"] / n - row["sx"] / n * row["sy"] / n) / (vx * vy) ** 0.5
    return {(names[i], names[j]): found.get(p) for p, (i, j) in enumerate(zip(*upper, strict=True))}


def correlated_pairs(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(col1, col2, correlation): pairs whose absolute correlation exceeds the threshold."""
    found = correlations(df)
    rows = [(a, b, round(abs(r), 4)) for (a, b), r in found.items() if r is not None and abs(r) > threshold]
    return df.sparkSession.createDataFrame(rows, "col1 string, col2 string, correlation double")


def top_categories(df: DataFrame, k: int = 5) -> DataFrame:
    """(column_name, rank, value, n): most frequent values of string columns, untrimmed."""
    names = string_columns(df)
    long = df.unpivot([], [col(c) for c in names], "column_name", "value").where("value is not null")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def low_variance_columns(df: DataFrame) -> DataFrame:
    """(column_name, relative_std) of numeric columns that hardly vary."""
    names = numeric_columns(df)
    wide = df.agg(
        *[(F.stddev_samp(numeric(df, c)) / (F.abs(F.avg(numeric(df, c))) + 1e-9)).alias(c) for c in names]
    )
    long = wide.unpivot([], [col(c) for c in names], "column_name", "relative_std")
    return long.where("relative_std < 0.01")
