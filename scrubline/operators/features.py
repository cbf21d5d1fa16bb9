"""Feature engineering steps: encoding, scaling, distribution, creation, selection.

Numeric inputs are coerced to double and NULLs count as 0 before fitting, except where
a step says otherwise.
"""

from __future__ import annotations

import math
from itertools import combinations, combinations_with_replacement
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.numbers import numeric, numeric_columns, string_columns
from scrubline.operators.analysis import correlations, distinct_counts
from scrubline.operators.cells import Cells
from scrubline.operators.cleaning import look_up
from scrubline.operators.lookup import ValueTable, dense_index
from scrubline.operators.quantiles import ranked_quantiles
from scrubline.operators.steps import Needs, Step, col
from scrubline.session import stage_table


def filled(df: DataFrame, column: str) -> Column:
    """Numeric value with NULL (and text that is no number) as 0."""
    return F.coalesce(numeric(df, column), F.lit(0.0))


class ColumnFeature(Step):
    def __init__(self, column: str):
        self.column = column


# ---- encoding -------------------------------------------------------------------


class OneHotEncode(ColumnFeature):
    """One 0/1 column per category, in sorted order; NULL is 0 everywhere.

    The categories become columns, so they are as many as a table can be wide.
    """

    def __init__(self, column: str, drop_first: bool = True):
        super().__init__(column)
        self.drop_first = drop_first

    def learn(self, df, stats):
        c = col(self.column)
        found = df.where(c.isNotNull()).select(c.alias("v")).distinct().collect()
        return {"values": sorted(r["v"] for r in found)}

    def apply(self, df, stats):
        values = stats["values"][1:] if self.drop_first else stats["values"]
        c = col(self.column)
        keep = [col(n) for n in df.columns if n != self.column]
        hot = [
            F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)).alias(f"{self.column}_{v}") for v in values
        ]
        return df.select(*keep, *hot)


class LabelEncode(ColumnFeature):
    """Categories to integers: by an explicit order (others -1), else by sorted position."""

    def __init__(self, column: str, order: list | None = None):
        super().__init__(column)
        self.codes = {v: i for i, v in enumerate(order)} if order else None
        self.code_type = "int"

    def learn(self, df, stats):
        if self.codes is not None:
            return stats
        text = col(self.column).cast("string")
        counts = df.where(text.isNotNull()).groupBy(text.alias("__v")).agg(F.count("*").alias("n"))
        return {"table": ValueTable(dense_index(counts, "__v"), "__v")}

    def apply(self, df, stats):
        c = col(self.column).cast("string")
        if self.codes is not None:
            text = df.withColumn(self.column, c)
            return look_up(text, self.column, {str(v): i for v, i in self.codes.items()}, "int", F.lit(-1))
        text = df.withColumn(self.column, c)
        coded = stats["table"].attach(text, self.column)
        return coded.withColumn(self.column, F.col("idx").cast(self.code_type)).select(*map(col, df.columns))


class OrdinalEncode(LabelEncode):
    """Categories by an explicit mapping (others -1), else sorted position as double."""

    def __init__(self, column: str, mapping: dict | None = None):
        super().__init__(column)
        self.codes = {k: int(v) for k, v in mapping.items()} if mapping else None
        self.code_type = "double"


class TargetEncode(ColumnFeature):
    """Category to the smoothed mean of the target; unseen and NULL to the global mean."""

    def __init__(self, column: str, target_column: str = "", smoothing: float = 1.0):
        super().__init__(column)
        self.target = target_column
        self.smoothing = float(smoothing)

    def reads(self, df):
        return {self.column, self.target}

    def needs(self, df):
        if not self.target or self.target not in df.columns:
            raise ValueError(f"target_column '{self.target}' not found")
        return Needs(aggregates={"mean": F.avg(numeric(df, self.target))})

    def learn(self, df, stats):
        mean = stats["mean"]
        y = numeric(df, self.target)
        per_value = df.where(col(self.column).isNotNull()).groupBy(col(self.column).alias("__v"))
        table = per_value.agg(F.count("*").alias("n"), F.count(y).alias("k"), F.sum(y).alias("s"))
        s = self.smoothing
        code = (F.coalesce("s", F.lit(0.0)) + F.lit(s * mean if mean is not None else None)) / (F.col("k") + s)
        # without smoothing a category with no target value has no mean of its own
        code = F.when(F.col("k") + F.lit(s) > 0, code)
        return {"mean": mean, "table": ValueTable(table.select("__v", "n", code.alias("code")), "__v")}

    def apply(self, df, stats):
        coded = stats["table"].attach(df, self.column)
        value = F.coalesce("code", F.lit(stats["mean"]).cast("double"))
        return coded.withColumn(self.column, value).select(*map(col, df.columns))


class FrequencyEncode(ColumnFeature):
    """Category to its row count; NULL stays NULL."""

    def learn(self, df, stats):
        c = col(self.column)
        table = df.where(c.isNotNull()).groupBy(c.alias("__v")).agg(F.count("*").alias("n"))
        return {"table": ValueTable(table, "__v")}

    def apply(self, df, stats):
        coded = stats["table"].attach(df.withColumnRenamed(self.column, "__raw"), "__raw")
        return coded.withColumn(self.column, F.col("n")).select(*map(col, df.columns))


# ---- scaling --------------------------------------------------------------------


class Scaler(ColumnFeature):
    def scaled(self, x: Column, stats: dict[str, Any]) -> Column:
        raise NotImplementedError

    def apply(self, df, stats):
        return df.withColumn(self.column, self.scaled(filled(df, self.column), stats))


class MinMaxScale(Scaler):
    def __init__(self, column: str, feature_range=(0, 1)):
        super().__init__(column)
        self.low, self.high = float(feature_range[0]), float(feature_range[1])

    def needs(self, df):
        x = filled(df, self.column)
        return Needs(aggregates={"min": F.min(x), "max": F.max(x)})

    def scaled(self, x, stats):
        if stats["min"] is None:
            return x
        width = (stats["max"] - stats["min"]) or 1.0
        return (x - stats["min"]) / width * (self.high - self.low) + self.low


class StandardScale(Scaler):
    def needs(self, df):
        x = filled(df, self.column)
        return Needs(aggregates={"mean": F.avg(x), "std": F.stddev_pop(x)})

    def scaled(self, x, stats):
        return (x - stats["mean"]) / (stats["std"] or 1.0) if stats["mean"] is not None else x


class RobustScale(Scaler):
    def needs(self, df):
        return Needs(quantiles={"q": (filled(df, self.column), [0.25, 0.5, 0.75])})

    def scaled(self, x, stats):
        q1, median, q3 = stats["q"]
        return (x - median) / ((q3 - q1) or 1.0) if median is not None else x


class MaxAbsScale(Scaler):
    def needs(self, df):
        return Needs(aggregates={"top": F.max(F.abs(filled(df, self.column)))})

    def scaled(self, x, stats):
        return x / (stats["top"] or 1.0)


# ---- distribution ---------------------------------------------------------------


class LogTransform(Scaler):
    """Logarithm; a column with values <= 0 is shifted by ``abs(min) + 1`` first."""

    def __init__(self, column: str, base="natural"):
        super().__init__(column)
        self.base = base

    def needs(self, df):
        return Needs(aggregates={"min": F.min(filled(df, self.column))})

    def scaled(self, x, stats):
        low = stats["min"]
        shifted = x + (abs(low) + 1.0) if low is not None and low <= 0 else x
        return F.ln(shifted) if self.base == "natural" else F.log10(shifted)


class PowerTransform(Scaler):
    """Yeo-Johnson or Box-Cox with the maximum-likelihood lambda, then standardised.

    The column is staged. Ranges of its values give a first lambda, and one aggregate over a narrow grid around it
    the exact one. If the optimum lies outside, rounds over shrinking grids find it.
    """

    GRID = 32
    # half the width of the grid around the first lambda: its steps are short enough for a parabola
    NEAR = 0.0155

    def __init__(self, column: str, method: str = "yeo-johnson"):
        if method not in ("yeo-johnson", "box-cox"):
            raise ValueError(f"unknown method {method!r}")
        super().__init__(column)
        self.method = method

    def needs(self, df):
        x = filled(df, self.column)
        log = F.signum(x) * F.log1p(F.abs(x)) if self.method == "yeo-johnson" else F.ln(x)
        return Needs(aggregates={"min": F.min(x), "max": F.max(x), "n": F.count(x), "logs": F.sum(log)})

    def power(self, x: Column, lam: float, positive: bool = False) -> Column:
        if self.method == "box-cox":
            return F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam
        up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
        if positive:
            return up
        rest = 2 - lam
        down = -F.log1p(-x) if abs(rest) < 1e-12 else -(F.pow(1 - x, F.lit(rest)) - 1) / rest
        return F.when(x >= 0, up).otherwise(down)

    def learn(self, df, stats):
        if self.method == "box-cox" and stats["min"] is not None and stats["min"] <= 0:
            raise ValueError("box-cox needs positive values")
        if not stats["n"] or stats["min"] == stats["max"]:
            return {"lambda": 1.0, "mean": stats["min"] or 0.0, "std": 1.0, "identity": True}
        values = stage_table(df.select(filled(df, self.column).alias("x")), "power")
        rough = self._rough(Cells(values, stats["min"], stats["max"]).cells, stats)
        low, high = rough - self.NEAR, rough + self.NEAR
        best = None
        while high - low > 1e-7:
            grid = [low + (high - low) * i / self.GRID for i in range(self.GRID + 1)]
            fits = self._likelihood(values, grid, stats)
            top = max(range(len(grid)), key=lambda i: fits[i])
            step = (high - low) / self.GRID
            if top in (0, self.GRID) and abs(grid[top]) < 64 and best is None:
                # the optimum may lie outside: move the grid
                low, high = grid[top] - 4.0, grid[top] + 4.0
                continue
            best = grid[top]
            if step < 1e-3 and 0 < top < self.GRID:
                # the likelihood is smooth: the vertex of a parabola ends the search
                a, b, c = fits[top - 1], fits[top], fits[top + 1]
                curve = a - 2 * b + c
                if curve < 0:
                    best += 0.5 * step * (a - c) / curve
                break
            low, high = best - step, best + step
        y = self.power(F.col("x"), best)
        row = values.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std")).first()
        return {"lambda": best, "mean": row["mean"], "std": row["std"] or 1.0, "identity": False}

    def _rough(self, cells: list, stats) -> float:
        """The best lambda if every value were the mean of its cell, by golden sections."""
        points = [(total / n, n) for _, _, n, total in cells]

        def power(x: float, lam: float) -> float:
            if self.method == "box-cox":
                return math.log(x) if lam == 0 else math.expm1(lam * math.log(x)) / lam
            if x >= 0:
                return math.log1p(x) if lam == 0 else math.expm1(lam * math.log1p(x)) / lam
            return -math.log1p(-x) if lam == 2 else -math.expm1((2 - lam) * math.log1p(-x)) / (2 - lam)

        def fit(lam: float) -> float:
            try:
                y = [power(x, lam) for x, _ in points]
                mean = sum(v * n for v, (_, n) in zip(y, points, strict=True)) / stats["n"]
                var = sum((v - mean) ** 2 * n for v, (_, n) in zip(y, points, strict=True)) / stats["n"]
                return -stats["n"] / 2 * math.log(var) + (lam - 1) * stats["logs"]
            except (OverflowError, ValueError):
                return -math.inf

        low, high, golden = -4.0, 4.0, (math.sqrt(5) - 1) / 2
        while high - low > 1e-4:
            a, b = high - golden * (high - low), low + golden * (high - low)
            if fit(a) >= fit(b):
                high = b
            else:
                low = a
        return (low + high) / 2

    def _likelihood(self, values: DataFrame, grid: list[float], stats) -> list[float]:
        powers = [self.power(F.col("x"), lam, stats["min"] >= 0).alias(f"y{i}") for i, lam in enumerate(grid)]
        row = values.select(*powers).agg(*[F.var_pop(f"y{i}").alias(f"v{i}") for i in range(len(grid))]).first()
        out = []
        for i, lam in enumerate(grid):
            v = row[f"v{i}"]
            usable = v is not None and 0 < v < math.inf
            out.append(-stats["n"] / 2 * math.log(v) + (lam - 1) * stats["logs"] if usable else -math.inf)
        return out

    def scaled(self, x, stats):
        if stats["identity"]:
            return x - stats["mean"]
        return (self.power(x, stats["lambda"]) - stats["mean"]) / stats["std"]


class QuantileTransform(Scaler):
    """Map values to their quantile, uniform in [0, 1] or standard normal.

    Knots are exact quantiles at every size. A value between two knots lies between their
    quantiles in proportion, one equal to several knots in the middle of theirs.
    """

    KNOTS = 1000
    # Fixed value: distance from 0 and 1 at which normal scores are clipped.
    EDGE = 1e-7

    def __init__(self, column: str, output_distribution: str = "normal"):
        if output_distribution not in ("normal", "uniform"):
            raise ValueError(f"unknown output_distribution {output_distribution!r}")
        super().__init__(column)
        self.output = output_distribution

    def needs(self, df):
        return Needs(aggregates={"n": F.count(F.lit(1))})

    def learn(self, df, stats):
        k = min(stats["n"], self.KNOTS)
        refs = [i / (k - 1) for i in range(k)] if k > 1 else [0.0] * k
        # equal knots are one knot with the range of quantiles that it covers
        knots: list[list[float]] = []
        for x, p in zip(ranked_quantiles(df.select(filled(df, self.column).alias("x")), "x", refs), refs, strict=True):
            if knots and knots[-1][0] == x:
                knots[-1][2] = p
            else:
                knots.append([x, p, p])
        return {"knots": knots}

    def scaled(self, x, stats):
        knots = stats["knots"]
        if not knots:
            return x
        low, high = knots[0][0], knots[-1][0]
        values, firsts, lasts = (F.array(*[F.lit(float(k[i])) for k in knots]) for i in range(3))
        margin = self.EDGE if self.output == "normal" else 0.0

        def quantile(place: Column) -> Column:
            at, after = F.get(values, place), F.get(values, place + 1)
            between = F.get(lasts, place) + (x - at) / (after - at) * (F.get(firsts, place + 1) - F.get(lasts, place))
            inside = F.when(x == at, (F.get(firsts, place) + F.get(lasts, place)) / 2).otherwise(between)
            p = F.when(x - margin < low, 0.0) if margin else F.when(x <= low, 0.0)
            p = p.when(x + margin > high, 1.0) if margin else p.when(x >= high, 1.0)
            return p.otherwise(inside)

        p = _once(_last_not_above(x, values, len(knots)), quantile)
        if self.output == "uniform":
            return p
        return _once(F.least(F.greatest(p, F.lit(self.EDGE)), F.lit(1 - self.EDGE)), normal_score)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_not_above(x: Column, values: Column, n: int) -> Column:
    """The place of the last of ``n`` sorted values that isn't above ``x`` (0 if all are), by halving."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]

    def move(place: Column, step: Column) -> Column:
        further = F.coalesce(F.get(values, place + step) <= x, F.lit(False))
        return F.when(further, place + step).otherwise(place)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), move)


# A public rational approximation of the normal quantile (relative error under 1.2e-9).
_CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
           (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
         (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
_TAIL_FROM = 0.02425


def normal_score(p: Column) -> Column:
    """The standard normal quantile of a probability strictly between 0 and 1."""

    def polynomial(x: Column, factors: tuple) -> Column:
        total = F.lit(factors[0])
        for f in factors[1:]:
            total = total * x + F.lit(f)
        return total

    def tail(q: Column) -> Column:
        r = F.sqrt(-2 * F.log(q))
        return polynomial(r, _TAIL[0]) / polynomial(r, _TAIL[1])

    q = p - 0.5
    centre = polynomial(q * q, _CENTRE[0]) * q / polynomial(q * q, _CENTRE[1])
    return F.when(p < _TAIL_FROM, tail(p)).when(p > 1 - _TAIL_FROM, -tail(1 - p)).otherwise(centre)


# ---- binning --------------------------------------------------------------------


class Binning(ColumnFeature):
    """Bin numbers in a new column ``{column}_binned``: quantile, uniform or kmeans edges."""

    MIN_WIDTH = 1e-8
    MAX_ROUNDS = 300

    def __init__(self, column: str, n_bins: int = 5, strategy: str = "quantile"):
        if strategy not in ("quantile", "uniform", "kmeans"):
            raise ValueError(f"unknown strategy {strategy!r}")
        if n_bins < 2:
            raise ValueError("n_bins must be at least 2")
        super().__init__(column)
        self.n_bins, self.strategy = n_bins, strategy

    def needs(self, df):
        x = filled(df, self.column)
        if self.strategy == "quantile":
            return Needs(quantiles={"edges": (x, [i / self.n_bins for i in range(self.n_bins + 1)])})
        return Needs(aggregates={"min": F.min(x), "max": F.max(x), "var": F.var_pop(x)})

    def learn(self, df, stats):
        if self.strategy == "quantile":
            edges = stats["edges"]
            if edges[0] is None:
                return {"edges": []}
            kept = [edges[0]]
            for e in edges[1:]:
                if e - kept[-1] > self.MIN_WIDTH:
                    kept.append(e)
            return {"edges": kept}
        low, high = stats["min"], stats["max"]
        if low is None or low == high:
            return {"edges": []}
        width = (high - low) / self.n_bins
        uniform = [low + width * i for i in range(self.n_bins)] + [high]
        if self.strategy == "uniform":
            return {"edges": uniform}
        centers = self._centers(df, uniform, stats["var"])
        mids = [(a + b) / 2 for a, b in zip(centers, centers[1:], strict=False)]
        return {"edges": [low, *mids, high]}

    def _centers(self, df, uniform, var) -> list[float]:
        """One-dimensional k-means started from the middles of uniform bins.

        All rounds run on the driver over ranges of the values; ranges that a border between two centers came to lie in are
        split, and the rounds are run again, until no round had to estimate anything.
        """
        values = stage_table(df.select(filled(df, self.column).alias("x")), "points")
        cells = Cells(values, uniform[0], uniform[-1])
        while True:
            centers, inside = self._rounds(cells, uniform, var)
            if not inside:
                return centers
            cells.split(inside)

    def _rounds(self, cells: Cells, uniform, var) -> tuple[list[float], set[int]]:
        centers = [(a + b) / 2 for a, b in zip(uniform, uniform[1:], strict=False)]
        inside = set()
        for _ in range(self.MAX_ROUNDS):
            # a point halfway between two centers belongs to the lower one
            found = [(0, 0.0, None), *[cells.upto((a + b) / 2) for a, b in zip(centers, centers[1:], strict=False)], cells.upto(uniform[-1])]
            inside |= {i for _, _, i in found if i is not None}
            moved = sorted((t2 - t1) / (n2 - n1) if n2 > n1 else c for c, (n1, t1, _), (n2, t2, _) in zip(centers, found, found[1:], strict=False))
            shift = sum((a - b) ** 2 for a, b in zip(centers, moved, strict=True))
            centers = moved
            if shift <= 1e-4 * var:
                break
        return centers, inside

    def apply(self, df, stats):
        inner = stats["edges"][1:-1]
        return df.withColumn(f"{self.column}_binned", bin_number(filled(df, self.column), inner))


def bin_number(x: Column, inner_edges: list[float], right_open: bool = True) -> Column:
    """How many inner edges lie at or below (right-open) or below the value."""
    number = F.lit(0)
    for e in inner_edges:
        beyond = x >= F.lit(e) if right_open else x > F.lit(e)
        number = number + F.when(beyond, 1).otherwise(0)
    return number


# ---- creation -------------------------------------------------------------------


class InteractionFeatures(Step):
    """Products of column pairs as ``{a}_x_{b}``; NULL stays NULL, unknown pairs are skipped."""

    def __init__(self, column_pairs: list[list[str]]):
        self.pairs = [tuple(p) for p in column_pairs if len(p) == 2]

    def reads(self, df):
        return {c for p in self.pairs for c in p}

    def apply(self, df, stats):
        known = [(a, b) for a, b in self.pairs if a in df.columns and b in df.columns]
        return df.withColumns({f"{a}_x_{b}": numeric(df, a) * numeric(df, b) for a, b in known}) if known else df


class PolynomialFeatures(Step):
    """Products of columns up to a degree; the columns themselves stay as they are."""

    def __init__(self, columns: list[str], degree: int = 2, interaction_only: bool = False):
        self.columns, self.degree, self.interaction_only = list(columns), degree, interaction_only

    def reads(self, df):
        return set(self.columns)

    def check(self, df):
        if not any(c in df.columns for c in self.columns):
            raise ValueError(f"none of columns {self.columns} found")

    def apply(self, df, stats):
        valid = [c for c in self.columns if c in df.columns]
        combine = combinations if self.interaction_only else combinations_with_replacement
        made = {}
        for d in range(2, self.degree + 1):
            for combo in combine(valid, d):
                powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
                name = " ".join(c if k == 1 else f"{c}^{k}" for c, k in powers.items())
                value = None
                for c in combo:
                    value = filled(df, c) if value is None else value * filled(df, c)
                made[name] = value
        return df.withColumns(made) if made else df


# ---- selection ------------------------------------------------------------------


class DropLowVariance(Step):
    """Drop numeric columns whose population variance (NULL as 0) is at most the threshold."""

    def __init__(self, threshold: float = 0.01):
        self.threshold = threshold

    def learn(self, df, stats):
        names = numeric_columns(df)
        if not names:
            return {"dropped": []}
        row = df.agg(*[F.var_pop(filled(df, c)).alias(f"v{i}") for i, c in enumerate(names)]).first()
        dropped = [c for i, c in enumerate(names) if (row[f"v{i}"] or 0.0) <= self.threshold]
        if len(dropped) == len(names):
            raise ValueError("no numeric column varies enough")
        return {"dropped": dropped}

    def apply(self, df, stats):
        return df.drop(*stats["dropped"])


class DropHighCardinality(Step):
    """Drop string columns with more distinct values than the limit."""

    def __init__(self, max_cardinality: int = 50):
        self.max_cardinality = max_cardinality

    def learn(self, df, stats):
        counts = distinct_counts(df, string_columns(df))
        return {"dropped": [c for c, n in counts.items() if n > self.max_cardinality]}

    def apply(self, df, stats):
        return df.drop(*stats["dropped"])


class DropCorrelated(Step):
    """Drop the later column of every pair whose absolute correlation exceeds the threshold."""

    def __init__(self, threshold: float = 0.95):
        self.threshold = threshold

    def learn(self, df, stats):
        found = correlations(df)
        late = {b for (_, b), r in found.items() if r is not None and abs(r) > self.threshold}
        return {"dropped": [c for c in df.columns if c in late]}

    def apply(self, df, stats):
        return df.drop(*stats["dropped"])
