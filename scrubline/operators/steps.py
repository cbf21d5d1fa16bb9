"""Fit / transform steps over DataFrames.

A step says what it must know about the data (``needs``) and rewrites the frame once
it knows (``apply``). ``fit_all`` answers the needs of many steps with one aggregate
and one quantile search, so a run of imputations and scalers costs two or three scans
however many columns it touches. ``apply`` adds projections only, so Catalyst merges a
run of steps into one stage, and a fitted step also works on a streaming frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.operators.quantiles import exact_quantiles


@dataclass
class Needs:
    """Scalars a step must know: plain aggregates and exact quantiles."""

    aggregates: dict[str, Column] = field(default_factory=dict)
    quantiles: dict[str, tuple[Column, list[float]]] = field(default_factory=dict)


class Step:
    """One rewrite of a DataFrame."""

    column: str | None = None

    def reads(self, df: DataFrame) -> set[str]:
        """Columns whose values the fit depends on."""
        return {self.column} if self.column else set(df.columns)

    def check(self, df: DataFrame) -> None:
        if self.column is not None and self.column not in df.columns:
            raise ValueError(f"column '{self.column}' not found")

    def needs(self, df: DataFrame) -> Needs:
        return Needs()

    def learn(self, df: DataFrame, stats: dict[str, Any]) -> dict[str, Any]:
        """Extra fitting beyond scalars (dictionaries, iterations)."""
        return stats

    def apply(self, df: DataFrame, stats: dict[str, Any]) -> DataFrame:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Fitted:
        return fit_all(df, [self])[0]

    def run(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass
class Fitted:
    """A step with everything it learned; reusable on new or streaming data."""

    step: Step
    stats: dict[str, Any]

    def transform(self, df: DataFrame) -> DataFrame:
        self.step.check(df)
        return self.step.apply(df, self.stats)


def fit_all(df: DataFrame, steps: Sequence[Step]) -> list[Fitted]:
    """Fit steps that do not depend on each other's output, sharing the scans."""
    aggregates, quantiles = {}, {}
    for i, step in enumerate(steps):
        step.check(df)
        needs = step.needs(df)
        aggregates |= {f"{i}:{k}": c for k, c in needs.aggregates.items()}
        quantiles |= {f"{i}:{k}": q for k, q in needs.quantiles.items()}
    known: dict[str, Any] = {}
    if aggregates:
        row = df.agg(*[c.alias(k) for k, c in aggregates.items()]).first()
        known |= row.asDict()
    known |= exact_quantiles(df, quantiles)
    fitted = []
    for i, step in enumerate(steps):
        mine = {k.split(":", 1)[1]: v for k, v in known.items() if k.startswith(f"{i}:")}
        fitted.append(Fitted(step, step.learn(df, mine)))
    return fitted


def col(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")




def row_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the given cells: equal rows have equal keys, NULL differs from text.

    Grouping by the key shuffles a digest per row instead of whole rows.
    """
    cells = []
    for name in columns:
        kind, c = df.schema[name].dataType, col(name)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0).cast(kind)  # -0.0 equals 0.0
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        cells.append((F.to_json(c) if nested else c.cast("string")).alias(name))
    return F.unhex(F.sha2(F.to_json(F.struct(*cells)), 256))
