"""Exact quantiles against numpy, whatever the sketch says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.operators import quantiles as q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(6)
    got = q.exact_quantiles(df, {"x": (F.col("x"), PROBS)})["x"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("accuracy", [4, 50, 10_000])
def test_distributions(spark, monkeypatch, accuracy):
    monkeypatch.setattr(q, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    check(spark, rng.lognormal(3, 2, 5000))
    check(spark, rng.integers(0, 4, 3000))
    check(spark, np.r_[np.zeros(2000), rng.normal(size=1000)])


def test_small_and_empty(spark):
    check(spark, [7.0])
    check(spark, [1.0, 2.0])
    df = spark.createDataFrame([(None,)], "x double")
    assert q.exact_quantiles(df, {"x": (F.col("x"), [0.5])}) == {"x": [None]}


def test_a_wrong_bracket_is_noticed(spark, monkeypatch):
    """Brackets that miss the rank are widened until the counts prove them right."""
    real = q._bracket

    def wrong(values, probs, accuracy):
        counts, brackets = real(values, probs, accuracy)
        return counts, {k: (lo + 5, hi + 5) for k, (lo, hi) in brackets.items()}

    monkeypatch.setattr(q, "_bracket", wrong)
    check(spark, np.arange(1000) / 10)


def test_wide_brackets_are_narrowed(spark, monkeypatch):
    """However many values a bracket holds, only a few of them come to the driver."""
    monkeypatch.setattr(q, "ACCURACY", 100)
    monkeypatch.setattr(q, "GATHER", 20)
    check(spark, np.random.default_rng(2).normal(size=5000))
    check(spark, np.repeat([1.0, 2.0, 3.0], 500))


def test_ranked_quantiles(spark):
    data = np.random.default_rng(3).normal(size=3000).round(2)
    probs = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,)], "x double")
    assert np.allclose(q.ranked_quantiles(df, "x", probs), np.quantile(data, probs))
