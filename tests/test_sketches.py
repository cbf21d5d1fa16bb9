"""Sketch profiles within their bounds of the exact ones, however they were cut and merged."""

import random

import pytest
from pyspark.sql import functions as F

from scrubline.operators import profile as p
from scrubline.operators import sketches as s


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    made = []
    for i in range(20_000):
        price = rnd.choice([str(round(rnd.lognormvariate(3, 1), 2)), "N/A", f"${i % 900}.50", "-"])
        made.append((i % 7, i, price, rnd.choice(["Toys", "toys", "Food", None]), f"user{i}@mail.example", float("nan") if i % 50 == 0 else i / 3, None))
    names = "day int, id long, price string, kind string, mail string, x double, nothing string"
    return spark.createDataFrame(made, names).repartition(8)


EXACT = ["detected_type", "semantic_type", "total", "missing_count", "missing_pct", "encoded_as", "present", "date_count", "numeric_count", "min", "max"]


def close(got, want):
    for name, w in want.items():
        g = got[name]
        assert {c: g[c] for c in EXACT} == {c: w[c] for c in EXACT}, name
        assert abs(g["unique_count"] - w["unique_count"]) <= s.DISTINCT_ERROR * w["unique_count"]
        for moment in ("mean", "std"):
            assert (g[moment] is None) == (w[moment] is None)
            assert w[moment] is None or abs(g[moment] - w[moment]) <= 1e-4 * abs(w[moment]) + 1e-4
        assert abs((g["outlier_count"] or 0) - (w["outlier_count"] or 0)) <= 4 * s.RANK_ERROR * w["numeric_count"]
        # few different texts: the heavy hitters are exact
        assert g["top_values"] == w["top_values"]


def test_bounds(rows):
    data = rows.drop("day")
    want = {r["column_name"]: r for r in p.profile_table(data).collect()}
    got = {r["column_name"]: r for r in p.profile_table(data, exact=False).collect()}
    assert list(got) == list(want)
    close(got, want)
    numbers = sorted(r["x"] for r in data.where(~F.isnan("x")).select("x").collect())
    for share in (0.25, 0.5, 0.75):
        found = got["x"][{0.25: "q1", 0.5: "median", 0.75: "q3"}[share]]
        rank = sum(x <= found + 1e-4 for x in numbers) / len(numbers)
        assert abs(rank - share) <= s.RANK_ERROR + 1e-3
    values = {str(r[0]) for r in data.select("mail").collect()}
    assert 0 < len(got["mail"]["sample_values"]) <= s.SAMPLES and set(got["mail"]["sample_values"]) <= values


def test_stored_partitions_merge_to_the_whole(spark, rows, tmp_path):
    path = str(tmp_path / "sketches")
    s.sketch_columns(rows.where("day < 5"), by="day").write.parquet(path)
    s.sketch_columns(rows.where("day >= 5"), by="day").write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    names = [c for c in rows.columns if c != "day"]
    assert stored.count() == 7 * len(names)
    got = {r["column_name"]: r for r in p.profile_sketches(stored, names).collect()}
    close(got, {r["column_name"]: r for r in p.profile_table(rows.drop("day")).collect()})


def test_no_cell_is_shuffled(rows):
    plan = s.sketch_columns(rows)._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    # one for each kind of column, of what a task's partial aggregate makes of its cells
    assert len(shuffles) == len(p.columns_by_kind(rows)) == 3
    assert all("partial_count" in plan[i + 1] for i in shuffles)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b double")
    got = p.profile_table(empty, exact=False).collect()
    # no cells, no sketches: the exact profile has no rows for them either
    assert len(got) == len(p.profile_table(empty).collect())
