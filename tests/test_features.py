"""Feature steps against numpy and hand-computed results."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from scrubline.operators import analysis as a
from scrubline.operators import features as f
from scrubline.operators import lookup
from scrubline.operators.cleaning import MapCategories


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, c {kind}")


def run(spark, step, values, kind="double", column="c"):
    return [r[column] for r in step.run(frame(spark, values, kind)).orderBy("id").collect()]


@pytest.fixture(scope="module")
def people(spark):
    """Eighty made-up households: two spread columns, one flat, one with a tail, two groupings."""
    rows = [
        (20.0 + (i * 37) % 61, 900.0 * 1.07 ** (i % 40), (i * i) % 97 / 10, "north south west".split()[i % 3], f"street {i % 50}", ["own", "rent"][i // 7 % 2], 2.5)
        for i in range(80)
    ]
    return spark.createDataFrame(rows, "years double, income double, index double, region string, street string, tenure string, rooms double")


def test_one_hot(spark):
    out = f.OneHotEncode("c").run(frame(spark, ["b", "a", None, "c"], "string")).orderBy("id")
    assert out.columns == ["id", "c_b", "c_c"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    assert "c_a" in f.OneHotEncode("c", drop_first=False).run(frame(spark, ["a"], "string")).columns


def test_one_hot_of_many_categories(spark):
    out = f.OneHotEncode("c").run(frame(spark, [f"v{i:04}" for i in range(1500)], "string"))
    assert len(out.columns) == 1500 and out.where("id = 1499").first()["c_v1499"] == 1


def test_long_orders_and_mappings(spark):
    order = [f"v{i}" for i in range(5000)]
    assert run(spark, f.LabelEncode("c", order), ["v4999", "v0", "no", None], "string") == [4999, 0, -1, -1]
    for n in (10, 100):
        mapping = {f"v{i}": None if i == 3 else f"m{i}" for i in range(n)}
        out = MapCategories("c", mapping).run(frame(spark, [" v3 ", "v5", "x", None], "string")).orderBy("id")
        assert [r["c"] for r in out.collect()] == [None, "m5", "x", None]


def test_label_and_ordinal(spark):
    values = ["high", "low", None, "other"]
    assert run(spark, f.LabelEncode("c", ["low", "high"]), values, "string") == [1, 0, -1, -1]
    assert run(spark, f.LabelEncode("c"), values, "string") == [0, 1, None, 2]
    assert run(spark, f.OrdinalEncode("c", {"low": 3}), values, "string") == [-1, 3, -1, -1]
    assert run(spark, f.OrdinalEncode("c"), values, "string") == [0.0, 1.0, None, 2.0]


@pytest.mark.parametrize("rows", [20_000, 0])
def test_target_and_frequency(spark, monkeypatch, rows):
    """The same codes from a broadcast table and from a salted shuffle join."""
    monkeypatch.setattr(lookup, "SMALL_TABLE_ROWS", rows)
    monkeypatch.setattr(lookup, "HOT_SHARE", 3)
    data = [(i, "hot" if i % 2 else f"v{i % 10}" if i % 3 else None, float(i)) for i in range(120)]
    df = spark.createDataFrame(data, "id long, c string, y double").repartition(4)
    mean = sum(y for *_, y in data) / len(data)
    groups = {}
    for _, v, y in data:
        groups.setdefault(v, []).append(y)
    got = {r["id"]: r["c"] for r in f.TargetEncode("c", "y", 2.0).run(df).collect()}
    freq = {r["id"]: r["c"] for r in f.FrequencyEncode("c").run(df).collect()}
    assert len(got) == len(freq) == len(data)
    for i, v, _ in data:
        ys = groups[v]
        want = mean if v is None else (sum(ys) + 2 * mean) / (len(ys) + 2)
        assert got[i] == pytest.approx(want)
        assert freq[i] == (None if v is None else len(ys))


def test_label_encoding_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL_TABLE_ROWS", 0)
    values = [f"k{i % 500:04d}" for i in range(1500)]
    assert run(spark, f.LabelEncode("c"), values, "string") == [i % 500 for i in range(1500)]


def test_target_encode_needs_its_target(spark):
    with pytest.raises(ValueError):
        f.TargetEncode("c", "absent").run(frame(spark, ["a"], "string"))


def test_scalers(spark):
    x = [1.0, 2.0, None, 4.0, 10.0]
    z = np.array([1, 2, 0, 4, 10.0])
    q1, med, q3 = np.quantile(z, [0.25, 0.5, 0.75])
    assert run(spark, f.MinMaxScale("c"), x) == pytest.approx(list(z / 10))
    assert run(spark, f.MinMaxScale("c", (-1, 1)), x) == pytest.approx(list(z / 5 - 1))
    assert run(spark, f.StandardScale("c"), x) == pytest.approx(list((z - z.mean()) / z.std()))
    assert run(spark, f.RobustScale("c"), x) == pytest.approx(list((z - med) / (q3 - q1)))
    assert run(spark, f.MaxAbsScale("c"), [-4.0, 2.0]) == [-1.0, 0.5]


def test_scalers_of_a_constant(spark):
    assert run(spark, f.MinMaxScale("c"), [5.0, 5.0]) == [0.0, 0.0]
    assert run(spark, f.StandardScale("c"), [5.0, 5.0]) == [0.0, 0.0]
    assert run(spark, f.RobustScale("c"), [5.0, 5.0]) == [0.0, 0.0]
    assert run(spark, f.MaxAbsScale("c"), [0.0, 0.0]) == [0.0, 0.0]


def test_log(spark):
    assert run(spark, f.LogTransform("c"), [0, 1, 2, 3, 100], "int") == pytest.approx([math.log(v + 1) for v in (0, 1, 2, 3, 100)])
    assert run(spark, f.LogTransform("c", 10), [1.0, 100.0]) == pytest.approx([0.0, 2.0])


def yeo_johnson(x, lam):
    up = np.log1p(np.maximum(x, 0)) if lam == 0 else ((np.maximum(x, 0) + 1) ** lam - 1) / lam
    return np.where(x >= 0, up, -((np.abs(np.minimum(x, 0)) + 1) ** (2 - lam) - 1) / (2 - lam))


@pytest.mark.parametrize("method", ["yeo-johnson", "box-cox"])
def test_power_maximises_the_likelihood(spark, method):
    rng = np.random.default_rng(3)
    x = rng.lognormal(1, 0.7, 400) if method == "box-cox" else rng.gamma(2, 2, 400) - 1.5

    def likelihood(lam):
        if method == "box-cox":
            return -len(x) / 2 * np.log(((x**lam - 1) / lam).var()) + (lam - 1) * np.log(x).sum()
        y = yeo_johnson(x, lam)
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    fitted = f.PowerTransform("c", method).fit(frame(spark, [float(v) for v in x]))
    lam = fitted.stats["lambda"]
    near = likelihood(lam)
    assert all(near >= likelihood(lam + d) for d in (-0.01, -1e-3, 1e-3, 0.01))
    y = (x**lam - 1) / lam if method == "box-cox" else yeo_johnson(x, lam)
    got = [r["c"] for r in fitted.transform(frame(spark, [float(v) for v in x])).orderBy("id").collect()]
    assert got == pytest.approx(list((y - y.mean()) / y.std()), abs=1e-6)


def test_box_cox_needs_positive_values(spark):
    with pytest.raises(ValueError):
        f.PowerTransform("c", "box-cox").run(frame(spark, [1.0, None]))


def test_quantile_transform(spark):
    x = np.random.default_rng(7).lognormal(0, 1, 300)
    refs = np.linspace(0, 1, 300)
    knots = np.quantile(x, refs)
    p = np.interp(x, knots, refs)
    values = [float(v) for v in x]
    assert run(spark, f.QuantileTransform("c", "uniform"), values) == pytest.approx(list(p), abs=1e-9)
    normal = run(spark, f.QuantileTransform("c"), values)
    edge = NormalDist().inv_cdf(1 - 1e-7)
    assert min(normal) == pytest.approx(-edge, abs=1e-6) and max(normal) == pytest.approx(edge, abs=1e-6)
    inner = [i for i in range(300) if 0 < p[i] < 1]
    assert [normal[i] for i in inner] == pytest.approx([NormalDist().inv_cdf(p[i]) for i in inner], abs=1e-6)


def test_binning(spark):
    x = [float(v) for v in range(10)]
    assert run(spark, f.Binning("c", 5), x, column="c_binned") == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert run(spark, f.Binning("c", 3, "uniform"), x, column="c_binned") == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    # equal edges collapse
    assert run(spark, f.Binning("c", 4), [1.0, 1.0, 1.0, 1.0, 2.0], column="c_binned") == [0, 0, 0, 0, 0]
    groups = [0.0, 0.1, 0.2, 5.0, 5.1, 9.8, 10.0]
    assert run(spark, f.Binning("c", 3, "kmeans"), groups, column="c_binned") == [0, 0, 0, 1, 1, 2, 2]


def test_interactions_and_polynomials(spark):
    df = spark.createDataFrame([(2.0, 3.0), (None, 4.0)], "a double, b double")
    out = f.InteractionFeatures([["a", "b"], ["a", "zz"], ["a"]]).run(df)
    assert [r["a_x_b"] for r in out.collect()] == [6.0, None]
    poly = f.PolynomialFeatures(["a", "b"]).run(df)
    assert poly.columns == ["a", "b", "a^2", "a b", "b^2"]
    assert [tuple(r)[2:] for r in poly.collect()] == [(4.0, 6.0, 9.0), (0.0, 0.0, 16.0)]
    assert f.PolynomialFeatures(["a", "b"], 2, True).run(df).columns == ["a", "b", "a b"]
    with pytest.raises(ValueError):
        f.PolynomialFeatures(["zz"]).run(df)


def test_selection(spark, people):
    assert "rooms" not in f.DropLowVariance(0.01).run(people).columns
    assert "street" not in f.DropHighCardinality(30).run(people).columns
    df = spark.createDataFrame([(float(i), float(i), float(5 - i)) for i in range(5)], "a double, b double, c double")
    assert f.DropCorrelated(0.95).run(df).columns == ["a"]
    with pytest.raises(ValueError):
        f.DropLowVariance(100.0).run(df)


@pytest.mark.parametrize("columns", [5, 13])
def test_correlations(spark, columns):
    rng = np.random.default_rng(0)
    data = rng.normal(1e6, 1, (200, columns))
    data[:, 3] = data[:, 0] * 2
    data[:, 4] = 7.0
    rows = [[None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(data)]
    names = [f"c{j}" for j in range(columns)]
    got = a.correlations(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3))
    assert len(got) == columns * (columns - 1) // 2
    for i in range(columns):
        for j in range(i + 1, columns):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            if 4 in (i, j):
                assert got[names[i], names[j]] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-6)


def test_analysis(people):
    rows = {r["column_name"]: r for r in a.analyze_columns(people, "income").collect()}
    x = np.array([r["years"] for r in people.collect()])
    n, z = len(x), (x - x.mean()) / x.std()
    assert rows["years"]["skewness"] == pytest.approx((z**3).mean() * math.sqrt(n * (n - 1)) / (n - 2), abs=1e-3)
    assert rows["street"]["unique_count"] > 30 and rows["street"]["type"] == "categorical"
    assert rows["rooms"]["coefficient_of_variation"] == 0.0
    assert rows["rooms"]["correlation_with_target"] is None
    assert [r["column_name"] for r in a.low_variance_columns(people).collect()] == ["rooms"]


def test_kmeans_bins_are_those_of_plain_rounds(spark):
    """Heavy tails, so that the first ranges hold many different values, and few jobs whatever the rounds."""
    x = np.sort(np.random.default_rng(5).lognormal(0, 2.5, 5000))
    edges = x[0] + (x[-1] - x[0]) / 6 * np.arange(7)
    centers, var = (edges[1:] + edges[:-1]) / 2, x.var()
    for _ in range(300):
        own = np.searchsorted((centers[1:] + centers[:-1]) / 2, x, side="left")
        moved = np.sort([x[own == k].mean() if (own == k).any() else c for k, c in enumerate(centers)])
        shift, centers = ((moved - centers) ** 2).sum(), moved
        if shift <= 1e-4 * var:
            break
    step = f.Binning("c", 6, "kmeans")
    sc = spark.sparkContext
    sc.setJobGroup("kmeans", "")
    got = step.fit(frame(spark, [float(v) for v in x])).stats["edges"]
    jobs = len(sc.statusTracker().getJobIdsForGroup("kmeans"))
    sc.setJobGroup("", "")
    assert got[1:-1] == pytest.approx(list((centers[1:] + centers[:-1]) / 2), rel=1e-9) and jobs <= 12
    assert f.Binning("c", 3, "kmeans").fit(frame(spark, [2.0, 2.0, None])).stats["edges"]
    assert f.Binning("c", 3, "kmeans").fit(frame(spark, [2.0, 2.0])).stats["edges"] == []
