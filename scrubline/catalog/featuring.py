"""Queries of the feature analysis and feature engineering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.catalog.tables import ML, iqr_sql, messy_lineitem, table
from scrubline.operators import analysis as a
from scrubline.operators import features as f

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(_KEY)


def lines(spark, sf):
    return table(spark, sf, "lineitem")


# ---- analysis -------------------------------------------------------------------


def _analyze_sql(c):
    x = f"CAST({c} AS DOUBLE)"
    return (
        f"SELECT '{c}' AS column_name, 'numeric' AS type, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, "
        f"round(count(DISTINCT {c}) / count(*), 4) AS cardinality_ratio, min({x}) AS min, max({x}) AS max, round(avg({x}), 2) AS mean, round(stddev_samp({x}), 2) AS std, "
        f"round(skewness({x}), 3) AS skewness, round(kurtosis({x}), 3) AS kurtosis, bool_or({x} < 0) AS has_negatives, bool_or({x} = 0) AS has_zeros, "
        f"round(abs(stddev_samp({x}) / avg({x})), 3) AS coefficient_of_variation, round(corr({x}, l_extendedprice), 3) AS correlation_with_target FROM lineitem"
    )


@query(
    "fe_analyze",
    " UNION ALL ".join(_analyze_sql(c) for c in ("l_quantity", "l_discount", "l_tax"))
    + " UNION ALL SELECT 'l_returnflag', 'categorical', count(*) - count(l_returnflag), count(DISTINCT l_returnflag), round(count(DISTINCT l_returnflag) / count(*), 4), "
    "NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem",
)
def fe_analyze(spark, sf):
    df = lines(spark, sf).select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    out = a.analyze_columns(df, "l_extendedprice").where("column_name <> 'l_extendedprice'")
    for name, digits in (("mean", 2), ("std", 2), ("skewness", 3), ("kurtosis", 3), ("coefficient_of_variation", 3), ("correlation_with_target", 3)):
        out = out.withColumn(name, F.round(name, digits))
    return out


@query(
    "fe_target_corr",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(corr({c}, l_extendedprice), 4) AS correlation FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
)
def fe_target_corr(spark, sf):
    out = a.target_correlation(lines(spark, sf).select(*_NUMBERS), "l_extendedprice")
    return out.withColumn("correlation", F.round("correlation", 4))


@query(
    "fe_top5",
    "WITH c AS (SELECT 'p_name' AS column_name, p_name AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY ALL "
    "UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) "
    "SELECT column_name, value, n, rank FROM r WHERE rank <= 5",
)
def fe_top5(spark, sf):
    return a.top_categories(table(spark, sf, "part"))


_WIDE = "l_quantity, l_quantity * 2 + 1 AS doubled, -l_quantity AS negated, l_extendedprice, l_discount, l_tax, 5.0::DOUBLE AS constant"


def wide(spark, sf):
    return lines(spark, sf).selectExpr(
        "l_quantity", "l_quantity * 2 + 1 AS doubled", "-l_quantity AS negated", "l_extendedprice", "l_discount", "l_tax",
        "cast(5.0 AS double) AS constant",
    )


@query(
    "fe_corr_pairs",
    f"WITH w AS (SELECT {_WIDE} FROM lineitem), p AS (SELECT 'l_quantity' AS col1, 'doubled' AS col2, abs(corr(l_quantity, doubled)) AS r FROM w UNION ALL "
    "SELECT 'l_quantity', 'negated', abs(corr(l_quantity, negated)) FROM w UNION ALL SELECT 'doubled', 'negated', abs(corr(doubled, negated)) FROM w UNION ALL "
    "SELECT 'l_quantity', 'l_extendedprice', abs(corr(l_quantity, l_extendedprice)) FROM w UNION ALL SELECT 'l_discount', 'l_tax', abs(corr(l_discount, l_tax)) FROM w) "
    "SELECT col1, col2, round(r, 4) AS correlation FROM p WHERE r > 0.9",
)
def fe_corr_pairs(spark, sf):
    return a.correlated_pairs(wide(spark, sf))


@query("fe_low_variance", f"WITH w AS (SELECT {_WIDE} FROM lineitem) SELECT 'constant' AS column_name, round(stddev_samp(constant) / (abs(avg(constant)) + 1e-9), 6) AS relative_std FROM w HAVING stddev_samp(constant) / (abs(avg(constant)) + 1e-9) < 0.01")
def fe_low_variance(spark, sf):
    return a.low_variance_columns(wide(spark, sf)).withColumn("relative_std", F.round("relative_std", 6))


# ---- encoding -------------------------------------------------------------------


@query(
    "one_hot",
    f"WITH {ML} SELECT {_K}, CAST(coalesce(flag = 'N', FALSE) AS INTEGER) AS \"flag_N\", CAST(coalesce(flag = 'R', FALSE) AS INTEGER) AS \"flag_R\" FROM ml",
)
def one_hot(spark, sf):
    return f.OneHotEncode("flag").run(messy_lineitem(spark, sf).select(*_KEY, "flag"))


@query("label_encode", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS p_name FROM part")
def label_encode(spark, sf):
    return f.LabelEncode("p_name").run(table(spark, sf, "part").select("p_partkey", "p_name"))


@query("label_encode_order", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE -1 END AS o_orderstatus FROM orders")
def label_encode_order(spark, sf):
    return f.LabelEncode("o_orderstatus", ["O", "P"]).run(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))


@query("ordinal_encode", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment FROM customer")
def ordinal_encode(spark, sf):
    return f.OrdinalEncode("c_mktsegment").run(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))


@query(
    "ordinal_encode_mapping",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 5 ELSE -1 END AS o_orderpriority FROM orders",
)
def ordinal_encode_mapping(spark, sf):
    step = f.OrdinalEncode("o_orderpriority", {"1-URGENT": 10, "2-HIGH": 5})
    return step.run(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"))


@query(
    "target_encode",
    f"WITH {ML}, g AS (SELECT avg(l_extendedprice) AS m FROM ml), t AS (SELECT flag, (count(l_extendedprice) * avg(l_extendedprice) + 1.0 * any_value(m)) / (count(l_extendedprice) + 1.0) AS code FROM ml, g WHERE flag IS NOT NULL GROUP BY flag) "
    f"SELECT {', '.join('ml.' + k for k in _KEY)}, round(coalesce(code, m), 2) AS flag FROM ml CROSS JOIN g LEFT JOIN t USING (flag)",
)
def target_encode(spark, sf):
    out = f.TargetEncode("flag", "l_extendedprice").run(messy_lineitem(spark, sf))
    return out.select(*_KEY, F.round("flag", 2).alias("flag"))


@query("frequency_encode", f"WITH {ML}, t AS (SELECT flag, count(*) AS n FROM ml WHERE flag IS NOT NULL GROUP BY flag) SELECT {', '.join('ml.' + k for k in _KEY)}, n AS flag FROM ml LEFT JOIN t USING (flag)")
def frequency_encode(spark, sf):
    return f.FrequencyEncode("flag").run(messy_lineitem(spark, sf)).select(*_KEY, "flag")


@query("frequency_encode_customers", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_orderkey, n AS o_custkey FROM orders JOIN t USING (o_custkey)")
def frequency_encode_customers(spark, sf):
    """A high-cardinality key: the table is staged and joined by shuffle once it is large."""
    return f.FrequencyEncode("o_custkey").run(table(spark, sf, "orders").select("o_orderkey", "o_custkey"))


# ---- scaling --------------------------------------------------------------------


def _scaled(name, step, sql, setup=""):
    def run(spark, sf):
        out = step.run(messy_lineitem(spark, sf))
        return out.select(*_KEY, F.round("qty", 5).alias("qty"))

    query(name, f"WITH {ML}, z AS (SELECT {_K}, coalesce(qty, 0) AS x FROM ml){setup} SELECT {_K}, round({sql}, 5) AS qty FROM z")(run)


def _one(expr):
    return f"(SELECT {expr} FROM z)"


_scaled("min_max", f.MinMaxScale("qty"), f"(x - {_one('min(x)')}) / ({_one('max(x)')} - {_one('min(x)')})")
_scaled("min_max_range", f.MinMaxScale("qty", [-1, 1]), f"(x - {_one('min(x)')}) / ({_one('max(x)')} - {_one('min(x)')}) * 2 - 1")
_scaled("standard_scale", f.StandardScale("qty"), f"(x - {_one('avg(x)')}) / {_one('stddev_pop(x)')}")
_scaled("robust_scale", f.RobustScale("qty"), "(x - (SELECT q2 FROM q)) / (SELECT q3 - q1 FROM q)", f", {iqr_sql('z', 'x')}")
_scaled("max_abs", f.MaxAbsScale("qty"), f"x / {_one('max(abs(x))')}")
_scaled("log_transform", f.LogTransform("qty"), f"ln(x + CASE WHEN {_one('min(x)')} <= 0 THEN abs({_one('min(x)')}) + 1 ELSE 0 END)")


@query("log_transform_base10", "SELECT c_custkey, round(log10(c_acctbal + CASE WHEN (SELECT min(c_acctbal) FROM customer) <= 0 THEN abs((SELECT min(c_acctbal) FROM customer)) + 1 ELSE 0 END), 6) AS c_acctbal FROM customer")
def log_transform_base10(spark, sf):
    out = f.LogTransform("c_acctbal", 10).run(table(spark, sf, "customer"))
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("power_yj")
def power_yj(spark, sf):
    out = f.PowerTransform("value").run(table(spark, sf, "events").select("event_id", "value"))
    return out.select("event_id", F.round("value", 4).alias("value"))


@query("power_boxcox")
def power_boxcox(spark, sf):
    out = f.PowerTransform("l_extendedprice", "box-cox").run(lines(spark, sf))
    return out.select(*_KEY, F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("quantile_uniform")
def quantile_uniform(spark, sf):
    out = f.QuantileTransform("value", "uniform").run(table(spark, sf, "events").select("event_id", "value"))
    return out.select("event_id", F.round("value", 5).alias("value"))


@query("quantile_normal")
def quantile_normal(spark, sf):
    out = f.QuantileTransform("value").run(table(spark, sf, "events").select("event_id", "value"))
    return out.select("event_id", F.round("value", 5).alias("value"))


# ---- binning --------------------------------------------------------------------


def _bins_sql(edges):
    return " + ".join(f"CASE WHEN value >= {e} THEN 1 ELSE 0 END" for e in edges)


@query(
    "bin_quantile",
    "WITH e AS (SELECT quantile_cont(value, 0.2) AS e1, quantile_cont(value, 0.4) AS e2, quantile_cont(value, 0.6) AS e3, quantile_cont(value, 0.8) AS e4 FROM events) "
    f"SELECT event_id, value, CAST({_bins_sql(['e1', 'e2', 'e3', 'e4'])} AS INTEGER) AS value_binned FROM events, e",
)
def bin_quantile(spark, sf):
    return f.Binning("value").run(table(spark, sf, "events").select("event_id", "value"))


@query(
    "bin_uniform",
    "WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS w FROM events) "
    f"SELECT event_id, value, CAST({_bins_sql([f'lo + w * {i}' for i in range(1, 5)])} AS INTEGER) AS value_binned FROM events, e",
)
def bin_uniform(spark, sf):
    return f.Binning("value", 5, "uniform").run(table(spark, sf, "events").select("event_id", "value"))


@query(
    "bin_kmeans",
    "WITH RECURSIVE s AS (SELECT min(coalesce(value, 0)) AS lo, max(coalesce(value, 0)) AS hi, var_pop(coalesce(value, 0)) AS var, list(coalesce(value, 0)) AS xs FROM events), "
    "step(i, c, moved) AS (SELECT 0, list_transform(range(4), lambda k: lo + (hi - lo) / 4 * (k + 0.5::DOUBLE)), NULL::DOUBLE FROM s "
    "UNION ALL SELECT i + 1, new, list_sum(list_transform(range(1, 5), lambda k: (new[k] - c[k]) ** 2)) FROM (SELECT i, c, list_sort(list_transform(range(1, 5), lambda k: "
    "coalesce(list_avg(list_filter(xs, lambda x: (k = 1 OR x > (c[k - 1] + c[k]) / 2) AND (k = 4 OR x <= (c[k] + c[k + 1]) / 2))), c[k]))) AS new "
    "FROM step, s WHERE (moved IS NULL OR moved > 1e-4 * var) AND i < 300)), "
    "e AS (SELECT (c[1] + c[2]) / 2 AS e1, (c[2] + c[3]) / 2 AS e2, (c[3] + c[4]) / 2 AS e3 FROM step ORDER BY i DESC LIMIT 1) "
    f"SELECT event_id, value, CAST({_bins_sql(['e1', 'e2', 'e3'])} AS INTEGER) AS value_binned FROM events, e",
)
def bin_kmeans(spark, sf):
    return f.Binning("value", 4, "kmeans").run(table(spark, sf, "events").select("event_id", "value"))


# ---- creation and selection -----------------------------------------------------


@query("interactions", f"WITH {ML} SELECT {_K}, qty * disc AS qty_x_disc, l_extendedprice * l_tax AS l_extendedprice_x_l_tax FROM ml")
def interactions(spark, sf):
    step = f.InteractionFeatures([["qty", "disc"], ["l_extendedprice", "l_tax"], ["qty", "absent"], ["qty"]])
    return step.run(messy_lineitem(spark, sf)).select(*_KEY, "qty_x_disc", "l_extendedprice_x_l_tax")


@query(
    "polynomial",
    f'WITH {ML}, z AS (SELECT *, coalesce(qty, 0) AS a, coalesce(disc, 0) AS b FROM ml) SELECT {_K}, a * a AS "qty^2", a * b AS "qty disc", b * b AS "disc^2" FROM z',
)
def polynomial(spark, sf):
    out = f.PolynomialFeatures(["qty", "disc"]).run(messy_lineitem(spark, sf))
    return out.select(*_KEY, "`qty^2`", "`qty disc`", "`disc^2`")


@query("polynomial_interactions", f'WITH {ML} SELECT {_K}, coalesce(qty, 0) * coalesce(disc, 0) * l_tax AS "qty disc l_tax" FROM ml')
def polynomial_interactions(spark, sf):
    out = f.PolynomialFeatures(["qty", "disc", "l_tax"], 3, interaction_only=True).run(messy_lineitem(spark, sf))
    return out.select(*_KEY, "`qty disc l_tax`")


@query("drop_low_variance", "SELECT l_quantity, l_quantity * 2 + 1 AS doubled, -l_quantity AS negated, l_extendedprice FROM lineitem")
def drop_low_variance(spark, sf):
    return f.DropLowVariance(0.01).run(wide(spark, sf))


@query("drop_high_cardinality", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def drop_high_cardinality(spark, sf):
    return f.DropHighCardinality(50).run(table(spark, sf, "part"))


@query("drop_correlated", "SELECT l_quantity, l_extendedprice, l_discount, l_tax, 5.0::DOUBLE AS constant FROM lineitem")
def drop_correlated(spark, sf):
    return f.DropCorrelated(0.95).run(wide(spark, sf))
