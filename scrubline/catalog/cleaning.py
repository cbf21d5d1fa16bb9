"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.catalog.lcs_sql import RATIOS, groups_sql, mapping_sql, token_sorted_sql
from scrubline.catalog.tables import (
    ML,
    MO,
    date_sql,
    iqr_sql,
    messy_lineitem,
    messy_orders,
    missing_sql,
    number_sql,
    present_sql,
    table,
)
from scrubline.functions.missing import is_missing
from scrubline.functions.numbers import to_double
from scrubline.operators import cleaning as c
from scrubline.operators.dedup import duplicate_count, exact_duplicate_groups, remove_exact_duplicates
from scrubline.operators.fill import FillDirection
from scrubline.operators.quantiles import exact_quantiles
from scrubline.operators.similarity import (
    AutoStandardize,
    RemoveFuzzyDuplicates,
    category_mapping,
    fuzzy_duplicate_groups,
    similarity,
    token_sort_similarity,
)

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _orders_cell(name, step, column, sql, flag=False):
    def run(spark, sf):
        return step.run(messy_orders(spark, sf, flag)).select("row_id", column)

    query(name, f"WITH {MO} SELECT row_id, {sql} AS {column} FROM mo")(run)


_TITLE = """array_to_string(list_transform(range(1, length(priority_s) + 1), lambda i:
  CASE WHEN i = 1 OR NOT regexp_matches(substr(priority_s, i - 1, 1), '[A-Za-z]')
  THEN upper(substr(priority_s, i, 1)) ELSE lower(substr(priority_s, i, 1)) END), '')"""

_orders_cell("trim_whitespace", c.TrimWhitespace("status_s"), "status_s", "trim(status_s)")
_orders_cell("normalize_case_lower", c.NormalizeCase("priority_s", "lower"), "priority_s", "lower(priority_s)")
_orders_cell("normalize_case_upper", c.NormalizeCase("priority_s", "upper"), "priority_s", "upper(priority_s)")
_orders_cell("normalize_case_title", c.NormalizeCase("priority_s", "title"), "priority_s", _TITLE)
_orders_cell("convert_numeric", c.ConvertType("price_s", "float", ["$", ","]), "price_s", number_sql("price_s"))
_orders_cell("convert_int", c.ConvertType("price_s", "int"), "price_s", f"CAST(round_even({number_sql('price_s')}, 0) AS BIGINT)")
_orders_cell(
    "convert_bool", c.ConvertType("flag_s", "bool"), "flag_s",
    "CASE WHEN lower(trim(flag_s)) IN ('true','yes','1','t','y') THEN TRUE "
    "WHEN lower(trim(flag_s)) IN ('false','no','0','f','n') THEN FALSE END", flag=True,
)
_orders_cell("convert_str", c.ConvertType("price_s", "str", ["$"]), "price_s", "replace(trim(price_s), '$', '')")
_orders_cell("parse_dates", c.ParseDates("date_s"), "date_s", f"strftime({date_sql('date_s')}, '%Y-%m-%d')")
_orders_cell("standardize_missing", c.StandardizeMissing("price_s"), "price_s", present_sql("price_s"))
_orders_cell("fill_constant", c.FillConstant("price_s", "unknown"), "price_s", f"coalesce({present_sql('price_s')}, 'unknown')")
_orders_cell(
    "map_categories",
    c.MapCategories("priority_s", {"1-urgent": "URGENT", "1-URGENT": "URGENT", "2-high": "HIGH", "2-HIGH": "HIGH"}),
    "priority_s",
    "CASE WHEN lower(trim(priority_s)) = '1-urgent' THEN 'URGENT' WHEN lower(trim(priority_s)) = '2-high' THEN 'HIGH' ELSE trim(priority_s) END",
)


@query("fix_encoding", "SELECT doc_id, md5(text) AS repaired, md5(text) AS untouched FROM documents")
def fix_encoding(spark, sf):
    """Every document is garbled (UTF-8 read as Latin-1), then repaired; good text must stay."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("garbled")
    )
    fixed = c.FixEncoding("text").run(c.FixEncoding("garbled").run(docs))
    return fixed.select("doc_id", F.md5("garbled").alias("repaired"), F.md5("text").alias("untouched"))


@query("rename_column", "SELECT n_nationkey, n_name AS nation, n_regionkey FROM nation")
def rename_column(spark, sf):
    return c.RenameColumn("n_name", "nation").run(table(spark, sf, "nation"))


@query("drop_column", f"WITH {MO} SELECT order_id, price_s, status_s, priority_s, row_id FROM mo")
def drop_column(spark, sf):
    return c.DropColumn("no_such_column").run(c.DropColumn("date_s").run(messy_orders(spark, sf)))


@query("missing_filter", f"WITH {MO} SELECT row_id, price_s FROM mo WHERE {missing_sql('price_s')}")
def missing_filter(spark, sf):
    return messy_orders(spark, sf).where(is_missing(F.col("price_s"))).select("row_id", "price_s")


@query(
    "coerce_numeric",
    f"WITH {MO} SELECT row_id, {number_sql('price_s')} AS stripped, "
    "CASE WHEN regexp_full_match(trim(price_s), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST(price_s AS DOUBLE) END AS bare FROM mo",
)
def coerce_numeric(spark, sf):
    price = F.col("price_s")
    return messy_orders(spark, sf).select("row_id", to_double(price, True).alias("stripped"), to_double(price).alias("bare"))


# ---- missing values -------------------------------------------------------------

_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _line_keys():
    return [x.strip() for x in _K.split(",")]


@query("fill_mean", f"WITH {ML} SELECT {_K}, round(coalesce(qty, (SELECT avg(qty) FROM ml)), 4) AS qty FROM ml")
def fill_mean(spark, sf):
    out = c.fill_step("qty", "mean").run(messy_lineitem(spark, sf))
    return out.select(*_line_keys(), F.round("qty", 4).alias("qty"))


@query(
    "fill_mean_text",
    f"WITH {MO}, x AS (SELECT row_id, CASE WHEN NOT {missing_sql('price_s')} THEN {number_sql('price_s')} END AS price FROM mo) "
    "SELECT row_id, round(coalesce(price, (SELECT avg(price) FROM x)), 4) AS price_s FROM x",
)
def fill_mean_text(spark, sf):
    """Prices as text, with ``twenty`` filled like a missing cell."""
    out = c.fill_step("price_s", "mean", text_cells="fill").run(messy_orders(spark, sf))
    return out.select("row_id", F.round("price_s", 4).alias("price_s"))


@query(
    "fill_median_text",
    f"WITH {MO}, x AS (SELECT row_id, CASE WHEN NOT {missing_sql('price_s')} THEN {number_sql('price_s')} END AS price FROM mo) "
    "SELECT row_id, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM x)) AS price_s FROM x",
)
def fill_median_text(spark, sf):
    return c.fill_step("price_s", "median", text_cells="fill").run(messy_orders(spark, sf)).select("row_id", "price_s")


@query("fill_median", f"WITH {ML} SELECT {_K}, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM ml)) AS qty FROM ml")
def fill_median(spark, sf):
    return c.fill_step("qty", "median").run(messy_lineitem(spark, sf)).select(*_line_keys(), "qty")


@query(
    "fill_mode",
    f"WITH {ML}, m AS (SELECT flag FROM ml WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1) "
    f"SELECT {_K}, coalesce(flag, (SELECT flag FROM m)) AS flag FROM ml",
)
def fill_mode(spark, sf):
    return c.fill_step("flag", "mode").run(messy_lineitem(spark, sf)).select(*_line_keys(), "flag")


def _carry_sql(fn, frame):
    return f"WITH {ML} SELECT {_K}, {fn}(disc IGNORE NULLS) OVER (ORDER BY {_K} ROWS BETWEEN {frame}) AS disc FROM ml"


@query("fill_ffill", _carry_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def fill_ffill(spark, sf):
    return FillDirection("disc", "ffill", _line_keys()).run(messy_lineitem(spark, sf)).select(*_line_keys(), "disc")


@query("fill_bfill", _carry_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def fill_bfill(spark, sf):
    return FillDirection("disc", "bfill", _line_keys()).run(messy_lineitem(spark, sf)).select(*_line_keys(), "disc")


@query(
    "fill_ffill_by_group",
    f"WITH {ML} SELECT {_K}, last_value(disc IGNORE NULLS) OVER (PARTITION BY l_linestatus ORDER BY {_K} "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS disc FROM ml",
)
def fill_ffill_by_group(spark, sf):
    step = FillDirection("disc", "ffill", _line_keys(), ["l_linestatus"])
    return step.run(messy_lineitem(spark, sf)).select(*_line_keys(), "disc")


@query("fill_drop", f"WITH {ML} SELECT {_K}, flag FROM ml WHERE flag IS NOT NULL")
def fill_drop(spark, sf):
    return c.fill_step("flag", "drop").run(messy_lineitem(spark, sf)).select(*_line_keys(), "flag")


# ---- outliers -------------------------------------------------------------------

_BOUNDS = f"{ML}, {iqr_sql('ml', 'qty')}, b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"


@query("iqr_bounds", f"WITH {ML}, {iqr_sql('ml', 'qty')} SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q")
def iqr_bounds(spark, sf):
    q1, q3 = exact_quantiles(messy_lineitem(spark, sf), {"qty": (F.col("qty"), [0.25, 0.75])})["qty"]
    k = 1.5 * (q3 - q1)
    return spark.createDataFrame([(q1, q3, q1 - k, q3 + k)], "q1 double, q3 double, lower double, upper double")


def _outliers(action):
    def run(spark, sf):
        return c.HandleOutliers("qty", action).run(messy_lineitem(spark, sf)).select(*_line_keys(), "qty")

    return run


query("outlier_cap", f"WITH {_BOUNDS} SELECT {_K}, CASE WHEN qty < lo THEN lo WHEN qty > hi THEN hi ELSE qty END AS qty FROM ml, b")(_outliers("cap"))
query("outlier_remove", f"WITH {_BOUNDS} SELECT {_K}, qty FROM ml, b WHERE qty IS NULL OR qty BETWEEN lo AND hi")(_outliers("remove"))
query("outlier_flag", f"WITH {_BOUNDS} SELECT {_K}, CASE WHEN qty BETWEEN lo AND hi THEN qty END AS qty FROM ml, b")(_outliers("flag"))

# ---- duplicates -----------------------------------------------------------------

_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _dedup_sql(direction):
    order = ", ".join(f"{x.strip()} {direction}" for x in _ORDER.split(","))
    return (
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1"
    )


def _dedup(keep):
    def run(spark, sf):
        rows = table(spark, sf, "lineitem")
        kept = remove_exact_duplicates(rows, keep, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
        return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")

    return run


query("dedup_last", _dedup_sql("DESC"))(_dedup("last"))
query("dedup_first", _dedup_sql("ASC"))(_dedup("first"))
query(
    "dedup_none",
    "SELECT l_orderkey, l_linenumber, any_value(l_partkey) AS l_partkey, any_value(l_suppkey) AS l_suppkey, "
    "any_value(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL HAVING count(*) = 1".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber"),
)(_dedup("none"))

_BODY = "order_id, price_s, status_s, priority_s, date_s"


@query("dedup_all_columns", f"WITH {MO} SELECT {_BODY}, min(row_id) AS row_id FROM mo GROUP BY {_BODY}")
def dedup_all_columns(spark, sf):
    return remove_exact_duplicates(messy_orders(spark, sf), "first", order_by="row_id")


@query(
    "dup_groups",
    f"WITH {MO}, g AS (SELECT row_id, min(row_id) OVER w AS group_id, count(*) OVER w AS n FROM mo WINDOW w AS (PARTITION BY {_BODY})) "
    "SELECT group_id, row_id, n FROM g WHERE n > 1",
)
def dup_groups(spark, sf):
    return exact_duplicate_groups(messy_orders(spark, sf), "row_id")


@query(
    "dup_groups_documents",
    "SELECT group_id, row_id, n FROM (SELECT doc_id AS row_id, min(doc_id) OVER w AS group_id, count(*) OVER w AS n "
    "FROM documents WINDOW w AS (PARTITION BY text)) WHERE n > 1",
)
def dup_groups_documents(spark, sf):
    return exact_duplicate_groups(table(spark, sf, "documents"), "doc_id", ["text"])


@query(
    "dup_count",
    f"WITH {MO}, g AS (SELECT count(*) AS n FROM mo GROUP BY {_BODY}) SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS rows_in_groups, "
    "CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM g",
)
def dup_count(spark, sf):
    return duplicate_count(messy_orders(spark, sf), ("row_id",))


# ---- similarity (checked against brute force in the tests) -----------------------


# copies differ by blanks or by case only, so the common subsequence is known
_RATIO = """CAST(round_even(CASE o_orderkey % 5
  WHEN 1 THEN 100.0 * length(regexp_replace(o_orderpriority, '[A-Z]', '', 'g')) / length(o_orderpriority)
  WHEN 2 THEN 200.0 * length(o_orderpriority) / (2 * length(o_orderpriority) + 1)
  WHEN 3 THEN 200.0 * length(o_orderpriority) / (2 * length(o_orderpriority) + 2) ELSE 100 END, 0) AS INTEGER)"""


@query("similarity_ratio", f"WITH {MO} SELECT row_id, {_RATIO} AS similarity FROM mo JOIN orders ON order_id = o_orderkey")
def similarity_ratio(spark, sf):
    """Each order priority as entered against its official spelling."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    entered = messy_orders(spark, sf).select("row_id", "order_id", "priority_s")
    both = entered.join(orders, entered["order_id"] == orders["o_orderkey"])
    return both.select("row_id", similarity(F.col("priority_s"), F.col("o_orderpriority")).alias("similarity"))


@query("similarity_tokens", "SELECT p_partkey, 100 AS similarity FROM part")
def similarity_tokens(spark, sf):
    """Part names against themselves with the words turned round."""
    name = F.col("p_name")
    turned = F.upper(F.array_join(F.reverse(F.split(name, " ")), ", "))
    return table(spark, sf, "part").select("p_partkey", token_sort_similarity(name, turned).alias("similarity"))


@query(
    "similarity_tokens_kinds",
    f"WITH pairs AS (SELECT p_partkey AS id, {token_sorted_sql('p_name')} AS sa, {token_sorted_sql("p_type || '-' || p_brand || ' ' || p_name")} AS sb FROM part), "
    f"{RATIOS} SELECT id AS p_partkey, similarity FROM ratios",
)
def similarity_tokens_kinds(spark, sf):
    """Part names against their kind, brand and name in another order."""
    described = F.concat("p_type", F.lit("-"), "p_brand", F.lit(" "), "p_name")
    return table(spark, sf, "part").select("p_partkey", token_sort_similarity(F.col("p_name"), described).alias("similarity"))


@query(
    "fuzzy_dup_groups",
    groups_sql("part", "p_partkey", "p_name || ' ' || p_brand || ' ' || p_type") + " SELECT leader_id, member_id, similarity FROM members",
)
def fuzzy_dup_groups(spark, sf):
    return fuzzy_duplicate_groups(table(spark, sf, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


@query(
    "fuzzy_dedup",
    groups_sql("customer", "c_custkey", "c_name || ' ' || c_mktsegment")
    + " SELECT * FROM customer WHERE c_custkey NOT IN (SELECT member_id FROM members)",
)
def fuzzy_dedup(spark, sf):
    return RemoveFuzzyDuplicates("c_custkey").run(table(spark, sf, "customer"))


@query("auto_standardize", f"WITH {MO} SELECT row_id, upper(trim(priority_s)) AS priority_s FROM mo")
def auto_standardize(spark, sf):
    return AutoStandardize("priority_s").run(messy_orders(spark, sf)).select("row_id", "priority_s")


@query("category_variants", mapping_sql("part", "p_name"))
def category_variants(spark, sf):
    mapping = category_mapping(table(spark, sf, "part"), "p_name")
    return mapping.select("raw", "canonical", "similarity", "n")
