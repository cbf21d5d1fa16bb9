"""Tables the registered queries run on, and the same tables as SQL.

The given tables are clean, so the messy ones are derived from all their rows by a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PRICE = """CASE o_orderkey % 23 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN '999' WHEN 3 THEN NULL
  WHEN 4 THEN 'twenty' ELSE concat('$', cast(cast(o_totalprice AS decimal(18,2)) AS {text})) END"""
_STATUS = """CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN lower(o_orderstatus)
  WHEN 2 THEN concat('  ', o_orderstatus, ' ') ELSE '-' END"""
_PRIORITY = """CASE o_orderkey % 5 WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN concat(' ', o_orderpriority)
  WHEN 3 THEN concat(o_orderpriority, '  ') ELSE o_orderpriority END"""
_FLAG = """CASE o_orderkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'f'
  WHEN 4 THEN '1' WHEN 5 THEN '0' WHEN 6 THEN 'y' WHEN 7 THEN ' n ' ELSE 'maybe' END"""
# every fiftieth order is there twice
_COPIES = "CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END"

MESSY_COLUMNS = ["order_id", "price_s", "status_s", "priority_s", "date_s"]


def messy_orders(spark: SparkSession, sf_dir: str, flag: bool = False) -> DataFrame:
    """Orders as messy text, with exact duplicates; ``row_id`` gives the order."""
    date = """CASE WHEN o_orderkey % 4 = 1 THEN date_format(o_orderdate, 'MM/dd/yyyy')
      WHEN o_orderkey % 4 = 2 THEN date_format(o_orderdate, 'MMM dd yyyy')
      WHEN o_orderkey % 4 = 3 AND day(o_orderdate) > 12 THEN date_format(o_orderdate, 'dd-MM-yyyy')
      ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"""
    exprs = [
        F.col("o_orderkey").alias("order_id"),
        F.expr(_PRICE.format(text="string")).alias("price_s"),
        F.expr(_STATUS).alias("status_s"),
        F.expr(_PRIORITY).alias("priority_s"),
        F.expr(date).alias("date_s"),
    ]
    if flag:
        exprs.append(F.expr(_FLAG).alias("flag_s"))
    orders = table(spark, sf_dir, "orders")
    copies = orders.select("*", F.explode(F.expr(f"sequence(1, {_COPIES})")).alias("copy"))
    return copies.select(*exprs, F.expr("o_orderkey * 2 + copy").cast("long").alias("row_id"))


MO = f"""mo AS (
  SELECT o_orderkey AS order_id, {_PRICE.format(text="varchar")} AS price_s, {_STATUS} AS status_s,
    {_PRIORITY} AS priority_s,
    CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%b %d %Y')
      WHEN o_orderkey % 4 = 3 AND day(o_orderdate) > 12 THEN strftime(o_orderdate, '%d-%m-%Y')
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_s,
    {_FLAG} AS flag_s, o_orderkey * 2 + copy AS row_id
  FROM (SELECT *, unnest(range(1, {_COPIES} + 1)) AS copy FROM orders))"""


_QTY = "CASE WHEN l_orderkey % 19 = 0 THEN NULL WHEN l_orderkey % 401 = 0 THEN l_quantity * 1000 ELSE l_quantity END"
_DISC = "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount END"
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def messy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with missing numbers and outliers."""
    li = table(spark, sf_dir, "lineitem")
    return li.selectExpr(
        *_KEYS.split(", "), f"{_QTY} AS qty", f"{_DISC} AS disc", "l_extendedprice", "l_tax",
        "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag END AS flag", "l_linestatus",
    )


ML = f"""ml AS (
  SELECT {_KEYS}, {_QTY} AS qty, {_DISC} AS disc, l_extendedprice, l_tax,
    CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag END AS flag, l_linestatus
  FROM lineitem)"""

# ---- SQL snippets ---------------------------------------------------------------

_MARKERS = "'N/A','NA','n/a','na','null','NULL','Null','none','None','NONE','','-','.','999','-999'"


def missing_sql(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) IN ({_MARKERS}))"


def present_sql(c: str) -> str:
    return f"(CASE WHEN NOT {missing_sql(c)} THEN trim({c}) END)"


def number_sql(c: str) -> str:
    clean = f"regexp_replace({c}, '[$,\\s]', '', 'g')"
    return (
        f"(CASE WHEN regexp_full_match({clean}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')"
        f" THEN TRY_CAST({clean} AS DOUBLE) END)"
    )


def date_sql(c: str) -> str:
    return f"try_strptime(trim({c}), ['%Y-%m-%d', '%m/%d/%Y', '%b %d %Y', '%d-%m-%Y'])"


def iqr_sql(source: str, x: str, name: str = "q") -> str:
    return (
        f"{name} AS (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2,"
        f" quantile_cont({x}, 0.75) AS q3 FROM {source})"
    )


def cells_sql(source: str, columns: list[str], name: str = "cells") -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {source}" for c in columns]
    return f"{name} AS ({' UNION ALL '.join(parts)})"
