"""Queries of plans, audit, sources, sinks and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from scrubline.catalog.tables import (
    MESSY_COLUMNS,
    MO,
    date_sql,
    messy_orders,
    missing_sql,
    number_sql,
    present_sql,
    table,
)
from scrubline.functions.missing import is_missing_cell
from scrubline.operators.cleaning import ConvertType, NormalizeCase, TrimWhitespace
from scrubline.operators.features import StandardScale
from scrubline.operators.validate import validate
from scrubline.plans import audit
from scrubline.plans.actions import Action, Plan
from scrubline.plans.execute import run_plan
from scrubline.plans.prepare import prepare, prepare_path, propose
from scrubline.plans.recommend import recommend_features
from scrubline.session import shared_path, stage_table
from scrubline.sources import readers, sinks
from scrubline.streaming.steps import deduplicate_stream, drain, transform_stream

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


# ---- cleaning plans -------------------------------------------------------------

PLAN = Plan(
    [
        Action("action_001", "trim_whitespace", "priority_s", reason="blanks", priority="medium"),
        Action("action_002", "normalize_case", "priority_s", {"case": "upper"}, priority="low"),
        Action("action_003", "convert_type", "price_s", {"target_type": "float", "remove_chars": ["$", ","]}, priority="high"),
        Action("action_004", "parse_dates", "date_s", {"target_format": "%Y-%m-%d"}, priority="high"),
        Action("action_005", "fill_missing", "price_s", {"strategy": "median"}, priority="high"),
        Action("action_006", "fill_missing", "status_s", {"strategy": "mode"}, priority="medium"),
        Action("action_007", "handle_outlier", "price_s", {"action": "cap"}, priority="medium"),
        Action("action_008", "rename_column", "date_s", {"new_name": "order_date"}, priority="low", approved=False),
        Action("action_009", "drop_column", "absent", priority="low"),
        Action("action_010", "remove_duplicates", None, {"keep": "first"}, priority="high"),
    ],
    estimated_rows_affected=4200,
)
# 999 is the text of a missing price; as a number it is a value like any other
_PRICES = f"{MO}, p AS (SELECT *, {number_sql('price_s')} AS price FROM mo), med AS (SELECT quantile_cont(price, 0.5) AS m FROM p), "
_FILLED = _PRICES + (
    "md AS (SELECT trim(status_s) AS s FROM p WHERE trim(status_s) <> '-' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
    "f AS (SELECT row_id, order_id, coalesce(price, m) AS price, CASE WHEN trim(status_s) = '-' THEN (SELECT s FROM md) ELSE trim(status_s) END AS status, "
    f"upper(trim(priority_s)) AS priority, strftime({date_sql('date_s')}, '%Y-%m-%d') AS d FROM p, med), "
    "q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM f), "
    "b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q), "
    "c AS (SELECT row_id, order_id, least(greatest(price, lo), hi) AS price, status, priority, d, price < lo OR price > hi AS out FROM f, b)"
)


def _run(spark, sf):
    return run_plan(messy_orders(spark, sf), PLAN, "row_id", staged=True)


@query(
    "run_plan",
    f"WITH {_FILLED} SELECT order_id, round(price, 4) AS price_s, status AS status_s, priority AS priority_s, d AS date_s, min(row_id) AS row_id "
    "FROM c GROUP BY order_id, price, status, priority, d",
)
def run_plan_query(spark, sf):
    return _run(spark, sf).df.withColumn("price_s", F.round("price_s", 4))


@query(
    "run_plan_log",
    f"WITH {_FILLED}, l AS (SELECT 'action_001' AS action_id, 'succeeded' AS status, (SELECT count(*) FROM mo WHERE priority_s <> trim(priority_s)) AS n UNION ALL "
    "SELECT 'action_002', 'succeeded', (SELECT count(*) FROM mo WHERE trim(priority_s) <> upper(trim(priority_s))) UNION ALL "
    "SELECT 'action_003', 'succeeded', (SELECT count(*) FROM mo WHERE TRY_CAST(price_s AS DOUBLE) IS NULL AND price_s IS NOT NULL) UNION ALL "
    "SELECT 'action_004', 'succeeded', (SELECT count(*) FROM p JOIN f USING (row_id) WHERE p.date_s <> f.d) UNION ALL "
    "SELECT 'action_005', 'succeeded', (SELECT count(*) FROM p WHERE price IS NULL) UNION ALL "
    "SELECT 'action_006', 'succeeded', (SELECT count(*) FROM p JOIN f USING (row_id) WHERE p.status_s <> f.status) UNION ALL "
    "SELECT 'action_007', 'succeeded', (SELECT count(*) FROM c WHERE out) UNION ALL "
    "SELECT 'action_009', 'skipped', 0 UNION ALL SELECT 'action_010', 'succeeded', (SELECT count(*) - count(DISTINCT order_id) FROM c)) "
    "SELECT action_id, status, CAST(n AS BIGINT) AS rows_affected FROM l",
)
def run_plan_log(spark, sf):
    return _run(spark, sf).log(samples=False).select("action_id", "status", "rows_affected")


def _firsts(column: str, source: str) -> str:
    return f"(SELECT string_agg(v, '|' ORDER BY row_id) FROM (SELECT row_id, {column} AS v FROM {source} WHERE {column} IS NOT NULL ORDER BY row_id LIMIT 3))"


@query(
    "run_plan_samples",
    f"WITH {_FILLED} SELECT 'action_001' AS action_id, {_firsts('priority_s', 'mo')} AS before_sample, {_firsts('trim(priority_s)', 'mo')} AS after_sample UNION ALL "
    f"SELECT 'action_002', {_firsts('trim(priority_s)', 'mo')}, {_firsts('upper(trim(priority_s))', 'mo')} UNION ALL "
    f"SELECT 'action_004', {_firsts('date_s', 'mo')}, {_firsts('d', 'f')} UNION ALL SELECT 'action_006', {_firsts('status_s', 'mo')}, {_firsts('status', 'f')}",
)
def run_plan_samples(spark, sf):
    """The first cells before and after the actions on text."""
    log = _run(spark, sf).log().where("action_id in ('action_001', 'action_002', 'action_004', 'action_006')")
    joined = [F.array_join(c, "|").alias(c) for c in ("before_sample", "after_sample")]
    return log.select("action_id", *joined)


@query(
    "plan_summary",
    f"""WITH {MO}, p AS (SELECT count(*) FILTER (WHERE {missing_sql('price_s')}) AS gaps, count(*) FILTER (WHERE status_s <> trim(status_s)) AS blanks,
      count(*) - count(DISTINCT order_id) AS copies FROM mo)
    SELECT CAST((gaps > 0)::INT + (blanks > 0)::INT + (copies > 0)::INT AS BIGINT) AS total_actions, CAST((gaps > 0)::INT + (copies > 0)::INT AS BIGINT) AS approved_actions,
      CAST((copies > 0)::INT AS BIGINT) AS high_priority, gaps + copies AS estimated_rows FROM p""",
)
def plan_summary(spark, sf):
    """A plan made from what the table holds: only faults that occur get an action."""
    df = messy_orders(spark, sf)
    facts = df.agg(
        F.count_if(is_missing_cell(df, "price_s")).alias("gaps"), F.count_if(F.col("status_s") != F.trim("status_s")).alias("blanks"),
        (F.count("*") - F.count_distinct("order_id")).alias("copies"),
    ).first()
    found = [
        (facts["gaps"], Action("gaps", "fill_missing", "price_s", {"strategy": "mode"}, priority="medium")),
        (facts["blanks"], Action("blanks", "trim_whitespace", "status_s", priority="low", approved=False)),
        (facts["copies"], Action("copies", "remove_duplicates", None, {"keep": "first"}, priority="high")),
    ]
    plan = Plan([a for n, a in found if n], estimated_rows_affected=facts["gaps"] + facts["copies"])
    return plan.summary(spark)


@query("plan_filter", f"WITH {MO} SELECT row_id, coalesce({present_sql('price_s')}, '0') AS price_s, status_s FROM mo")
def plan_filter(spark, sf):
    """A plan read from JSON, reviewed (one action rejected, one edited), then run."""
    plan = Plan.from_json(
        json.dumps(
            {
                "actions": [
                    {"id": "a", "action_type": "trim_whitespace", "column_name": "status_s"},
                    {"id": "b", "action_type": "fill_missing", "column_name": "price_s", "parameters": {"strategy": "mode"}},
                    {"id": "c", "action_type": "no_such_action"},
                ]
            }
        )
    )
    plan = plan.reject("a").edit("b", strategy="custom", value="0")
    return run_plan(messy_orders(spark, sf), plan, "row_id").df.select("row_id", "price_s", "status_s")


@query("recommend_cleaning")
def recommend_cleaning(spark, sf):
    _, plan = propose(messy_orders(spark, sf), "row_id")
    return plan.rows(spark)


@query("prepare_run")
def prepare_run(spark, sf):
    """Profile, plan, clean and validate; the cleaned table."""
    return prepare(messy_orders(spark, sf), "row_id").cleaned


@query("run_summary", f"WITH {MO} SELECT CAST(1 AS INTEGER) AS attempts, count(*) AS rows_before, count(DISTINCT order_id) AS rows_after FROM mo")
def run_summary(spark, sf):
    return prepare(messy_orders(spark, sf), "row_id").summary().select("attempts", "rows_before", "rows_after")


@query("prepare_two_attempts", f"WITH {MO} SELECT CAST(2 AS INTEGER) AS attempts, count(*) AS rows_before, count(DISTINCT order_id) AS rows_after FROM mo")
def prepare_two_attempts(spark, sf):
    """A target that cannot be reached: planned again on the cleaned table, once."""
    done = prepare(messy_orders(spark, sf), "row_id", target_score=101.0)
    return done.summary().select("attempts", "rows_before", "rows_after")


# ---- feature plans --------------------------------------------------------------

# what a demand model needs of line items: the return state as a rank, open or closed as flags, a discounted price
FEATURES = Plan(
    [
        Action("return_rank", "ordinal_encode", "l_returnflag", {"mapping": {"N": 1, "A": 5, "R": 9}}),
        Action("status_flags", "one_hot_encode", "l_linestatus", {"drop_first": False}),
        Action("per_day", "frequency_encode", "l_shipdate"),
        Action("discounted", "interaction_features", None, {"column_pairs": [["l_extendedprice", "l_discount"]]}),
        Action("share_of_top", "max_abs_scale", "l_quantity"),
        Action("tax_class", "binning", "l_tax", {"n_bins": 3, "strategy": "uniform"}),
        Action("price_again", "robust_scale", "l_extendedprice", approved=False),
        Action("by_buyer", "target_encode", "l_partkey", {"target_column": "buyer"}),
    ]
)
_FE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _fe_run(spark, sf):
    return run_plan(table(spark, sf, "lineitem"), FEATURES)


@query(
    "run_fe_plan",
    "WITH s AS (SELECT max(abs(l_quantity)) AS top, min(l_tax) AS tl, (max(l_tax) - min(l_tax)) / 3 AS w FROM lineitem), "
    "d AS (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1) "
    f"SELECT {_FE_KEYS}, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 5 WHEN 'R' THEN 9 ELSE -1 END AS l_returnflag, "
    "CAST(l_linestatus = 'F' AS INTEGER) AS \"l_linestatus_F\", CAST(l_linestatus = 'O' AS INTEGER) AS \"l_linestatus_O\", n AS l_shipdate, "
    "l_extendedprice, l_discount, round(l_extendedprice * l_discount, 4) AS l_extendedprice_x_l_discount, round(l_quantity / top, 6) AS l_quantity, "
    "CAST((l_tax >= tl + w)::INT + (l_tax >= tl + w * 2)::INT AS INTEGER) AS l_tax_binned FROM lineitem JOIN d USING (l_shipdate), s",
)
def run_fe_plan(spark, sf):
    out = _fe_run(spark, sf).df
    keys = [k.strip() for k in _FE_KEYS.split(",")]
    return out.select(
        *keys, "l_returnflag", "l_linestatus_F", "l_linestatus_O", "l_shipdate", "l_extendedprice", "l_discount",
        F.round("l_extendedprice_x_l_discount", 4).alias("l_extendedprice_x_l_discount"), F.round("l_quantity", 6).alias("l_quantity"), "l_tax_binned",
    )


@query(
    "run_fe_plan_log",
    "WITH v AS (SELECT string_agg('l_linestatus_' || l_linestatus, ',' ORDER BY l_linestatus) AS flags FROM (SELECT DISTINCT l_linestatus FROM lineitem)) "
    "SELECT id AS action_id, CASE WHEN id = 'by_buyer' THEN 'failed' ELSE 'succeeded' END AS status, "
    "CASE id WHEN 'status_flags' THEN flags WHEN 'discounted' THEN 'l_extendedprice_x_l_discount' WHEN 'tax_class' THEN 'l_tax_binned' ELSE '' END AS columns_added, "
    "CASE id WHEN 'status_flags' THEN 'l_linestatus' ELSE '' END AS columns_removed "
    "FROM v, unnest(['return_rank', 'status_flags', 'per_day', 'discounted', 'share_of_top', 'tax_class', 'by_buyer']) AS t(id)",
)
def run_fe_plan_log(spark, sf):
    log = _fe_run(spark, sf).log(samples=False)
    return log.select(
        "action_id", "status", F.array_join("columns_added", ",").alias("columns_added"), F.array_join("columns_removed", ",").alias("columns_removed")
    )


@query("recommend_fe")
def recommend_fe(spark, sf):
    return recommend_features(table(spark, sf, "lineitem"), "l_extendedprice").rows(spark)


# ---- audit ----------------------------------------------------------------------


def _clean_event(spark, sf):
    run = _run(spark, sf)
    cleaned = stage_table(run.df, "cleaned")
    report = validate(run.source, cleaned, 70.0, run.succeeded, run.executed, ("row_id",))
    return audit.cleaning_event(spark, PLAN, run, report, "orders")


_EVENT = f"WITH {MO} SELECT 'cleaning' AS event_type, count(*) AS row_count_before, count(DISTINCT order_id) AS row_count_after, CAST(10 AS INTEGER) AS total_actions, CAST(9 AS INTEGER) AS approved_actions, CAST(1 AS INTEGER) AS rejected_actions FROM mo"
_EVENT_COLUMNS = ["event_type", "row_count_before", "row_count_after", "total_actions", "approved_actions", "rejected_actions"]


@query("audit_event", _EVENT)
def audit_event(spark, sf):
    return _clean_event(spark, sf).select(*_EVENT_COLUMNS)


@query("audit_fe", "SELECT 'feature_engineering' AS event_type, count(*) AS row_count_before, CAST(8 AS INTEGER) AS total_actions, CAST(7 AS INTEGER) AS approved_actions, CAST(2 + count(DISTINCT l_linestatus) AS INTEGER) AS columns_added, CAST(1 AS INTEGER) AS columns_removed FROM lineitem")
def audit_fe(spark, sf):
    run = _fe_run(spark, sf)
    event = audit.feature_event(spark, FEATURES, run, table(spark, sf, "lineitem").count())
    return event.select("event_type", "row_count_before", "total_actions", "approved_actions", "columns_added", "columns_removed")


@query(
    "audit_history",
    "SELECT 'cleaning' AS event_type, count(*) AS row_count_before, CAST(10 AS INTEGER) AS total_actions FROM orders "
    "UNION ALL SELECT 'feature_engineering', count(*), CAST(8 AS INTEGER) FROM lineitem".replace("FROM orders ", f"FROM (WITH {MO} SELECT * FROM mo) "),
)
def audit_history(spark, sf):
    """Two events and one line that is no event, appended and read back."""
    path = shared_path(spark, "audit")
    audit.append_event(_clean_event(spark, sf), path)
    run = _fe_run(spark, sf)
    audit.append_event(audit.feature_event(spark, FEATURES, run, table(spark, sf, "lineitem").count()), path)
    spark.createDataFrame([("not an event",)], "value string").write.mode("append").text(path)
    return audit.audit_history(spark, path).select("event_type", "row_count_before", "total_actions")


@query("audit_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def audit_append(spark, sf):
    """One JSON line per event, appended in two writes."""
    path = shared_path(spark, "audit-lines")
    events = table(spark, sf, "events")
    for kind in (F.col("event_type") == "error", F.col("event_type") != "error"):
        audit.append_event(events.where(kind).select("event_id", "event_type"), path)
    return spark.read.json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("file_hash")
def file_hash(spark, sf):
    return readers.file_hashes(spark, sf).orderBy("file_name")


# ---- sources --------------------------------------------------------------------

_TEXT = ["price_s", "status_s", "priority_s", "date_s"]
_ROWS = f"WITH {MO} SELECT CAST(order_id AS VARCHAR) AS order_id, nullif(price_s, '') AS price_s, status_s, priority_s, date_s FROM mo"


def _csv_orders(spark, sf):
    """Messy orders as CSV files; the delimiter depends on the order status."""
    path = shared_path(spark, "csv")
    messy = messy_orders(spark, sf).select(*MESSY_COLUMNS)
    status = F.upper(F.btrim("status_s"))
    parts = {";": status == "F", "|": status == "O", ",": ~status.isin("F", "O")}
    for i, (sep, rows) in enumerate(parts.items()):
        messy.where(rows).write.option("header", True).option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(f"{path}/part{i}")
    return path


@query("src_csv", _ROWS)
def src_csv(spark, sf):
    return readers.read_delimited(spark, _csv_orders(spark, sf)).df


@query(
    "src_sniff",
    f"WITH {MO} SELECT CASE upper(trim(status_s)) WHEN 'F' THEN ';' WHEN 'O' THEN '|' ELSE ',' END AS delimiter, 'UTF-8' AS encoding FROM mo GROUP BY 1",
)
def src_sniff(spark, sf):
    return readers.sniff_files(spark, _csv_orders(spark, sf)).select("delimiter", "encoding").distinct()


@query("file_metadata", f"WITH {MO} SELECT 'csv' AS format, 'UTF-8' AS encoding, count(*) AS row_count, CAST(5 AS INTEGER) AS col_count FROM mo")
def file_metadata(spark, sf):
    files = readers.file_metadata(spark, _csv_orders(spark, sf), "csv")
    return files.groupBy("format", "encoding", "col_count").agg(F.sum("row_count").alias("row_count"))


_WIDE = 400


def _wide_lines(spark, sf):
    """Line items under a header of far over 4,096 characters, every 97th order with a cell too many."""
    path = shared_path(spark, "wide")
    header = ",".join(["order", "line", "order", ""] + [f"a rather long column name {i}" for i in range(_WIDE)])
    cells = F.concat_ws(",", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    bad = F.when(F.col("l_orderkey") % 97 == 0, "," * (_WIDE + 1) + "extra").otherwise("")
    rows = table(spark, sf, "lineitem").select(F.concat(cells, bad).alias("value"))
    rows.repartition(4, "value").mapInPandas(_with_header(header), "value string").write.text(path)
    return path


def _with_header(header):
    def run(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [header]})
        yield from batches

    return run


@query(
    "src_wide_csv",
    "SELECT CAST(l_orderkey AS VARCHAR) AS \"order\", CAST(l_linenumber AS VARCHAR) AS line, CAST(l_partkey AS VARCHAR) AS order_1, CAST(l_suppkey AS VARCHAR) AS column_4, "
    "CAST(404 AS INTEGER) AS columns, (SELECT count(*) FROM lineitem WHERE l_orderkey % 97 = 0) AS rejected FROM lineitem WHERE l_orderkey % 97 <> 0",
)
def src_wide_csv(spark, sf):
    source = readers.read_delimited(spark, _wide_lines(spark, sf))
    return source.df.select(
        "order", "line", F.col("`order.1`").alias("order_1"), "column_4", F.lit(len(source.df.columns)).alias("columns"),
        F.lit(source.rejected.where(f"{readers.LINE} like '%,extra'").count()).alias("rejected"),
    )


@query("src_json", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text) AS text FROM conversations")
def src_json(spark, sf):
    """One JSON object per turn, with the turn in a nested array of records."""
    path = shared_path(spark, "json")
    turn = F.struct("conv_id", "turn", F.struct("role", "text").alias("said"))
    table(spark, sf, "conversations").select(F.lit("ok").alias("status"), F.struct(F.array(turn).alias("turns")).alias("data")).write.json(path)
    flat = readers.read_json_records(spark, path, "data.turns", lines=True).df
    return flat.select("conv_id", "turn", F.col("`said.role`").alias("role"), F.md5("`said.text`").alias("text"))


@query(
    "flatten_nested",
    "SELECT event_id, event_type AS \"what.type\", value AS \"what.value\", CAST(json_extract(props, '$.k') AS VARCHAR) AS \"props.k\" FROM events",
)
def flatten_nested(spark, sf):
    nested = table(spark, sf, "events").select(
        "event_id",
        F.struct(F.col("event_type").alias("type"), "value").alias("what"),
        F.from_json("props", "k string").alias("props"),
    )
    return readers.flatten_struct(nested)


@query(
    "prepare_path",
    "SELECT 'orders' AS file_name, 'csv' AS file_format, 64 AS hash_length, count(*) AS row_count_before, count(*) AS row_count_after FROM orders",
)
def prepare_path_query(spark, sf):
    """The orders written as a folder of delimited files and prepared from there; the audit's account of it."""
    path = shared_path(spark, "delivered")
    prices = table(spark, sf, "orders").selectExpr("o_orderkey as key", "concat('$', o_totalprice) as price", "concat(' ', o_orderpriority) as priority")
    sinks.write_csv(prices, f"{path}/orders")
    prepare_path(spark, f"{path}/orders", f"{path}/home", audit_path=f"{path}/audit")
    events = audit.audit_history(spark, f"{path}/audit")
    return events.select("file_name", "file_format", F.length("file_hash").alias("hash_length"), "row_count_before", "row_count_after")


@query("src_xml", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS \"maker.value\", p_type AS \"maker.kind\", 'new|checked' AS tags FROM part")
def src_xml(spark, sf):
    """Parts as XML with attributes, text and repeated elements; the row tag is found."""
    path = shared_path(spark, "xml")
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("_id"),
        F.col("p_name").alias("name"),
        F.struct(F.col("p_brand").alias("_VALUE"), F.col("p_type").alias("_kind")).alias("maker"),
        F.array(F.lit("new"), F.lit("checked")).alias("tags"),
    )
    part.write.format("xml").option("rowTag", "part").option("rootTag", "catalog").save(path)
    return readers.read_xml_records(spark, path).df


@query(
    "src_xml_layouts",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, NULL::VARCHAR AS phone FROM part UNION ALL "
    "SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR) FROM supplier",
)
def src_xml_layouts(spark, sf):
    """One folder with documents of two kinds of records."""
    path = shared_path(spark, "xml-layouts")
    parts = table(spark, sf, "part").selectExpr("cast(p_partkey as string) as id", "p_name as name")
    parts.repartition(2).write.format("xml").option("rowTag", "part").option("rootTag", "catalog").save(f"{path}/parts")
    makers = table(spark, sf, "supplier").selectExpr("cast(s_suppkey as string) as id", "s_name as name", "cast(s_nationkey as string) as phone")
    makers.repartition(2).write.format("xml").option("rowTag", "maker").option("rootTag", "makers").save(f"{path}/makers")
    return readers.read_xml_records(spark, path).df.select("id", "name", "phone")


@query(
    "src_folder",
    "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, NULL::VARCHAR AS region FROM nation UNION ALL "
    "SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL "
    "SELECT CAST(p_partkey AS VARCHAR), p_name, NULL FROM part",
)
def src_folder(spark, sf):
    """A folder of XML, Parquet and two kinds of delimited files, read as one table."""
    path = shared_path(spark, "folder")
    table(spark, sf, "nation").selectExpr("n_nationkey as key", "n_name as name").coalesce(1).write.option("header", True).csv(f"{path}/nation")
    table(spark, sf, "supplier").selectExpr("s_suppkey as key", "s_name as name").repartition(2).write.parquet(f"{path}/supplier")
    parts = table(spark, sf, "part").selectExpr("p_partkey as key", "p_name as name")
    parts.coalesce(1).write.format("xml").option("rowTag", "part").option("rootTag", "catalog").save(f"{path}/part")
    customers = table(spark, sf, "customer").selectExpr("c_custkey as key", "c_name as name", "c_nationkey as region")
    customers.repartition(2).write.option("header", True).option("sep", ";").csv(f"{path}/customer")
    return readers.read_any(spark, path).df.select("key", "name", "region")


@query("read_any", "SELECT r_regionkey, r_name FROM region")
def read_any(spark, sf):
    return readers.read_any(spark, f"{sf}/region.parquet").df


@query("ingest_normalize", f"WITH {MO} SELECT price_s, nullif(trim(status_s), '-') AS status FROM mo WHERE nullif(trim(price_s), '') IS NOT NULL OR nullif(trim(status_s), '-') IS NOT NULL")
def ingest_normalize(spark, sf):
    """Two empty columns, a padded name and blank rows."""
    df = messy_orders(spark, sf).select(
        F.col("price_s").alias(" price_s "),
        F.expr("nullif(trim(status_s), '-')").alias("status"),
        F.lit(None).cast("string").alias("nothing"),
        F.lit("   ").alias("blank"),
    )
    return readers.ingest_normalize(df)


@query("ingest_row_id", "SELECT count(*) AS n, count(*) AS distinct_ids FROM orders")
def ingest_row_id(spark, sf):
    df = readers.ingest_normalize(table(spark, sf, "orders"), "row_id")
    return df.agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("distinct_ids"))


# ---- sinks ----------------------------------------------------------------------


@query("sink_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def sink_csv(spark, sf):
    path = shared_path(spark, "out-csv")
    sinks.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.option("header", True).csv(path)


@query("sink_parquet", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def sink_parquet(spark, sf):
    path = shared_path(spark, "out-parquet")
    sinks.write_parquet(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path)
    return spark.read.parquet(path)


def _before_after(spark, sf):
    before = messy_orders(spark, sf)
    return before, NormalizeCase("priority_s", "upper").run(TrimWhitespace("priority_s").run(before))


@query("preview_diff", f"WITH {MO} SELECT row_id, 'priority_s' AS column_name, priority_s AS before, upper(trim(priority_s)) AS after FROM mo WHERE priority_s <> upper(trim(priority_s))")
def preview_diff(spark, sf):
    return sinks.changed_cells(*_before_after(spark, sf), "row_id")


@query(
    "preview",
    f"WITH {MO}, h AS (SELECT * FROM mo ORDER BY row_id LIMIT 5) "
    + " UNION ALL ".join(f"SELECT row_id, '{x}' AS column_name, CAST({x} AS VARCHAR) AS before, {'upper(trim(priority_s))' if x == 'priority_s' else f'CAST({x} AS VARCHAR)'} AS after FROM h" for x in MESSY_COLUMNS),
)
def preview(spark, sf):
    return sinks.preview(*_before_after(spark, sf), "row_id", 5)


# ---- streams --------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("stream_clean", "SELECT event_id, upper(event_type) AS event_type, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 5) AS value FROM events")
def stream_clean(spark, sf):
    """Steps fitted on the table, applied to a stream of it."""
    history = table(spark, sf, "events")
    steps = [NormalizeCase("event_type", "upper").fit(history), StandardScale("value").fit(history)]
    cleaned = drain(transform_stream(_event_stream(spark, sf).select("event_id", "event_type", "value"), steps), "stream")
    return cleaned.withColumn("value", F.round("value", 5))


@query("stream_dedup", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_dedup(spark, sf):
    """First event per user and type; the delay spans the whole stream."""
    stream = _event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    once = deduplicate_stream(stream.select("ts", "user_id", "event_type"), "ts", "3650 days", ["user_id", "event_type"])
    return drain(once, "stream-dedup").agg(F.count("*").alias("n"))


@query("stream_convert", "SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS value FROM events")
def stream_convert(spark, sf):
    stream = _event_stream(spark, sf).select("event_id", F.col("value").cast("string").alias("value"))
    step = ConvertType("value", "int").fit(table(spark, sf, "events"))
    return drain(transform_stream(stream, [step]), "stream-convert")
