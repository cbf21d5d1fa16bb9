"""Audit trail: one JSON row per run, appended; statistics and hashes only, never data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.operators.validate import Validation
from scrubline.plans.actions import Plan
from scrubline.plans.execute import Execution

EVENT_SCHEMA = (
    "event_id string, event_type string, timestamp timestamp, file_name string, file_hash string, "
    "file_format string, row_count_before long, row_count_after long, quality_score_before double, "
    "quality_score_after double, improvement double, total_actions int, approved_actions int, "
    "rejected_actions int, rows_modified long, attempts int, col_count_before int, col_count_after int, "
    "columns_added int, columns_removed int, actions array<struct<action_id:string,action_type:string,"
    "columns_added:array<string>,columns_removed:array<string>,success:boolean,error:string>>"
)


def _event(spark: SparkSession, values: dict) -> DataFrame:
    values["event_id"] = uuid.uuid4().hex
    return spark.createDataFrame([values], EVENT_SCHEMA).withColumn("timestamp", F.current_timestamp())


def cleaning_event(
    spark: SparkSession,
    plan: Plan,
    run: Execution,
    report: Validation,
    file_name: str = "",
    file_hash: str | None = None,
    file_format: str | None = None,
    attempts: int = 1,
) -> DataFrame:
    s = report.summary
    approved = len(plan.approved())
    return _event(
        spark,
        {
            "event_type": "cleaning",
            "file_name": file_name,
            "file_hash": file_hash,
            "file_format": file_format,
            "row_count_before": s["row_count_before"],
            "row_count_after": s["row_count_after"],
            "quality_score_before": s["before_quality_score"],
            "quality_score_after": s["after_quality_score"],
            "improvement": s["improvement"],
            "total_actions": len(plan.actions),
            "approved_actions": approved,
            "rejected_actions": len(plan.actions) - approved,
            "rows_modified": run.totals()["total_rows_modified"],
            "attempts": attempts,
            "col_count_before": s["col_count_before"],
            "col_count_after": s["col_count_after"],
        },
    )


def feature_event(spark: SparkSession, plan: Plan, run: Execution, row_count: int) -> DataFrame:
    approved = len(plan.approved())
    return _event(
        spark,
        {
            "event_type": "feature_engineering",
            "row_count_before": row_count,
            "row_count_after": row_count,
            "total_actions": len(plan.actions),
            "approved_actions": approved,
            "rejected_actions": len(plan.actions) - approved,
            "col_count_before": len(run.source.columns),
            "col_count_after": len(run.df.columns),
            "columns_added": sum(len(r.columns_added) for r in run.records),
            "columns_removed": sum(len(r.columns_removed) for r in run.records),
            "actions": [
                (r.action.id, r.action.action_type, r.columns_added, r.columns_removed, r.status == "succeeded", r.error)
                for r in run.records
            ],
        },
    )


def append_event(event: DataFrame, path: str) -> None:
    event.write.mode("append").json(path)


def audit_history(spark: SparkSession, path: str) -> DataFrame:
    """All events, newest first; lines that are no events are left out."""
    events = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return events.where("event_id is not null").orderBy(F.desc("timestamp"), "event_id")
