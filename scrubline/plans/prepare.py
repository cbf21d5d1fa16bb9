"""The full run: profile, plan, clean, validate, and try again if quality stays low."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scrubline.operators.dedup import duplicate_count
from scrubline.operators.profile import overall_quality, profile_table
from scrubline.operators.validate import Validation, validate
from scrubline.plans.actions import Plan
from scrubline.plans.audit import append_event, cleaning_event, feature_event
from scrubline.plans.execute import Execution, Logged, run_plan
from scrubline.plans.recommend import recommend_cleaning, recommend_features
from scrubline.session import committed_table, shared_folder
from scrubline.sources.readers import content_hash, ingest_normalize, read_any

QUALITY_TARGET = 70.0
MAX_ATTEMPTS = 2


@dataclass
class Prepared:
    """Everything a run produced."""

    raw: DataFrame
    profile: DataFrame
    plan: Plan
    cleaned: DataFrame
    run: Execution | Logged
    report: Validation
    attempts: int
    features: Execution | None = None
    feature_plan: Plan | None = None

    def summary(self) -> DataFrame:
        """One row: scores, improvement, attempts, rows before and after."""
        from pyspark.sql import functions as F

        return self.report.summary_row(self.raw.sparkSession).select(
            F.col("before_quality_score").alias("quality_before"),
            F.col("after_quality_score").alias("quality_after"),
            "improvement",
            F.lit(self.attempts).alias("attempts"),
            F.col("row_count_before").alias("rows_before"),
            F.col("row_count_after").alias("rows_after"),
        )


def propose(df: DataFrame, row_id: str | None = None) -> tuple[DataFrame, Plan]:
    """Profile a table and propose a cleaning plan for review."""
    data = df.drop(row_id) if row_id else df
    profile = profile_table(data)
    extra = duplicate_count(data).first()["extra_rows"]
    return profile, recommend_cleaning(profile, extra, dict(data.dtypes))


def _proposed(df: DataFrame, row_id: str | None, folder: str | None) -> tuple[DataFrame, Plan]:
    """``propose``, kept in ``folder``."""
    if folder is None:
        return propose(df, row_id)
    spark, made = df.sparkSession, []

    def proposed() -> tuple[DataFrame, Plan]:
        if not made:
            made.append(propose(df, row_id))
        return made[0]

    profile = committed_table(spark, f"{folder}/profile", lambda: proposed()[0])
    text = committed_table(spark, f"{folder}/plan", lambda: spark.createDataFrame([(proposed()[1].to_json(),)], "plan string"))
    return profile, Plan.from_json(text.first()["plan"])


def _executed(df: DataFrame, plan: Plan, row_id: str | None, folder: str | None) -> Execution | Logged:
    """``run_plan``, its frame and log kept in ``folder`` under the plan that made them."""
    if folder is None:
        return run_plan(df, plan, row_id, staged=True)
    spark, made = df.sparkSession, []

    def run() -> Execution:
        if not made:
            made.append(run_plan(df, plan, row_id, staged=True))
        return made[0]

    name = hashlib.sha256(plan.to_json().encode()).hexdigest()[:16]
    cleaned = committed_table(spark, f"{folder}/cleaned-{name}", lambda: run().df)
    log = committed_table(spark, f"{folder}/log-{name}", lambda: run().log().coalesce(1))
    return Logged(cleaned, log)


def prepare_path(spark: SparkSession, path: str, folder: str | None = None, row_id: str = "row_id", **options) -> Prepared:
    """``prepare`` of a file or folder: read, profile, plan, clean, validate, audit with hash and format.

    Everything is kept below ``folder`` (by default the session's shared folder) under the hash of the content. A run
    that was killed is called again and goes on after its last finished step; changed content is a new run. The
    audit event is appended by the call that comes to its end.
    """
    file_hash = content_hash(spark, path)
    home = f"{folder or shared_folder(spark) + '/runs'}/{file_hash}"
    formats = committed_table(spark, f"{home}/format", lambda: spark.createDataFrame([(read_any(spark, path).format,)], "format string"))
    raw = committed_table(spark, f"{home}/raw", lambda: ingest_normalize(read_any(spark, path).df, row_id))
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return prepare(raw, row_id, file_name=name, file_hash=file_hash, file_format=formats.first()["format"], folder=home, **options)


def prepare(
    df: DataFrame,
    row_id: str | None = None,
    plan: Plan | None = None,
    target_score: float = QUALITY_TARGET,
    features: bool = False,
    target_column: str | None = None,
    audit_path: str | None = None,
    file_name: str = "",
    file_hash: str | None = None,
    file_format: str | None = None,
    folder: str | None = None,
) -> Prepared:
    """Clean and validate, at most twice, until the score reaches the target.

    With ``folder`` every finished step (profile, plan, cleaned table, log) is kept there, and a run that
    finds it there goes on from it.

    A second attempt plans anew on the cleaned table, which is written to the shared
    folder first, so that it does not recompute the first attempt.
    """
    ignore = (row_id,) if row_id else ()
    profile, proposed = _proposed(df, row_id, folder and f"{folder}/1")
    plan = plan or proposed
    before = overall_quality(profile).first()[0] or 0.0
    current, attempt = df, 1
    while True:
        run = _executed(current, plan, row_id, folder and f"{folder}/{attempt}")
        cleaned = run.df
        report = validate(df, cleaned, before, run.succeeded, run.executed, ignore)
        if report.summary["after_quality_score"] >= target_score or attempt == MAX_ATTEMPTS:
            break
        current, attempt = cleaned, attempt + 1
        _, plan = _proposed(current, row_id, folder and f"{folder}/{attempt}")
    done = Prepared(df, profile, plan, cleaned, run, report, attempt)
    if audit_path:
        event = cleaning_event(df.sparkSession, plan, run, report, file_name, file_hash, file_format, attempts=attempt)
        append_event(event, audit_path)
    if features:
        ready = cleaned.drop(*ignore)
        done.feature_plan = recommend_features(ready, target_column)
        done.features = run_plan(ready, done.feature_plan)
        if audit_path:
            rows = report.summary["row_count_after"]
            append_event(feature_event(df.sparkSession, done.feature_plan, done.features, rows), audit_path)
    return done
