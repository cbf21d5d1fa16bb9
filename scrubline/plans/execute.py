"""Running a plan: approved actions in order, faults of an action logged and the action skipped.

A fault is a bad parameter, a missing column or data that a step refuses. Anything else, such as a
lost executor or a full disk, ends the run: half a cleaned table must not look like a whole one.

Actions on different columns are fitted together: an action joins the current batch
unless it reads a column that the batch already rewrites, or either of them changes the
set of rows. One batch costs one aggregate and one quantile search. Rewrites are
projections, so a batch adds no stage of its own.

A staged run writes the frame before and after every action that changes the set of rows, and at the end. The pass
that writes also counts the cells that each action changed (``observe``), and later fits read the written table and not
the source again. The observed number of rows must equal the written one; after a retried task, which may have been
counted twice, the cells are counted by an aggregate instead. A run that is not staged writes nothing, and its log
counts by one aggregate per batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scrubline.functions.numbers import is_numeric_type, to_double

from scrubline.operators import cleaning as c
from scrubline.operators.dedup import RemoveDuplicates
from scrubline.operators.features import (
    DropCorrelated,
    DropHighCardinality,
    DropLowVariance,
    OneHotEncode,
    TargetEncode,
)
from scrubline.operators.fill import FillDirection
from scrubline.operators.similarity import RemoveFuzzyDuplicates
from scrubline.operators.steps import Fitted, Step, col, fit_all
from scrubline.plans.actions import CLEANING, Action, Plan, make_step
from scrubline.session import stage_table

LOG_SCHEMA = (
    "position int, action_id string, column_name string, action_type string, rows_affected long, "
    "before_sample array<string>, after_sample array<string>, status string, error string, "
    "columns_added array<string>, columns_removed array<string>"
)
SAMPLE = 3
# first rows in which samples are looked for before the whole table is sorted for them
SAMPLE_ROWS = 64
FAULTS = (ValueError, TypeError, KeyError, AnalysisException, IllegalArgumentException, ParseException)

# steps after which rows are gone, columns have other names, or rows were re-read
BARRIERS = (
    RemoveDuplicates,
    RemoveFuzzyDuplicates,
    FillDirection,
    c.DropMissing,
    c.RenameColumn,
    c.DropColumn,
    OneHotEncode,
    DropLowVariance,
    DropHighCardinality,
    DropCorrelated,
)


def is_barrier(step: Step) -> bool:
    removes = isinstance(step, c.HandleOutliers) and step.action == "remove"
    return removes or isinstance(step, BARRIERS)


@dataclass
class Record:
    """What one executed action did."""

    action: Action
    status: str = "succeeded"
    error: str | None = None
    before: DataFrame | None = None
    after: DataFrame | None = None
    step: Step | None = None
    fitted: Fitted | None = None
    rows_affected: int | None = None

    @property
    def columns_added(self) -> list[str]:
        return [x for x in self.after.columns if x not in self.before.columns] if self.step else []

    @property
    def columns_removed(self) -> list[str]:
        return [x for x in self.before.columns if x not in self.after.columns] if self.step else []


@dataclass
class Execution:
    """The rewritten frame and the log of how it came about."""

    df: DataFrame
    source: DataFrame
    records: list[Record] = field(default_factory=list)
    batches: list[list[Record]] = field(default_factory=list)
    order_by: str | None = None

    @property
    def executed(self) -> int:
        return len(self.records)

    @property
    def succeeded(self) -> int:
        return sum(1 for r in self.records if r.status != "failed")

    def log(self, samples: bool = True) -> DataFrame:
        """One row per executed action."""
        counts = self.rows_affected()
        near = self._first_rows() if samples and self.order_by else {}
        rows = []
        for i, r in enumerate(self.records):
            name = r.action.column_name
            shown = samples and r.step is not None and name is not None
            order = self.order_by
            rows.append(
                (
                    i, r.action.id, name, r.action.action_type, counts.get(i, 0),
                    *(near.get(i) or (_sample(r.before, name, order), _sample(r.after, name, order)) if shown else ([], [])),
                    r.status, r.error, r.columns_added, r.columns_removed,
                )
            )
        return self.source.sparkSession.createDataFrame(rows, LOG_SCHEMA)

    def rows_affected(self) -> dict[int, int]:
        """Changed cells (or removed rows) per record."""
        place = {id(r): i for i, r in enumerate(self.records)}
        out = {i: r.rows_affected for i, r in enumerate(self.records) if r.rows_affected is not None}
        for batch in self.batches:
            if all(place[id(r)] in out for r in batch):
                continue
            flagged, aggs = batch[0].before, []
            for r in batch:
                i = place[id(r)]
                if isinstance(r.step, (c.RenameColumn, c.DropColumn)):
                    out[i] = 1 if r.columns_added or r.columns_removed else 0
                elif is_barrier(r.step):
                    out[i] = _barrier_rows(r)
                elif r.action.column_name in r.after.columns and r.action.column_name in flagged.columns:
                    name = r.action.column_name
                    kind = flagged.schema[name].dataType
                    flagged = r.fitted.transform(flagged.withColumn(f"__old{i}", col(name)))
                    aggs.append(F.count_if(_changed(F.col(f"__old{i}"), kind, col(name), flagged.schema[name].dataType)).alias(f"r{i}"))
                else:
                    flagged = r.fitted.transform(flagged)
            if aggs:
                row = flagged.agg(*aggs).first().asDict()
                out |= {int(k[1:]): n for k, n in row.items()}
        return out

    def _first_rows(self) -> dict[int, tuple[list[str], list[str]]]:
        """Samples before and after the actions between two barriers, from one look at the first rows.

        An action is left out if these rows don't hold enough values and the table has more rows.
        """
        out = {}
        place = {id(r): i for i, r in enumerate(self.records)}
        for run in self._between_barriers():
            start = run[0].before
            if self.order_by not in start.columns:
                continue
            rows = start.orderBy(col(self.order_by)).limit(SAMPLE_ROWS)
            names = []
            for r in run:
                i, name = place[id(r)], r.action.column_name
                seen = lambda end, i=i, name=name: F.array(col(name).cast("string")).alias(f"__{end}{i}")
                held = name is not None and name in rows.columns
                rows = rows.select("*", seen("b")) if held else rows
                rows = r.fitted.transform(rows)
                if held and name in rows.columns:
                    rows = rows.select("*", seen("a"))
                    names.append(i)
            wanted = [F.col(f"__{end}{i}")[0].alias(f"__{end}{i}") for i in names for end in "ba"]
            first = sorted(rows.select(col(self.order_by).alias("__o"), *wanted).collect(), key=lambda x: x["__o"]) if wanted else []
            for i in names:
                ends = [[x[f"__{end}{i}"] for x in first if x[f"__{end}{i}"] is not None] for end in "ba"]
                if len(first) < SAMPLE_ROWS or all(len(e) >= SAMPLE for e in ends):
                    out[i] = (ends[0][:SAMPLE], ends[1][:SAMPLE])
        return out

    def _between_barriers(self) -> list[list[Record]]:
        """Records that were executed one after the other on the same rows and columns."""
        out: list[list[Record]] = [[]]
        for batch in self.batches:
            if is_barrier(batch[0].step):
                out.append([])
            else:
                out[-1] += batch
        return [x for x in out if x]

    def totals(self) -> dict[str, Any]:
        counts = self.rows_affected()
        return {
            "total_actions_executed": self.executed,
            "total_actions_succeeded": self.succeeded,
            "total_rows_modified": sum(counts.values()),
            "columns_added_total": sum(len(r.columns_added) for r in self.records),
            "columns_removed_total": sum(len(r.columns_removed) for r in self.records),
        }


@dataclass
class Logged:
    """A run that was executed earlier: its frame and its stored log."""

    df: DataFrame
    stored: DataFrame

    def __post_init__(self):
        # one row per action
        self.rows = self.stored.collect()

    @property
    def executed(self) -> int:
        return len(self.rows)

    @property
    def succeeded(self) -> int:
        return sum(1 for r in self.rows if r["status"] != "failed")

    def log(self, samples: bool = True) -> DataFrame:
        return self.stored if samples else self.stored.withColumns({c: F.array().cast("array<string>") for c in ("before_sample", "after_sample")})

    def totals(self) -> dict[str, Any]:
        return {
            "total_actions_executed": self.executed,
            "total_actions_succeeded": self.succeeded,
            "total_rows_modified": sum(r["rows_affected"] for r in self.rows),
            "columns_added_total": sum(len(r["columns_added"]) for r in self.rows),
            "columns_removed_total": sum(len(r["columns_removed"]) for r in self.rows),
        }


def _changed(old: Column, old_kind, new: Column, new_kind) -> Column:
    """Whether a cell means something else: a number written as text is the same number."""
    same = old.cast("string").eqNullSafe(new.cast("string"))
    if old_kind != new_kind and is_numeric_type(new_kind) and not is_numeric_type(old_kind):
        same = same | F.coalesce(to_double(old.cast("string")) == new.cast("double"), F.lit(False))
    return ~same


def _barrier_rows(r: Record) -> int:
    name = r.action.column_name
    if isinstance(r.step, FillDirection):
        filled = r.after.agg(F.count(col(name))).first()[0]
        return filled - r.before.agg(F.count(c._present(r.before, name))).first()[0]
    if r.after.columns != r.before.columns:
        return 0
    return r.before.count() - r.after.count()


def _sample(df: DataFrame, name: str, order_by: str | None) -> list[str]:
    """The first values in the order of the rows, or the smallest without one: the same on every run."""
    if df is None or name not in df.columns:
        return []
    known = df.where(col(name).isNotNull())
    known = known.orderBy(col(order_by)) if order_by and order_by in df.columns else known.orderBy(col(name).cast("string"))
    return [row["v"] for row in known.select(col(name).cast("string").alias("v")).limit(SAMPLE).collect()]


class Flags:
    """The frame of a staged run since the last barrier, with a flag for every cell that an action changed."""

    def __init__(self, df: DataFrame):
        self.start = self.df = df
        self.flags: list[tuple[str, Record]] = []

    def add(self, record: Record) -> None:
        """The action just done on the frame, done on the flagged frame too."""
        name = record.action.column_name
        if name is None or name not in record.before.columns or name not in record.after.columns:
            self.df = record.fitted.transform(self.df)
            return
        flag = f"__changed{len(self.flags)}"
        done = record.fitted.transform(self.df.withColumn("__old", col(name)))
        changed = _changed(F.col("__old"), record.before.schema[name].dataType, col(name), record.after.schema[name].dataType)
        self.df = done.withColumn(flag, changed).drop("__old")
        self.flags.append((flag, record))

    def stage(self) -> DataFrame:
        """The written frame; the records get their counts from the pass that writes it."""
        if self.df is self.start:
            return self.df
        seen = Observation()
        counts = [F.count_if(F.col(flag)).alias(flag) for flag, _ in self.flags]
        observed = self.df.observe(seen, F.count(F.lit(1)).alias("__n"), *counts)
        written = stage_table(observed.drop(*[flag for flag, _ in self.flags]), "plan")
        found = seen.get
        if found["__n"] == written.count():
            for flag, record in self.flags:
                record.rows_affected = found[flag]
        return written


def run_plan(df: DataFrame, plan: Plan, order_by: str | None = None, staged: bool = False) -> Execution:
    """Execute the approved actions of a cleaning or feature plan.

    ``staged`` writes the frame at barriers and at the end, with the counts of the log.
    """
    run = Execution(df, df, order_by=order_by)
    pending: list[tuple[Record, Step]] = []
    written: set[str] = set()
    flags = Flags(df)

    def flush() -> None:
        nonlocal flags
        if not pending:
            return
        barrier = is_barrier(pending[0][1])
        if staged and barrier:
            run.df = flags.stage()
            flags = Flags(run.df)
        for record, fitted in _fit_batch(run.df, pending):
            if fitted is None:
                continue
            record.before, record.step, record.fitted = run.df, fitted.step, fitted
            try:
                run.df = fitted.transform(run.df)
            except FAULTS as e:
                record.status, record.error, record.step = "failed", _reason(e), None
            record.after = run.df
            if staged and record.step is not None and barrier:
                if not isinstance(record.step, (c.RenameColumn, c.DropColumn)):
                    run.df = record.after = stage_table(run.df, "plan")
                flags = Flags(run.df)
            elif staged and record.step is not None:
                flags.add(record)
        done = [r for r, _ in pending if r.step is not None]
        if done:
            run.batches.append(done)
        pending.clear()
        written.clear()

    for action in plan.approved():
        record = Record(action)
        run.records.append(record)
        try:
            step = make_step(action, order_by)
            # a column that is not there yet may be made by the batch
            if is_barrier(step) or _absent(action, run.df) or (step.reads(run.df) & written):
                flush()
            if action.action_type in CLEANING and _absent(action, run.df):
                record.status = "skipped"
                continue
            step.check(run.df)
            if isinstance(step, TargetEncode) and step.target not in run.df.columns:
                raise ValueError(f"target_column '{step.target}' not found")
        except FAULTS as e:
            record.status, record.error = "failed", _reason(e)
            continue
        pending.append((record, step))
        if action.column_name:
            written.add(action.column_name)
        if is_barrier(step):
            flush()
    flush()
    if staged:
        run.df = flags.stage()
    return run


def _absent(action: Action, df: DataFrame) -> bool:
    return action.column_name is not None and action.column_name not in df.columns


def _fit_batch(df: DataFrame, pending) -> list[tuple[Record, Fitted | None]]:
    try:
        return list(zip([r for r, _ in pending], fit_all(df, [s for _, s in pending]), strict=True))
    except FAULTS:
        # one of them cannot be fitted: find out which, keep the others
        out: list[tuple[Record, Fitted | None]] = []
        for record, step in pending:
            try:
                out.append((record, fit_all(df, [step])[0]))
            except FAULTS as e:
                record.status, record.error = "failed", _reason(e)
                out.append((record, None))
        return out


def _reason(e: Exception) -> str:
    return str(e)
