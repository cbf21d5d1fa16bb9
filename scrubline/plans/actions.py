"""Plans: ordered lists of typed, reviewable actions, as JSON or as a table."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.operators import cleaning as c
from scrubline.operators import features as f
from scrubline.operators.dedup import RemoveDuplicates
from scrubline.operators.similarity import AutoStandardize, RemoveFuzzyDuplicates
from scrubline.operators.steps import Step

PRIORITIES = ("high", "medium", "low")


@dataclass
class Action:
    """One proposed rewrite; it runs only if approved."""

    id: str
    action_type: str
    column_name: str | None = None
    parameters: dict[str, Any] = field(default_factory=dict)
    columns: list[str] | None = None
    description: str = ""
    reason: str = ""
    priority: str = "medium"
    approved: bool = True
    warning: str | None = None


@dataclass
class Plan:
    """An ordered list of actions."""

    actions: list[Action]
    target_column: str | None = None
    estimated_rows_affected: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Plan:
        data = json.loads(text)
        actions = []
        for i, a in enumerate(data.get("actions", [])):
            known = {k: a[k] for k in Action.__dataclass_fields__ if a.get(k) is not None}
            # an action without a known type is left out, the rest of the plan stays usable
            if known.get("action_type") in {**CLEANING, **FEATURES}:
                actions.append(Action(**{"id": f"action_{i + 1:03d}", **known}))
        return Plan(actions, data.get("target_column"), data.get("estimated_rows_affected", 0))

    # -- review

    def approve(self, *ids: str) -> Plan:
        return self._mark(True, ids)

    def reject(self, *ids: str) -> Plan:
        return self._mark(False, ids)

    def _mark(self, approved: bool, ids: tuple[str, ...]) -> Plan:
        chosen = [replace(a, approved=approved) if not ids or a.id in ids else a for a in self.actions]
        return replace(self, actions=chosen)

    def edit(self, action_id: str, **parameters: Any) -> Plan:
        """Change parameters of one action, such as a fill strategy or an outlier action."""
        edited = [
            replace(a, parameters={**a.parameters, **parameters}) if a.id == action_id else a
            for a in self.actions
        ]
        return replace(self, actions=edited)

    def approved(self) -> list[Action]:
        return [a for a in self.actions if a.approved]

    # -- tables

    def rows(self, spark: SparkSession) -> DataFrame:
        """One row per action, in order; parameters as JSON."""
        data = [
            (i, a.id, a.column_name, a.action_type, json.dumps(a.parameters, sort_keys=True), a.reason, a.priority, a.approved)
            for i, a in enumerate(self.actions)
        ]
        return spark.createDataFrame(
            data,
            "position int, id string, column_name string, action_type string, parameters string, "
            "reason string, priority string, approved boolean",
        )

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: total, approved and high-priority actions, and the estimated rows."""
        return self.rows(spark).agg(
            F.count("*").alias("total_actions"),
            F.count_if("approved").alias("approved_actions"),
            F.count_if(F.col("priority") == "high").alias("high_priority"),
            F.lit(self.estimated_rows_affected).cast("long").alias("estimated_rows"),
        )


# ---- action types ---------------------------------------------------------------

Maker = Callable[[Action, str | None], Step]


def _categories(a: Action, order_by: str | None) -> Step:
    if a.parameters.get("mapping"):
        return c.MapCategories(a.column_name, a.parameters["mapping"])
    return AutoStandardize(a.column_name, a.parameters.get("threshold", 80))


def _duplicates(a: Action, order_by: str | None) -> Step:
    p = a.parameters
    if p.get("method") == "fuzzy":
        if not order_by:
            raise ValueError("fuzzy duplicates need a row order")
        return RemoveFuzzyDuplicates(order_by, p.get("key_columns"), p.get("threshold", 90))
    return RemoveDuplicates(p.get("keep", "first"), p.get("subset") or None, order_by)


CLEANING: dict[str, Maker] = {
    "trim_whitespace": lambda a, o: c.TrimWhitespace(a.column_name),
    "normalize_case": lambda a, o: c.NormalizeCase(a.column_name, a.parameters.get("case", "lower")),
    "fix_encoding": lambda a, o: c.FixEncoding(a.column_name),
    "convert_type": lambda a, o: c.ConvertType(a.column_name, a.parameters.get("target_type", "str"), a.parameters.get("remove_chars")),
    "parse_dates": lambda a, o: c.ParseDates(a.column_name, a.parameters.get("target_format", "%Y-%m-%d")),
    "fill_missing": lambda a, o: c.fill_step(a.column_name, a.parameters.get("strategy", "mode"), a.parameters.get("value"), o, text_cells=a.parameters.get("text_cells", "refuse")),
    "standardize_categorical": _categories,
    "handle_outlier": lambda a, o: c.HandleOutliers(a.column_name, a.parameters.get("action", "cap"), a.parameters.get("multiplier", 1.5)),
    "remove_duplicates": _duplicates,
    "rename_column": lambda a, o: c.RenameColumn(a.column_name, a.parameters.get("new_name", a.column_name)),
    "drop_column": lambda a, o: c.DropColumn(a.column_name),
}

FEATURES: dict[str, Maker] = {
    "one_hot_encode": lambda a, o: f.OneHotEncode(a.column_name, **a.parameters),
    "label_encode": lambda a, o: f.LabelEncode(a.column_name, **a.parameters),
    "ordinal_encode": lambda a, o: f.OrdinalEncode(a.column_name, **a.parameters),
    "target_encode": lambda a, o: f.TargetEncode(a.column_name, **a.parameters),
    "frequency_encode": lambda a, o: f.FrequencyEncode(a.column_name, **a.parameters),
    "min_max_scale": lambda a, o: f.MinMaxScale(a.column_name, **a.parameters),
    "standard_scale": lambda a, o: f.StandardScale(a.column_name, **a.parameters),
    "robust_scale": lambda a, o: f.RobustScale(a.column_name, **a.parameters),
    "max_abs_scale": lambda a, o: f.MaxAbsScale(a.column_name, **a.parameters),
    "log_transform": lambda a, o: f.LogTransform(a.column_name, **a.parameters),
    "power_transform": lambda a, o: f.PowerTransform(a.column_name, **a.parameters),
    "quantile_transform": lambda a, o: f.QuantileTransform(a.column_name, **a.parameters),
    "binning": lambda a, o: f.Binning(a.column_name, **a.parameters),
    "interaction_features": lambda a, o: f.InteractionFeatures(a.parameters.get("column_pairs", [])),
    "polynomial_features": lambda a, o: f.PolynomialFeatures(
        a.parameters.get("columns", a.columns or []), a.parameters.get("degree", 2), a.parameters.get("interaction_only", False)),
    "drop_low_variance": lambda a, o: f.DropLowVariance(a.parameters.get("threshold", 0.01)),
    "drop_high_cardinality": lambda a, o: f.DropHighCardinality(a.parameters.get("max_cardinality", 50)),
    "drop_highly_correlated": lambda a, o: f.DropCorrelated(a.parameters.get("threshold", 0.95)),
}


def register_action(name: str, maker: Maker, feature: bool = False) -> None:
    """Add an action type of your own: ``maker(action, order_by)`` returns a step."""
    (FEATURES if feature else CLEANING)[name] = maker


def make_step(action: Action, order_by: str | None = None) -> Step:
    maker = CLEANING.get(action.action_type) or FEATURES.get(action.action_type)
    if maker is None:
        raise ValueError(f"unknown action type {action.action_type!r}")
    return maker(action, order_by)
