"""Rule-based proposals: a cleaning plan from a profile, a feature plan from an analysis."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame

from scrubline.operators.analysis import analyze_columns, correlations
from scrubline.plans.actions import Action, Plan

# cleaning runs in this order, whatever order the rules fire in
CLEANING_ORDER = (
    "fix_encoding", "trim_whitespace", "convert_type", "parse_dates", "fill_missing",
    "normalize_case", "standardize_categorical", "handle_outlier", "remove_duplicates",
)
ONE_HOT_MAX = 10
HIGH_CARDINALITY = 50
# whole numbers of which at least this share of rows differ are identifiers
ID_SHARE = 0.9
NUMBER_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
SKEWED = 1.0


def recommend_cleaning(profile: DataFrame, extra_rows: int = 0, typed: dict[str, str] | None = None) -> Plan:
    """Actions for the issues of a profile table, ordered by kind.

    ``extra_rows`` is the number of exact duplicates beyond the first of each group, ``typed`` the
    types of the columns: a column that is numeric already keeps its type, whole numbers stay
    whole, and identifiers are never filled or capped.
    """
    found: list[dict[str, Any]] = []
    estimate = extra_rows
    typed = typed or {}
    for row in profile.orderBy("position").collect():
        for action in _column_actions(row, typed.get(row["column_name"])):
            found.append(action)
        estimate += row["missing_count"] + (row["outlier_count"] or 0)
    if extra_rows:
        found.append(_action(None, "remove_duplicates", {"keep": "first"}, f"{extra_rows} duplicate rows", "high"))
    found.sort(key=lambda a: CLEANING_ORDER.index(a["action_type"]))
    actions = [Action(id=f"action_{i + 1:03d}", **a) for i, a in enumerate(found)]
    return Plan(actions, estimated_rows_affected=estimate)


def _action(column, kind, parameters, reason, priority) -> dict[str, Any]:
    return {
        "column_name": column, "action_type": kind, "parameters": parameters, "reason": reason, "priority": priority,
    }


def _is_identifier(row) -> bool:
    """Whole numbers that hardly repeat, or a column of that meaning."""
    whole = row["integer_count"] >= 0.95 * max(row["present"], 1)
    return row["semantic_type"] == "id" or (whole and row["unique_count"] >= ID_SHARE * max(row["total"], 1))


def _column_actions(row, dtype: str | None = None) -> list[dict[str, Any]]:
    name, kind = row["column_name"], row["detected_type"]
    is_number = dtype is not None and dtype.split("(")[0] in NUMBER_TYPES
    identifier = kind == "numeric" and _is_identifier(row)
    if kind == "unknown":
        return [_action(name, "trim_whitespace", {}, "no values", "low")]
    out = []
    if kind in ("categorical", "text"):
        out.append(_action(name, "trim_whitespace", {}, "text column", "medium"))
    if kind == "numeric" and not is_number:
        target = "int" if identifier else "float"
        out.append(_action(name, "convert_type", {"target_type": target, "remove_chars": ["$", ","]}, "numeric text", "high"))
    if kind == "boolean":
        out.append(_action(name, "convert_type", {"target_type": "bool"}, "boolean words", "medium"))
    if kind == "datetime":
        out.append(_action(name, "parse_dates", {"target_format": "%Y-%m-%d"}, "mixed date formats", "high"))
    variants = row["normalised_count"] < row["unique_count"]
    if row["semantic_type"] == "email" and variants:
        # addresses are the same whatever their case
        out.append(_action(name, "normalize_case", {"case": "lower"}, "addresses that differ in case", "medium"))
    elif kind == "categorical" and variants:
        out.append(_action(name, "standardize_categorical", {"threshold": 80}, "variants of one value", "medium"))
    if row["missing_count"] or (kind == "numeric" and row["non_numeric_count"]):
        strategy = {"numeric": "median", "datetime": "mode", "categorical": "mode", "boolean": "mode"}.get(kind)
        if strategy and kind != "boolean" and not identifier:
            priority = "high" if row["missing_pct"] > 20 else "medium"
            out.append(_action(name, "fill_missing", {"strategy": strategy}, f"{row['missing_count']} missing", priority))
    if kind == "numeric" and row["outlier_count"] and not identifier:
        out.append(_action(name, "handle_outlier", {"method": "iqr", "action": "cap"}, f"{row['outlier_count']} outliers", "medium"))
    return out


def recommend_features(df: DataFrame, target: str | None = None, exact_distinct: bool = True) -> Plan:
    """Encoding, distribution, scaling and selection steps, in that order."""
    encoding, distribution, scaling, selection = [], [], [], []
    rows = analyze_columns(df, target, exact_distinct).collect()
    for row in rows:
        name = row["column_name"]
        if name == target:
            continue
        if row["type"] == "categorical":
            encoding.append(_encode(row, target))
        elif row["type"] == "numeric":
            if abs(row["skewness"]) > SKEWED:
                distribution.append(_reshape(row))
            scaling.append(_scale(row))
    selection += _select(df, rows)
    found = [*encoding, *distribution, *scaling, *selection]
    actions = [Action(id=f"fe_{i + 1:03d}", **a) for i, a in enumerate(found)]
    return Plan(actions, target_column=target)


def _encode(row, target) -> dict[str, Any]:
    name, k = row["column_name"], row["unique_count"]
    if k <= ONE_HOT_MAX:
        return _action(name, "one_hot_encode", {"drop_first": True}, f"{k} categories", "high")
    if target is not None:
        return _action(name, "target_encode", {"target_column": target, "smoothing": 1.0}, f"{k} categories", "high")
    return _action(name, "frequency_encode", {}, f"{k} categories, no target", "high")


def _reshape(row) -> dict[str, Any]:
    name, reason = row["column_name"], f"skewness {row['skewness']}"
    if row["skewness"] > 0 and row["min"] > 0:
        return _action(name, "log_transform", {"base": "natural"}, reason, "medium")
    return _action(name, "power_transform", {"method": "yeo-johnson"}, reason, "medium")


def _scale(row) -> dict[str, Any]:
    name = row["column_name"]
    if abs(row["skewness"]) > SKEWED or row["kurtosis"] > 3:
        return _action(name, "robust_scale", {}, "heavy tails", "medium")
    if abs(row["skewness"]) <= 0.5 and row["kurtosis"] > -1:
        return _action(name, "standard_scale", {}, "about normal", "medium")
    return _action(name, "min_max_scale", {"feature_range": [0, 1]}, "bounded values", "medium")


def _select(df: DataFrame, rows) -> list[dict[str, Any]]:
    out = []
    flat = [r for r in rows if r["type"] == "numeric" and r["std"] is not None and r["std"] ** 2 <= 0.01]
    if flat:
        out.append(_action(None, "drop_low_variance", {"threshold": 0.01}, f"{len(flat)} flat columns", "low"))
    tight = [p for p, r in correlations(df).items() if r is not None and not math.isnan(r) and abs(r) > 0.95]
    if tight:
        out.append(_action(None, "drop_highly_correlated", {"threshold": 0.95}, f"{len(tight)} pairs", "low"))
    return out


