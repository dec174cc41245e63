"""Tabular analytics on Spark DataFrames: load, filter, sort, cross-tabulate, bin, export."""

from .functions.missing import drop_missing, normalise_missing
from .functions.predicates import all_of, any_of, eq, ge, gt, le, like, lt, ne, regex_like
from .operators.bins import bin_labels, deciles, equal_count_bins, equal_width_bins, percentiles
from .operators.crosstab import pivot, pivot_labels
from .operators.rows import limit, match_count, order_by, project, show, top_k, view, where
from .operators.statistics import (
    exact_quantiles,
    iqr_filter,
    iqr_report,
    profile,
    value_counts,
)
from .sources.csv import infer_types, read_csv
from .sources.json import to_json_records, write_json
from .sources.position import with_position

__all__ = [
    "all_of",
    "any_of",
    "bin_labels",
    "deciles",
    "drop_missing",
    "eq",
    "equal_count_bins",
    "equal_width_bins",
    "exact_quantiles",
    "ge",
    "gt",
    "infer_types",
    "iqr_filter",
    "iqr_report",
    "le",
    "like",
    "limit",
    "lt",
    "match_count",
    "ne",
    "normalise_missing",
    "order_by",
    "percentiles",
    "pivot",
    "pivot_labels",
    "profile",
    "project",
    "read_csv",
    "regex_like",
    "show",
    "to_json_records",
    "top_k",
    "value_counts",
    "view",
    "where",
    "with_position",
    "write_json",
]
