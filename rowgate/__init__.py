"""rowgate: rule-driven data quality on Spark DataFrames."""

from .api import Validator, review_notebook

from .operators.checks import Check, active, apply_checks, compile_rules, compiled_rules, expression_cache
from .operators.prepare import prepare, strip_column_names, trim_strings
from .operators.profile import profile_columns, suggest_rules
from .operators.report import error_array, failure_counts, failure_summary, split_counts
from .operators.review import review_sources, secret_lines, source_lines
from .operators.split import invalid_rows, invalid_split, split_rows, valid_split, with_errors
from .operators.synth import sample_rows
from .operators.unique import unique_flag
from .plans.shared import scratch_scope
from .plans.publish import Published, commit_log, drop_former, publish_validation, published
from .plans.runner import (RulesRefused, ValidationResult, checked_frame, run_validation, run_validation_single_pass,
                          validation_summary)
from .sources.expressions import ExpressionCache, read_expressions
from .sources.rules_io import export_rules, load_rules, read_sample, rule_stats, rules_frame
from .sources.tables import load_table, preview, write_frame

__all__ = [
    "Check", "ExpressionCache", "Published", "RulesRefused", "commit_log", "drop_former", "publish_validation", "published", "read_expressions",
    "ValidationResult", "Validator", "review_notebook", "active", "apply_checks", "checked_frame", "compile_rules", "compiled_rules",
    "error_array", "expression_cache", "export_rules", "failure_counts", "failure_summary", "invalid_rows", "invalid_split",
    "load_rules", "load_table", "prepare", "preview", "profile_columns", "read_sample", "review_sources",
    "rule_stats", "rules_frame", "scratch_scope", "run_validation", "run_validation_single_pass", "sample_rows", "secret_lines", "source_lines", "split_counts",
    "split_rows", "strip_column_names", "suggest_rules", "trim_strings", "unique_flag", "valid_split", "validation_summary",
    "with_errors", "write_frame",
]
