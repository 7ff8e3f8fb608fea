"""Splits (F5/F6) and invalid rows with their errors (F2/F8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.sql import quote_ident
from .checks import Check, Translator, active, apply_checks, compile_rules
from .report import any_failed, error_array, is_invalid


def invalid_split(checked: DataFrame, checks: list[Check]) -> DataFrame:
    """rows with at least one check explicitly false. ``filter`` drops
    NULL, so no ``coalesce`` is needed here."""
    if not active(checks):
        return checked.limit(0)
    return checked.where(any_failed(checks))


def valid_split(checked: DataFrame, checks: list[Check]) -> DataFrame:
    """the exact complement of F5 (a NULL check is not a failure)."""
    return checked.where(~is_invalid(checks))


def split_rows(checked: DataFrame, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    return valid_split(checked, checks), invalid_split(checked, checks)


def with_errors(checked: DataFrame, checks: list[Check], column: str = "validation_errors") -> DataFrame:
    return checked.withColumn(column, error_array(checks))


def invalid_rows(df: DataFrame, rules, translator: Translator | None = None,
                 references: dict[str, DataFrame] | None = None, **unique_options) -> DataFrame:
    """F8: business rules only (no trimming, no type checks); rows with at
    least one failed rule, original columns plus ``validation_errors``."""
    checks = compile_rules(rules, df, translator=translator, type_checks=False, references=references)
    usable = active(checks)
    checked = apply_checks(df, usable, **unique_options)
    out = with_errors(checked, usable).where(F.size("validation_errors") > 0)
    return out.select(*[F.col(quote_ident(c)) for c in df.columns], "validation_errors")
