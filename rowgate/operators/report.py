"""Results: per-row error arrays (F1), failure counts and summary (F3/F4),
split counts (F7).

Expressions over many checks are written as Spark SQL text and handed over
in one call (``selectExpr`` / ``F.expr``): Catalyst builds the same plan as
with ``Column`` objects, without one Python-to-JVM round trip per column.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.fixed import ERROR_MESSAGE
from ..functions.sql import quote_ident, quote_str
from .checks import Check, active


def _false(check: Check) -> str:
    return f"({quote_ident(check.name)} = false)"


def error_message(check: Check) -> str:
    rule = check.rule if check.kind != "type" else f"castable to {check.data_type}"
    return ERROR_MESSAGE.format(column=check.column_name, rule=rule)


def error_array(checks: list[Check]) -> Column:
    """messages of the checks that are explicitly false, in check order;
    a NULL check is not an error. Always ``array<string>``."""
    parts = [f"CASE WHEN {_false(c)} THEN {quote_str(error_message(c))} END" for c in active(checks)]
    if not parts:
        return F.array().cast(T.ArrayType(T.StringType()))
    return F.expr(f"array_compact(array({', '.join(parts)}))")


def failure_counts(checked: DataFrame, checks: list[Check]) -> DataFrame:
    """one row, ``total_records`` plus one failure count per check (one
    aggregation pass; NULL checks are not failures)."""
    return checked.selectExpr("count(1) AS total_records",
                              *[f"count_if({_false(c)}) AS {quote_ident(c.name)}" for c in active(checks)])


def summary_from_counts(counts: DataFrame, checks: list[Check]) -> DataFrame:
    """Long form of F3: ``(check_name, failed_records, failure_rate_pct)`` for
    checks with at least one failure, in check order; empty for an empty
    table. Stays on the executors: the one-row aggregate is exploded with
    ``inline`` (its single partition keeps the array's check order, so no
    sort is needed)."""
    checks = active(checks)
    if not checks:
        return counts.sparkSession.createDataFrame([], SUMMARY_SCHEMA)
    entries = ", ".join(f"named_struct('check_name', {quote_str(c.name)}, "
                        f"'failed_records', CAST({quote_ident(c.name)} AS BIGINT))" for c in checks)
    return (counts.selectExpr("total_records", f"inline(array({entries}))")
            .where("total_records > 0 AND failed_records > 0")
            .selectExpr("check_name", "failed_records",
                        "CAST(round(failed_records / total_records * 100, 2) AS DOUBLE) AS failure_rate_pct"))


SUMMARY_SCHEMA = "check_name string, failed_records bigint, failure_rate_pct double"


def rate_pct(failed: int, total: int) -> float:
    """``round(failed / total * 100, 2)`` with Spark's HALF_UP rounding of the
    double's shortest decimal form (Python's ``round`` is half-even)."""
    x = failed / total * 100
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def summary_from_totals(spark: SparkSession, checks: list[Check], total: int, failed: list[int]) -> DataFrame:
    """F4 from counts already on the driver (one number per check, e.g.
    observed during a write): a local relation, no extra job."""
    rows = [(c.name, int(f), rate_pct(int(f), total)) for c, f in zip(active(checks), failed)
            if total > 0 and f > 0]
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


def failure_summary(checked: DataFrame, checks: list[Check]) -> DataFrame:
    """F4 over an already-checked frame."""
    return summary_from_counts(failure_counts(checked, checks), checks)


def any_failed(checks: list[Check]) -> Column:
    """OR of ``check = false``: true when some check failed, NULL when none
    failed but some check was NULL, false otherwise."""
    conds = [_false(c) for c in active(checks)]
    if not conds:
        return F.lit(False)
    return F.expr(" OR ".join(conds))


def is_invalid(checks: list[Check]) -> Column:
    """Null-safe: invalid exactly when some check is explicitly false."""
    return F.coalesce(any_failed(checks), F.lit(False))


def split_counts(checked: DataFrame, checks: list[Check]) -> DataFrame:
    """``(split, records)`` for the valid and invalid parts, one pass."""
    return (checked.groupBy(F.when(is_invalid(checks), F.lit("invalid")).otherwise(F.lit("valid")).alias("split"))
            .agg(F.count(F.lit(1)).alias("records")))
