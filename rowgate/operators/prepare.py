"""Preparation projections: strip column names (C1), trim strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.sql import quote_ident


def strip_column_names(df: DataFrame) -> DataFrame:
    """Remove leading/trailing whitespace from every column name.

    Raises ``ValueError`` when two names become equal the way the session
    compares names (case-insensitively unless ``spark.sql.caseSensitive``):
    later references to either would be ambiguous.
    """
    new = [c.strip() for c in df.columns]
    exact = str(df.sparkSession.conf.get("spark.sql.caseSensitive", "false")).lower() == "true"
    seen: dict[str, str] = {}
    for old, name in zip(df.columns, new):
        key = name if exact else name.lower()
        if key in seen:
            raise ValueError(f"columns {seen[key]!r} and {old!r} both become {name!r} after stripping")
        seen[key] = old
    if new == df.columns:
        return df
    return df.toDF(*new)


def trim_strings(df: DataFrame) -> DataFrame:
    """``trim`` every top-level string column in one projection (ASCII spaces,
    like Spark's and DuckDB's ``trim``); other columns pass untouched."""
    cols = []
    changed = False
    for f in df.schema.fields:
        c = quote_ident(f.name)
        if isinstance(f.dataType, T.StringType):
            cols.append(f"trim({c}) AS {c}")
            changed = True
        else:
            cols.append(c)
    return df.selectExpr(*cols) if changed else df


def prepare(df: DataFrame, strip: bool = True, trim: bool = True) -> DataFrame:
    if strip:
        df = strip_column_names(df)
    if trim:
        df = trim_strings(df)
    return df
