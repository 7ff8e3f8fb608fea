"""Rule type names and Spark type labels."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_ALIASES = {
    "integer": "int",
    "long": "bigint",
    "short": "smallint",
    "byte": "tinyint",
    "real": "float",
    "bool": "boolean",
    "str": "string",
    "text": "string",
    "varchar": "string",
    "datetime": "timestamp",
}

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def normalize_type(data_type: str | None) -> str:
    """Lower-case, whitespace-free type text with common aliases resolved."""
    text = re.sub(r"\s+", "", (data_type or "string").strip().lower())
    return _ALIASES.get(text, text)


def is_numeric_type(data_type: str) -> bool:
    t = normalize_type(data_type)
    return t in NUMERIC_TYPES or t.startswith("decimal") or t.startswith("numeric")


def is_string_type(data_type: str) -> bool:
    t = normalize_type(data_type)
    return t == "string" or t.startswith("varchar") or t.startswith("char")


def type_label(dt: T.DataType) -> str:
    """Rule type label for a Spark column type (profiler, D1)."""
    if isinstance(dt, T.IntegerType):
        return "int"
    if isinstance(dt, T.LongType):
        return "bigint"
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.StringType):
        return "string"
    return dt.simpleString()
