"""Existence of keys in another table ("must exist in customer.c_custkey").

A row passes when its key is NULL or occurs in the reference column. The
distinct keys of both sides are compared, never their rows:

1. the keys of the frame are grouped with their counts (map-side combine, so
   a key with a third of all rows is one row per task), and those that the
   reference does not have are kept by an anti join; they are written once,
   their number and size observed;
2. their rows are flagged as uniqueness flags duplicated keys: by a broadcast
   while the list of missing keys is small (the usual case), beyond that with
   NULL and hot keys decided without a join and the rest joined on the key.

The reference is read once, column-pruned, and no copy of it goes to the tasks.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.grammar import exists_ref
from ..functions.sql import quote_ident
from ..plans.shared import materialize
from .unique import flag_listed_keys, key_bytes, key_column, list_settings


class Reference:
    """``column`` of a frame looked up in ``table.key``; equal references are
    computed once. ``error`` says why it cannot be."""

    def __init__(self, df: DataFrame, column: str, table: str, key: str, given: dict[str, DataFrame] | None):
        self.column, self.table, self.key = column, table, key
        self.placeholder = exists_ref(quote_ident(column), table, key)
        self.error, self.keys = None, None
        c, k = quote_ident(column), quote_ident(key)
        self.sql = f"{c} IN (SELECT {k} FROM {table})"
        if column not in df.columns:
            self.error = f"column {column!r} not found"
            return
        try:
            frame = (given or {}).get(table)
            frame = df.sparkSession.table(table) if frame is None else frame
            mine, other = df.schema[column].dataType, frame.select(k).schema[0].dataType
            if isinstance(mine, (T.MapType, T.ArrayType, T.StructType)) or isinstance(other, (T.MapType, T.ArrayType, T.StructType)):
                self.error = "keys of nested types cannot be looked up"
                return
            as_mine = f"CAST({k} AS {mine.simpleString()})" if mine == other else f"TRY_CAST({k} AS {mine.simpleString()})"
            self.keys = frame.selectExpr(f"{as_mine} AS __rg_k")
        except PySparkException as e:
            self.error = next((ln.strip() for ln in str(e).splitlines() if ln.strip()), type(e).__name__)

    def __eq__(self, other):
        return isinstance(other, Reference) and (self.column, self.table, self.key) == (other.column, other.table, other.key)

    def __hash__(self):
        return hash((self.column, self.table, self.key))


def missing_keys(df: DataFrame, ref: Reference) -> tuple[DataFrame, dict]:
    """``(key, count)`` of the keys of ``df`` that the reference does not have,
    written once, with key count, bytes and largest count observed."""
    own = (df.select(key_column(df, ref.column).alias("__rg_k")).where(F.col("__rg_k").isNotNull())
           .groupBy("__rg_k").agg(F.count(F.lit(1)).alias("__rg_n")))
    there = ref.keys.where(F.col("__rg_k").isNotNull()).distinct()
    # both sides are grouped by the key already, so the merge join moves nothing again and copies no side
    return materialize(own.hint("merge").join(there.hint("merge"), "__rg_k", "left_anti"), "missing",
                       F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(key_bytes()), F.lit(0)).alias("bytes"),
                       F.coalesce(F.max("__rg_n"), F.lit(0)).alias("max_n"),
                       F.coalesce(F.sum("__rg_n"), F.lit(0)).alias("rows"))


def missing_row_count(df: DataFrame, ref: Reference) -> int:
    """Rows whose key is missing: the failure count of an existence check, from
    grouped keys alone."""
    return int(missing_keys(df, ref)[1]["rows"])


def exists_flags(df: DataFrame, flags: dict[Reference, str], onto: DataFrame | None = None, **options) -> DataFrame:
    """``onto`` (``df`` itself, or ``df`` with further columns) plus a boolean
    per reference: true when the key is NULL or known. The key passes run over
    ``df``, before any join."""
    bounds = list_settings(df, **options)
    found = {r: missing_keys(df, r) for r in flags}
    out = df if onto is None else onto
    for ref, flag in flags.items():
        out = flag_listed_keys(out, ref.column, flag, *found[ref], **bounds)
    return out
