"""Write-through cache of translated rules.

An append-only table ``(column_name, data_type, rule, expression, written_at,
writer)`` keyed by the first three; the last write of a key wins. Rule texts
outside the grammar go to the translator once per key, in this run and in all
later ones that use the same table.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.grammar import RuleSyntaxError
from ..functions.types import normalize_type
from ..plans.shared import path_exists

SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()), T.StructField("data_type", T.StringType()), T.StructField("rule", T.StringType()),
    T.StructField("expression", T.StringType()), T.StructField("written_at", T.TimestampType()), T.StructField("writer", T.StringType()),
    T.StructField("place", T.IntegerType()),
])
KEY = ["column_name", "data_type", "rule"]


def _key(column: str, data_type: str, rule: str) -> tuple[str, str, str]:
    return column, normalize_type(data_type), rule


def read_expressions(spark: SparkSession, path: str) -> DataFrame:
    """The cache's present content, one row per key (the last one written);
    empty when nothing was written yet."""
    rows = spark.createDataFrame([], SCHEMA)
    try:
        if path_exists(spark, path):
            rows = spark.read.schema(SCHEMA).parquet(path)
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return rows.groupBy(*KEY).agg(F.max_by("expression", F.struct("written_at", "writer", "place")).alias("expression"))


class ExpressionCache:
    """A translator ``(column, type, rule) -> SQL`` in front of ``translator``.

    What the translator answers is remembered and appended to the table by
    ``flush`` (``compile_rules`` calls it), also when a later rule fails. A
    translator that raises is asked again the next time. Expressions are kept
    as given: the current time in them is bound per run, not here. The keys
    held are rule texts, a handful per table, so they are read once.
    """

    def __init__(self, spark: SparkSession, path: str, translator=None):
        self.spark, self.path, self.translator = spark, path, translator
        self.writer, self.asked = uuid.uuid4().hex, 0
        self._known = {tuple(r[c] for c in KEY): r.expression for r in read_expressions(spark, path).collect()}
        self._new: list[tuple] = []

    def __call__(self, column: str, data_type: str, rule: str) -> str:
        key = _key(column, data_type, rule)
        if key not in self._known:
            if self.translator is None:
                raise RuleSyntaxError(f"no cached expression for {key}")
            self.asked += 1
            self.put(column, data_type, rule, self.translator(column, data_type, rule))
        return self._known[key]

    def put(self, column: str, data_type: str, rule: str, expression: str) -> None:
        """Remember an expression, in place of any former one of its key."""
        key = _key(column, data_type, rule)
        self._known[key] = expression
        self._new.append((*key, expression, datetime.now(timezone.utc), self.writer, len(self._new)))

    def flush(self) -> None:
        """Append what is new, as one file; writers never touch each other's."""
        if self._new:
            self.spark.createDataFrame(self._new, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self._new = []


def compact_expressions(spark: SparkSession, path: str, target: str) -> int:
    """Write one row per key of the cache at ``path`` to the new path
    ``target`` and return how many there are; the old files stay readable."""
    rows = read_expressions(spark, path).collect()
    cache = ExpressionCache(spark, target)
    for r in rows:
        cache.put(*[r[c] for c in KEY], r.expression)
    cache.flush()
    return len(rows)
