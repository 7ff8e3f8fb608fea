"""Sample rows generated from a rule set (G1), as a distributed generator.

Columns come from the rules (first rule naming a column fixes its type).
Row ``i`` of ``spark.range(n)`` gets a typed value per column; one all-NULL
row is appended. ``n = 4`` gives the tool's original five demonstration
rows; larger ``n`` scales out like any ``range`` (day of month cycles every
28 days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.fixed import (
    SAMPLE_DOUBLE_STEP,
    SAMPLE_EMAIL,
    SAMPLE_FIRST_DATE,
    SAMPLE_INT_STEP,
    SAMPLE_INVALID_EMAIL,
    SAMPLE_NAME,
    SAMPLE_OTHER,
    SAMPLE_ROWS,
    SAMPLE_STATUS_EVEN,
    SAMPLE_STATUS_ODD,
    SAMPLE_TIME_OF_DAY,
)
from ..functions.types import normalize_type

ROWS_PER_PARTITION = 10_000_000
from ..sources.rules_io import collect_rules


def columns_from_rules(rules) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for r in collect_rules(rules):
        name = r.get("column_name")
        if name and name not in out:
            out[name] = normalize_type(r.get("data_type"))
    return list(out.items())


def _fmt(template: str, i: Column) -> Column:
    head, _, tail = template.partition("{i}")
    return F.concat(F.lit(head), i.cast("string"), F.lit(tail))


def _value(name: str, data_type: str, i: Column) -> Column:
    lname = name.lower()
    if data_type in ("int", "bigint"):
        return ((i + 1) * SAMPLE_INT_STEP).cast(data_type)
    if data_type == "double":
        return (i + 1).cast("double") * F.lit(SAMPLE_DOUBLE_STEP)
    if data_type == "string":
        if "email" in lname:
            return F.when(i > 0, _fmt(SAMPLE_EMAIL, i)).otherwise(F.lit(SAMPLE_INVALID_EMAIL))
        if "status" in lname:
            return F.when(i % 2 == 0, F.lit(SAMPLE_STATUS_EVEN)).otherwise(F.lit(SAMPLE_STATUS_ODD))
        if "name" in lname:
            return _fmt(SAMPLE_NAME, i)
        return _fmt(SAMPLE_OTHER, i)
    day = F.date_add(F.lit(SAMPLE_FIRST_DATE).cast("date"), F.pmod(i, F.lit(28)).cast("int"))
    if data_type == "date":
        return day
    if data_type == "timestamp":
        return F.to_timestamp(F.concat(day.cast("string"), F.lit(" " + SAMPLE_TIME_OF_DAY)))
    if data_type == "boolean":
        return i % 2 == 0
    return F.lit(None)


def _spark_type(data_type: str) -> T.DataType:
    try:
        return T._parse_datatype_string(data_type)
    except Exception:
        return T.StringType()


def sample_rows(spark: SparkSession, rules, n: int = SAMPLE_ROWS, null_row: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """``n`` generated rows (plus an all-NULL row) with an explicit schema."""
    cols = columns_from_rules(rules)
    if not cols:
        return spark.createDataFrame([], T.StructType([]))
    i = F.col("id")
    if num_partitions is None and n > ROWS_PER_PARTITION:
        # bounded task size for large n (range would otherwise use one slice per core)
        try:
            cores = spark.sparkContext.defaultParallelism
        except Exception:  # no SparkContext on a Spark Connect client
            cores = 1
        num_partitions = max(cores, -(-n // ROWS_PER_PARTITION))
    body = spark.range(0, n, numPartitions=num_partitions).select(
        F.col("id").alias("__rg_row"),
        *[_value(name, t, i).cast(_spark_type(t)).alias(name) for name, t in cols])
    if null_row:
        nulls = spark.range(n, n + 1, numPartitions=1).select(
            F.col("id").alias("__rg_row"), *[F.lit(None).cast(_spark_type(t)).alias(name) for name, t in cols])
        body = body.unionByName(nulls)
    return body.drop("__rg_row")
