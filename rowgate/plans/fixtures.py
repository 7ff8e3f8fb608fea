"""Test-table derivations: a "dirty" customer table with NULLs, bad casts,
padded strings and duplicate ids, derived row by row from ``customer``.

The key arithmetic only decides *which* rows carry which defect; every
customer row is kept, so the table grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DIRTY_RULES = [
    ("id", "bigint", "Not Null"),
    ("email", "string", "Should be a valid email address"),
    ("status", "string", "Should be one of ['ACTIVE', 'INACTIVE']"),
    ("age", "int", "value must be greater than 18"),
    ("signup", "date", "Not Null"),
    ("id", "bigint", "Must be unique"),
]


def dirty_customers(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        F.when(k % 50 == 0, F.lit(None).cast("bigint")).when(k % 40 == 1, k - 1).otherwise(k).alias("id"),
        F.when(k % 10 == 0, F.lit("invalid-email")).when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 17 == 0, F.lit("user@examplexcom"))
        .otherwise(F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(k % 4 == 0, F.lit("  ACTIVE ")).when(k % 4 == 1, F.lit("INACTIVE"))
        .when(k % 4 == 2, F.lit("PENDING")).otherwise(F.lit(None).cast("string")).alias("status"),
        F.when(k % 13 == 0, F.lit("abc")).when(k % 19 == 0, F.lit(None).cast("string"))
        .otherwise((k % 90).cast("string")).alias("age"),
        F.when(k % 23 == 0, F.lit("2024-13-01")).otherwise(F.lit("2024-01-15")).alias("signup"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


DIRTY_SQL = """
SELECT
  CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 40 = 1 THEN c_custkey - 1 ELSE c_custkey END AS id,
  CASE WHEN c_custkey % 10 = 0 THEN 'invalid-email' WHEN c_custkey % 11 = 0 THEN NULL
       WHEN c_custkey % 17 = 0 THEN 'user@examplexcom'
       ELSE 'user' || CAST(c_custkey AS VARCHAR(20)) || '@example.com' END AS email,
  CASE c_custkey % 4 WHEN 0 THEN '  ACTIVE ' WHEN 1 THEN 'INACTIVE' WHEN 2 THEN 'PENDING' ELSE NULL END AS status,
  CASE WHEN c_custkey % 13 = 0 THEN 'abc' WHEN c_custkey % 19 = 0 THEN NULL
       ELSE CAST(c_custkey % 90 AS VARCHAR(20)) END AS age,
  CASE WHEN c_custkey % 23 = 0 THEN '2024-13-01' ELSE '2024-01-15' END AS signup,
  c_acctbal AS balance, c_mktsegment AS segment
FROM customer
"""
