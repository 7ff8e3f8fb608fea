import pytest
from pyspark.sql import functions as F

from rowgate import run_validation, validation_summary
from rowgate.operators.checks import apply_checks, compile_rules
from rowgate.operators.references import Reference, missing_keys


def frames(spark):
    orders = spark.createDataFrame([(1, 10, "a"), (2, 11, "b"), (3, 99, "zz"), (4, None, None), (5, 10, "a"), (6, 98, " ")],
                                   "id int, cust int, code string")
    customers = spark.createDataFrame([(10, "a"), (11, "b"), (11, "b"), (None, None)], "c_id long, c_code string")
    return orders, customers


RULES = [("cust", "int", "must exist in customers.c_id"), ("code", "string", "must reference customers(c_code)"),
         ("cust", "int", "not null and must exist in customers.c_id"), ("cust", "int", "must not exist in customers.c_id"),
         ("cust", "int", "if code is 'zz' then must exist in customers.c_id"), ("cust", "int", "must exist in nowhere.c_id"),
         ("cust", "int", "must exist in customers.nope"), ("cust", "int", "present in the c_id column of customers")]


@pytest.mark.parametrize("options", [{}, {"broadcast_max_keys": 0}, {"broadcast_max_keys": 0, "rows_per_hot": 0, "max_hot_keys": 1}])
def test_keys_are_looked_up(spark, options):
    orders, customers = frames(spark)
    checks = compile_rules(RULES, orders, type_checks=False, references={"customers": customers})
    assert [c.error is not None for c in checks] == [False] * 5 + [True, True, False]
    assert [c.kind for c in checks[:3]] == ["exists", "exists", "rule"]
    assert checks[0].expression == "(`cust` IS NULL) OR (`cust` IN (SELECT `c_id` FROM customers))"
    rows = {r.id: r for r in apply_checks(orders, checks, **options).collect()}
    got = [[rows[i][c.name] for i in range(1, 7)] for c in checks if c.ok]
    assert got == [[True, True, False, True, True, False], [True, True, False, True, True, False], [True, True, False, False, True, False],
                   [False, False, True, True, False, True], [True, True, False, True, True, True], [True, True, False, True, True, False]]


def test_catalog_tables_summary_and_run(spark, tmp_path):
    orders, customers = frames(spark)
    customers.createOrReplaceTempView("rg_customers")
    rules = [("cust", "int", "must exist in rg_customers.c_id"), ("id", "int", "not null")]
    summary = {r.check_name: r.failed_records for r in validation_summary(orders, rules).collect()}
    assert summary == {"cust_must_exist_in_rg_customers_c_i_0_ok": 2}
    res = run_validation(orders, rules, f"{tmp_path}/v", f"{tmp_path}/i")
    assert (res.valid_count, res.invalid_count) == (4, 2)


def test_types_are_matched_to_the_checked_column(spark):
    left = spark.createDataFrame([("10",), ("011",), ("x",)], "k string")
    right = spark.createDataFrame([(10,), (11,)], "k int")
    c = compile_rules([("k", "string", "must exist in r.k")], left, type_checks=False, references={"r": right})
    assert [r[1] for r in apply_checks(left, c).orderBy("k").collect()] == [False, True, False]
    c = compile_rules([("k", "int", "must exist in l.k")], right, type_checks=False, references={"l": left})
    assert [r[1] for r in apply_checks(right, c).orderBy("k").collect()] == [True, True]  # "011" is 11, "x" is no int


def test_no_copy_of_the_reference_and_hot_keys_are_grouped_first(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 30_000, 2).toDF("k")
    ref = Reference(left, "k", "r", "k", {"r": right})
    missing, stats = missing_keys(left, ref)
    assert stats["rows"] == left.where("k = 7 OR k % 2 = 1").count() and stats["max_n"] == 10_001
    checks = compile_rules([("k", "bigint", "must exist in r.k")], left, type_checks=False, references={"r": right})
    out = apply_checks(left, checks, broadcast_max_keys=0, rows_per_hot=100)
    assert out.where(f"NOT {checks[0].name}").count() == stats["rows"] and out.count() == 30_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the reference itself is in no plan any more, only the written list of missing keys is
    assert "Range (0, 30000, step=2" not in plan
    own = left.select(F.col("k").alias("__rg_k")).groupBy("__rg_k").agg(F.count(F.lit(1)).alias("__rg_n"))
    joined = own.hint("merge").join(ref.keys.distinct().hint("merge"), "__rg_k", "left_anti")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
