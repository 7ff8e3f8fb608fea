from pyspark.sql import functions as F

from rowgate.operators.checks import apply_checks, compile_rules
from rowgate.operators.report import error_array, failure_summary, split_counts
from rowgate.operators.split import invalid_rows, split_rows
from rowgate.plans.fixtures import DIRTY_RULES, dirty_customers
from rowgate.plans.runner import checked_frame

EXPECTED = {  # FIXTURES section 3, sf0.01
    "age_type_ok": 116, "signup_type_ok": 66, "id_not_null_0_ok": 30,
    "status_should_be_one_of___active____i_2_ok": 375, "email_should_be_a_valid_email_addres_1_ok": 222,
    "age_value_must_be_greater_than_18_3_ok": 280, "id_must_be_unique_5_ok": 60,
}


def dirty_checked(spark):
    return checked_frame(dirty_customers(spark.read.parquet("/root/testdata/sf0.01/customer.parquet")), DIRTY_RULES)


def test_failure_summary_matches_fixture(spark):
    checked, checks = dirty_checked(spark)
    rows = failure_summary(checked, checks).collect()
    assert {r.check_name: r.failed_records for r in rows} == EXPECTED
    assert [r.check_name for r in rows] == [c.name for c in checks if c.name in EXPECTED]
    rate = {r.check_name: r.failure_rate_pct for r in rows}
    assert rate["age_type_ok"] == round(116 / 1500 * 100, 2)


def test_split_is_exact_partition(spark):
    checked, checks = dirty_checked(spark)
    valid, invalid = split_rows(checked, checks)
    counts = {r.split: r.records for r in split_counts(checked, checks).collect()}
    assert counts == {"invalid": 809, "valid": 691}
    assert valid.count() == 691 and invalid.count() == 809


def test_null_check_is_not_a_failure(spark):
    df = spark.createDataFrame([("abc",), ("20",), ("5",), (None,)], "age string")
    checks = compile_rules([("age", "int", "greater than 18")], df, type_checks=False)
    checked = apply_checks(df, checks)
    valid, invalid = split_rows(checked, checks)
    # 'abc' gives NULL (no type check here) -> valid; only '5' fails
    assert sorted(r.age or "" for r in invalid.collect()) == ["5"]
    assert valid.count() + invalid.count() == 4


def test_error_array_order_and_compaction(spark):
    df = spark.createDataFrame([(None, "bad"), (1, "a@b.co")], "id int, email string")
    checks = compile_rules([("id", "int", "Not Null"), ("email", "string", "Should be a valid email address")],
                           df, type_checks=False)
    rows = apply_checks(df, checks).select("id", error_array(checks).alias("e")).collect()
    errs = {r.id: r.e for r in rows}
    assert errs[None] == ["FAILED RULE: For column 'id', rule was: 'Not Null'",
                          "FAILED RULE: For column 'email', rule was: 'Should be a valid email address'"]
    assert errs[1] == []


def test_invalid_rows_returns_failing_rows_only(spark):
    df = spark.createDataFrame([(None, "bad"), (1, "a@b.co"), (2, "a@bxcom")], "id int, email string")
    out = invalid_rows(df, [("id", "int", "Not Null"), ("email", "string", "Should be a valid email address")])
    got = {r.email: r.validation_errors for r in out.collect()}
    assert set(got) == {"bad", "a@bxcom"}  # strict dot: a@bxcom is not an email
    assert len(got["bad"]) == 2


def test_empty_table_has_empty_summary(spark):
    df = spark.createDataFrame([], "id int")
    checks = compile_rules([("id", "int", "Not Null")], df)
    assert failure_summary(apply_checks(df, checks), checks).count() == 0
    assert F is not None


def test_driver_rate_matches_spark_round(spark):
    from rowgate.operators.report import rate_pct
    cases = [(1, 3), (2, 3), (116, 1500), (1, 8), (1, 16), (5, 7), (1005, 100000), (12345, 1000000)]
    df = spark.createDataFrame(cases, "f long, t long")
    got = [r.r for r in df.select(F.round(F.col("f") / F.col("t") * 100, 2).alias("r")).collect()]
    assert got == [rate_pct(f, t) for f, t in cases]


def test_validation_summary_matches_joined_summary(spark):
    from rowgate.plans.runner import validation_summary
    df = dirty_customers(spark.read.parquet("/root/testdata/sf0.01/customer.parquet"))
    checked, checks = checked_frame(df, DIRTY_RULES)
    joined = [tuple(r) for r in failure_summary(checked, checks).collect()]
    assert [tuple(r) for r in validation_summary(df, DIRTY_RULES).collect()] == joined


def test_validation_summary_reads_keys_without_joining_rows(spark):
    from rowgate.operators.unique import duplicated_keys
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = duplicated_keys(df, "l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_validation_summary_with_string_key(spark):
    from rowgate.plans.runner import validation_summary
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",), ("c",), ("c",)], "k string")
    rows = {r.check_name: r.failed_records for r in validation_summary(df, [("k", "string", "unique")]).collect()}
    assert rows == {"k_unique_0_ok": 5}
