from pyspark.sql import functions as F

from rowgate.operators.profile import profile_columns, suggest_rules
from rowgate.plans.runner import checked_frame
from rowgate.operators.report import split_counts


def rules_of(df):
    return [(r.column_name, r.data_type, r.rule) for r in suggest_rules(df).collect()]


def test_suggestions_in_column_order(spark):
    df = spark.createDataFrame(
        [(1, "a@x.com", " ACTIVE ", 1.5, True), (2, "b@x.com", "INACTIVE", None, False),
         (3, "c@x.com", "ACTIVE", 2.5, True), (4, "nope", "ACTIVE", 2.5, None)],
        "id bigint, mail string, status string, score double, flag boolean")
    assert rules_of(df) == [
        ("id", "bigint", "Not Null"), ("id", "bigint", "Must be unique"),
        ("mail", "string", "Not Null"), ("mail", "string", "Must be unique"),
        ("mail", "string", "Should be one of ['a@x.com', 'b@x.com', 'c@x.com', 'nope']"),
        # 3 of 4 match: 0.75 is not > 0.8, so no email rule
        ("status", "string", "Not Null"),
        ("status", "string", "Should be one of ['ACTIVE', 'INACTIVE']"),  # trimmed first
    ]


def test_email_share_and_in_list_bounds(spark):
    rows = [(f"user{i}@example.com",) for i in range(9)] + [("x",)]
    df = spark.createDataFrame(rows, "e string")
    got = rules_of(df)
    assert ("e", "string", "Should be a valid email address") in got  # 0.9 > 0.8
    assert any(r[2].startswith("Should be one of") for r in got)  # 10 distinct values: still an in-list
    df2 = spark.createDataFrame([(f"v{i}",) for i in range(11)], "e string")
    assert not any(r[2].startswith("Should be one of") for r in rules_of(df2))


def test_in_list_escapes_quotes(spark):
    df = spark.createDataFrame([("O'B",), ("A",), ("A",)], "s string")
    assert ("s", "string", "Should be one of ['A', 'O''B']") in rules_of(df)


def test_types_use_real_spark_types(spark):
    df = spark.createDataFrame([(1, 2, "2024-01-01")], "a int, b bigint, c string") \
        .withColumn("d", F.to_date("c")).withColumn("e", F.col("c").cast("timestamp"))
    types = {r.column_name: r.data_type for r in suggest_rules(df).collect()}
    assert types == {"a": "int", "b": "bigint", "c": "string", "d": "date", "e": "timestamp"}


def test_round_trip_has_no_failures(spark):
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        checked, checks = checked_frame(df, suggest_rules(df))
        assert {r.split: r.records for r in split_counts(checked, checks).collect()} == {"valid": df.count()}


def test_profile_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    p = {r.column_name: r for r in profile_columns(df).collect()}
    assert p["o_orderkey"].is_unique and not p["o_custkey"].is_unique
    assert p["o_orderstatus"].small_distinct == 3 and p["o_orderstatus"]["values"] == ["F", "O", "P"]
    assert all(r.null_count == 0 for r in p.values())


def test_in_list_with_nulls_keeps_all_ten_values(spark):
    rows = [(f"v{i}",) for i in range(10)] * 30 + [(None,)] * 500
    df = spark.createDataFrame(rows, "e string").repartition(6)
    got = [r[2] for r in rules_of(df) if r[2].startswith("Should be one of")]
    assert got == ["Should be one of [" + ", ".join(f"'v{i}'" for i in range(10)) + "]"]


def test_column_batches_give_same_result(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    one = [tuple(r) for r in suggest_rules(df).collect()]
    batched = [tuple(r) for r in suggest_rules(df, batch_columns=3).collect()]
    assert one == batched
    p1 = [tuple(r) for r in profile_columns(df).collect()]
    p3 = [tuple(r) for r in profile_columns(df, batch_columns=4).collect()]
    assert p1 == p3


def test_unique_pass_counts_hashes_not_values(spark):
    from rowgate.operators.profile import _pairs, _profile, _surely_repeated, _unique_columns
    from pyspark.sql import types as T
    df = spark.createDataFrame([(i, f"text {i}" * 50, i % 7, float(i % 3)) for i in range(500)] + [(None, None, None, None)],
                               "a long, t string, low int, x double")
    cols = [{"position": i, "name": c, "sql": f"`{c}`", "dtype": T.StringType()} for i, c in enumerate(df.columns)]
    assert _surely_repeated(df, cols) == {2, 3}
    assert _unique_columns(df, cols) == {0, 1}  # exact also without the first proof
    plan = _pairs(df, cols, "xxhash64({c})").groupBy("pos", "v").count()._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "hashpartitioning(pos" in plan
    assert [s["unique"] for s in _profile(df)] == [True, True, False, False]


def test_nan_is_missing_and_hard_values_survive_the_round_trip(spark):
    nan = float("nan")
    odd = ["a\\b", "ends\\", "O'B", "two  spaces", "x, y", "01", 'say "x"', "['z']"]
    df = spark.createDataFrame([(v, nan if i == 2 else float(i)) for i, v in enumerate(odd * 2)], "v string, x double")
    rules = rules_of(df)
    assert ("x", "double", "Not Null") not in rules
    assert any(r[0] == "v" and r[2].startswith("Should be one of") for r in rules)
    checked, checks = checked_frame(df, rules)
    assert {r.split: r.records for r in split_counts(checked, checks).collect()} == {"valid": 16}
