"""Plan-shape guards for the scale properties the design relies on."""

from pyspark.sql import functions as F

from rowgate import checked_frame, failure_summary, review_sources, unique_flag
from rowgate.operators.split import invalid_split, valid_split

RULES = [("l_quantity", "double", "between 1 and 40"), ("l_returnflag", "string", "Should be one of ['A', 'N']")]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lineitem(spark):
    return spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")


def test_summary_reads_only_checked_columns(spark):
    checked, checks = checked_frame(lineitem(spark), RULES)
    plan = physical(failure_summary(checked, checks))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
    assert "Sort" not in plan  # the long form keeps check order without a global sort


def test_splits_have_no_shuffle(spark):
    checked, checks = checked_frame(lineitem(spark), RULES)
    for df in (invalid_split(checked, checks), valid_split(checked, checks)):
        plan = physical(df)
        assert "Exchange" not in plan


def test_checks_are_one_projection(spark):
    # without trimming: one Project; with trimming Catalyst keeps the trim
    # projection apart so each trim is computed once - still one codegen stage
    checked, _ = checked_frame(lineitem(spark), RULES, trim=False)
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Project") == 1
    checked, _ = checked_frame(lineitem(spark), RULES)
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Project") == 2
    assert "Exchange" not in physical(checked)


def test_uniqueness_broadcast_path_never_shuffles_rows(spark):
    keys = lineitem(spark).select("l_orderkey", "l_linenumber")
    plan = physical(unique_flag(keys, "l_orderkey", "ok"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_uniqueness_shuffle_path_replicates_nothing(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = lineitem(spark).select("l_orderkey", "l_linenumber")
        plan = physical(unique_flag(keys, "l_orderkey", "ok", broadcast_max_keys=0, rows_per_hot=2))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan  # the rest; the bounded hot-key list
        assert "Generate" not in plan and "monotonically_increasing_id" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_review_is_map_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = physical(review_sources(docs, path="doc_id"))
    assert "Exchange" not in plan and "Sort" not in plan and "Aggregate" not in plan
    assert F is not None
