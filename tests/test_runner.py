import os

from rowgate.plans.fixtures import DIRTY_RULES, dirty_customers
from rowgate.plans.runner import run_validation


def test_run_validation_writes_both_outputs(spark, tmp_path):
    df = dirty_customers(spark.read.parquet("/root/testdata/sf0.01/customer.parquet"))
    res = run_validation(df, DIRTY_RULES, str(tmp_path / "valid"), str(tmp_path / "invalid"))
    assert (res.valid_count, res.invalid_count) == (691, 809)
    valid = spark.read.parquet(str(tmp_path / "valid"))
    invalid = spark.read.parquet(str(tmp_path / "invalid"))
    assert valid.columns == df.columns
    assert invalid.columns == df.columns + [c.name for c in res.checks if c.ok]
    assert valid.count() == 691 and invalid.count() == 809
    assert {r.check_name: r.failed_records for r in res.summary.collect()}["id_must_be_unique_5_ok"] == 60


def test_no_rules_writes_everything_valid_and_empty_invalid(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    res = run_validation(df, [], str(tmp_path / "v"), str(tmp_path / "i"))
    assert res.valid_count == 2 and res.invalid_count == 0
    assert spark.read.parquet(str(tmp_path / "i")).count() == 0


def test_clean_run_overwrites_old_invalid_output(spark, tmp_path):
    bad = spark.createDataFrame([(None,)], "a int")
    good = spark.createDataFrame([(1,)], "a int")
    rules = [("a", "int", "Not Null")]
    run_validation(bad, rules, str(tmp_path / "v"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 1
    run_validation(good, rules, str(tmp_path / "v"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 0
    assert os.path.exists(tmp_path / "v")


def test_single_pass_layout(spark, tmp_path):
    from rowgate.plans.runner import run_validation_single_pass
    df = dirty_customers(spark.read.parquet("/root/testdata/sf0.01/customer.parquet"))
    res = run_validation_single_pass(df, DIRTY_RULES, str(tmp_path / "out"))
    assert (res.valid_count, res.invalid_count) == (691, 809)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"valid": 691, "invalid": 809}
    assert {r.check_name: r.failed_records for r in res.summary.collect()}["age_type_ok"] == 116
    assert spark.read.parquet(res.invalid_path).count() == 809


def test_read_sample_null_tokens(spark, tmp_path):
    from rowgate.sources.rules_io import read_sample
    p = tmp_path / "s.csv"
    p.write_text("id,name,score\n1,a,1.5\n2,NA,\n3,null,2\n")
    df = read_sample(spark, str(p), null_tokens=["NA", "null"])
    assert [r.name for r in df.orderBy("id").collect()] == ["a", None, None]
    assert dict(df.dtypes)["id"] == "int"


def test_scratch_tables_are_removed_after_a_run(spark, tmp_path):
    import glob
    from rowgate.plans.shared import shared_dir
    base = shared_dir(spark).replace("file:", "")
    before = set(glob.glob(f"{base}/rowgate-dupkeys-*"))
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    res = run_validation(df, [("id", "int", "Must be unique")], str(tmp_path / "v"), str(tmp_path / "i"))
    assert res.invalid_count == 2
    assert set(glob.glob(f"{base}/rowgate-dupkeys-*")) == before


def test_time_rules_lose_no_row(spark, tmp_path):
    """Timestamps spread over the time the run takes: each row is in exactly one output."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    start = datetime.now()
    df = spark.range(4000).select("id", (F.lit(start) + F.make_dt_interval(secs=F.col("id") / 400)).alias("ts"))
    res = run_validation(df, [("ts", "timestamp", "not in the future")], f"{tmp_path}/v", f"{tmp_path}/i")
    v, i = spark.read.parquet(f"{tmp_path}/v").count(), spark.read.parquet(f"{tmp_path}/i").count()
    assert v + i == 4000 == res.total and v == res.valid_count and i == res.invalid_count
    assert start - timedelta(days=1) < start


def test_source_that_changes_between_reads_is_decided_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from rowgate.plans.runner import reads_alike

    df = spark.range(3000).select("id", (F.rand() * 10).alias("x"))
    assert not reads_alike(df) and reads_alike(spark.range(5).select("id"))
    res = run_validation(df, [("x", "double", "at least 5"), ("id", "bigint", "unique and not null")], f"{tmp_path}/v", f"{tmp_path}/i")
    v, i = spark.read.parquet(f"{tmp_path}/v"), spark.read.parquet(f"{tmp_path}/i")
    assert v.columns == ["id", "x"] and v.where("x < 5").count() == 0 and i.where("x >= 5").count() == 0
    assert v.count() + i.count() == 3000 == res.total and v.select("id").union(i.select("id")).distinct().count() == 3000
