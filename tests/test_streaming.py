import pytest

from rowgate.streaming.stream import read_file_stream, stream_checks, validate_stream_files


def test_stream_split_matches_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/orders.parquet"
    schema = spark.read.parquet(src).schema
    rules = [("o_orderstatus", "string", "Should be one of ['F', 'O']")]
    validate_stream_files(spark, src, schema, rules, str(tmp_path / "v"), str(tmp_path / "i"), str(tmp_path / "c"))
    batch = spark.read.parquet(src)
    assert spark.read.parquet(str(tmp_path / "i")).count() == batch.where("o_orderstatus = 'P'").count()
    assert spark.read.parquet(str(tmp_path / "v")).count() == batch.where("o_orderstatus <> 'P'").count()


def test_unique_rejected_on_streams(spark):
    src = "/root/testdata/sf0.001/orders.parquet"
    stream = read_file_stream(spark, src, spark.read.parquet(src).schema)
    with pytest.raises(ValueError):
        stream_checks(stream, [("o_orderkey", "bigint", "Must be unique")])


def test_stream_failure_summary_matches_batch(spark):
    from rowgate.operators.report import failure_summary
    from rowgate.plans.runner import checked_frame
    from rowgate.streaming.stream import stream_failure_summary
    src = "/root/testdata/sf0.001/orders.parquet"
    batch = spark.read.parquet(src)
    rules = [("o_orderstatus", "string", "Should be one of ['F', 'O']"),
             ("o_totalprice", "double", "value must be greater than 1000")]
    got = [tuple(r) for r in stream_failure_summary(spark, src, batch.schema, rules).collect()]
    checked, checks = checked_frame(batch, rules)
    assert got == [tuple(r) for r in failure_summary(checked, checks).collect()]
    assert len(got) >= 1


def test_replayed_micro_batch_is_idempotent(spark, tmp_path):
    from rowgate.operators.checks import active, apply_checks, compile_rules
    from rowgate.streaming.stream import split_writer
    df = spark.createDataFrame([(1, "A"), (2, "X"), (None, "A")], "id int, s string")
    checks = active(compile_rules([("s", "string", "one of ['A']"), ("id", "int", "Not Null")], df))
    checked = apply_checks(df, checks)
    write = split_writer(str(tmp_path / "v"), str(tmp_path / "i"), df.columns, checks)
    write(checked, 7)
    write(checked, 7)  # replay of the same batch
    write(checked, 8)
    valid = spark.read.parquet(str(tmp_path / "v"))
    invalid = spark.read.parquet(str(tmp_path / "i"))
    assert valid.count() == 2 and invalid.count() == 4
    assert sorted(r._batch_id for r in valid.collect()) == [7, 8]


def test_batch_only_operators_reject_streams(spark):
    from rowgate import run_validation, suggest_rules, validation_summary
    src = "/root/testdata/sf0.001/orders.parquet"
    stream = read_file_stream(spark, src, spark.read.parquet(src).schema)
    rules = [("o_orderkey", "bigint", "Not Null")]
    for call in (lambda: validation_summary(stream, rules), lambda: suggest_rules(stream),
                 lambda: run_validation(stream, rules, "/nonexistent/v", "/nonexistent/i")):
        with pytest.raises(ValueError):
            call()


def _run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_time_rules_of_a_stream_follow_its_batches(spark, tmp_path):
    """Events that happen after the stream was started are not in the future of their batch."""
    from datetime import datetime, timedelta, timezone
    import time

    from rowgate.streaming.stream import validate_stream

    src, schema = str(tmp_path / "in"), "id int, ts timestamp"
    base = datetime.now(timezone.utc)
    spark.createDataFrame([(1, base - timedelta(hours=1))], schema).write.mode("append").parquet(src)
    stream = read_file_stream(spark, src, spark.read.parquet(src).schema)
    rules = [("ts", "timestamp", "not in the future"), ("ts", "timestamp", "sql: ts <= now()")]
    checked, checks = stream_checks(stream, rules)
    assert all("current_timestamp()" in c.sql or "now()" in c.sql for c in checks if c.kind == "rule")
    q = validate_stream(stream, rules, str(tmp_path / "v"), str(tmp_path / "i"), str(tmp_path / "c"), available_now=False,
                        processing_time="1 second")
    try:
        time.sleep(3)
        late = datetime.now(timezone.utc)  # after the start, before its batch
        spark.createDataFrame([(2, late), (3, late + timedelta(days=1))], schema).write.mode("append").parquet(src)
        for _ in range(60):
            q.processAllAvailable()
            if spark.read.parquet(str(tmp_path / "v")).count() + spark.read.parquet(str(tmp_path / "i")).count() == 3:
                break
    finally:
        q.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [1, 2]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "i")).collect()] == [3]


WINDOW_RULES = [("v", "int", "at least 5"), ("s", "string", "not null")]


def _events(spark, rows):
    return spark.createDataFrame(rows, "ts string, v int, s string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "v", "s")


def test_failure_windows_go_on_after_a_restart(spark, tmp_path):
    from rowgate.streaming.stream import failure_windows, read_failure_windows

    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    loads = [[("2024-01-01 00:10:00", 1, "a"), ("2024-01-01 00:20:00", 9, None), ("2024-01-01 01:00:00", 7, "b"), (None, 1, "x")],
             [("2024-01-01 00:50:00", 2, "c"), ("2024-01-01 02:30:00", 9, "d")],
             [("2023-12-01 00:00:00", 1, "too late"), ("2024-01-01 02:40:00", 3, None)]]
    seen = []
    for load in loads:
        _events(spark, load).write.mode("append").parquet(src)
        stream = read_file_stream(spark, src, spark.read.parquet(src).schema)
        _run(failure_windows(stream, WINDOW_RULES, "ts", "1 hour", "3 hours", out, state))
        seen.append({(str(r.window_start)[11:16], r.check_name and r.check_name[0]): (r.failed_records, r.total_records, r.failure_rate_pct)
                     for r in read_failure_windows(spark, out).collect()})
    assert seen[0] == {("00:00", "v"): (1, 2, 50.0), ("00:00", "s"): (1, 2, 50.0), ("01:00", None): (0, 1, 0.0)}
    assert seen[1] == {("00:00", "v"): (2, 3, 66.67), ("00:00", "s"): (1, 3, 33.33), ("01:00", None): (0, 1, 0.0), ("02:00", None): (0, 1, 0.0)}
    assert seen[2] == {**{k: v for k, v in seen[1].items() if k[0] != "02:00"}, ("02:00", "v"): (1, 2, 50.0), ("02:00", "s"): (1, 2, 50.0)}


def test_a_replayed_window_batch_replaces_its_own_rows(spark, tmp_path):
    from rowgate.streaming.stream import read_failure_windows, window_writer

    out = str(tmp_path / "out")
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 01:00:00", 4, 1)], "a string, b string, total_records long, c_ok long").selectExpr(
        "CAST(a AS TIMESTAMP) AS window_start", "CAST(b AS TIMESTAMP) AS window_end", "total_records", "c_ok")
    write = window_writer(out)
    write(df, 0)
    write(df, 1)
    write(df, 1)
    assert spark.read.parquet(out).count() == 2
    assert [(r.check_name, r.failed_records, r.failure_rate_pct) for r in read_failure_windows(spark, out).collect()] == [("c_ok", 1, 25.0)]


def test_windows_of_many_state_partitions_are_not_counted_in_one_task(spark, tmp_path):
    """Each partition of a micro-batch stays a task of its own; the files are fewer."""
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    from rowgate.streaming.stream import window_writer

    def task(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([TaskContext.get().taskAttemptId()] * b.num_rows)], names=["id", "task"])

    out = str(tmp_path / "out")
    df = spark.range(0, 40, 1, 40).mapInArrow(task, "id long, task long").select(
        F.timestamp_seconds(F.col("id") * 3600).alias("window_start"), F.timestamp_seconds(F.col("id") * 3600 + 3600).alias("window_end"),
        F.lit(1).cast("long").alias("total_records"), "task")
    window_writer(out)(df, 0)
    got = spark.read.parquet(out)
    assert got.count() == 40 and got.select("task").distinct().count() == 40
    assert len(list((tmp_path / "out").rglob("part-*.parquet"))) <= max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16 + 1)
