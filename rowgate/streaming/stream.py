"""Streaming validation (extension): stateless checks on a stream, split per
micro-batch with ``foreachBatch``, plus a running failure count.

Uniqueness needs the whole table and is rejected on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.sql import quote_ident
from ..operators.checks import Check, active, apply_checks, compile_rules
from ..operators.prepare import prepare
from ..operators.report import is_invalid, summary_from_counts
from ..plans.shared import delete_path, is_file, scratch_path

BATCH_COLUMN = "_batch_id"
FILES_PER_TRIGGER = 1000  # bounds the first micro-batch over a backlog


def stream_checks(stream: DataFrame, rules, translator=None, strip: bool = True,
                  trim: bool = True) -> tuple[DataFrame, list[Check]]:
    """Checked streaming frame. Raises on rules that need the whole table.
    Time rules compare with the time of each micro-batch, not with the moment
    at which the stream was started."""
    prepared = prepare(stream, strip=strip, trim=trim)
    checks = compile_rules(rules, prepared, translator=translator, fixed_time=False)
    if any(c.whole_table for c in active(checks)):
        raise ValueError("uniqueness and existence rules need the whole table; run them in batch")
    return apply_checks(prepared, checks), checks


def running_failure_counts(checked: DataFrame, checks: list[Check]) -> DataFrame:
    """Streaming aggregate (complete/update mode): rows and failures per check."""
    return checked.agg(F.count(F.lit(1)).alias("total_records"),
                       *[F.count_if(c.column == F.lit(False)).alias(c.name) for c in active(checks)])


def split_writer(valid_path: str, invalid_path: str, columns: list[str], checks: list[Check],
                 fmt: str = "parquet"):
    """``foreachBatch`` function: writes both splits of a micro-batch into a
    partition named by the batch id, overwriting only that partition, so a
    replayed batch replaces its own output (idempotent sink)."""
    usable = active(checks)
    orig = [F.col(quote_ident(c)) for c in columns]

    def write(batch: DataFrame, batch_id: int) -> None:
        # One job decides every row of the micro-batch; both outputs are copied from what it wrote.
        spark = batch.sparkSession
        names = [f"c{i}" for i in range(len(batch.columns))]
        split = F.when(is_invalid(usable), F.lit("invalid")).otherwise(F.lit("valid"))
        path = scratch_path(spark, "stream-batch")
        try:
            staged = batch.withColumn("__rg_split", split).toDF(*names, "split")
            staged.write.partitionBy("split").parquet(path)
            read = spark.read.schema(staged.schema).parquet(path)
            back = [F.col(n).alias(c) for n, c in zip(names, batch.columns)]
            tag = F.lit(batch_id).cast("long").alias(BATCH_COLUMN)
            valid = read.where("split = 'valid'").select(*back).select(*orig, tag)
            invalid = read.where("split = 'invalid'").select(*back).select(*orig, *[c.column for c in usable], tag)
            for df, target in ((valid, valid_path), (invalid, invalid_path)):
                (df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy(BATCH_COLUMN).save(target))
        finally:  # also when the batch fails: it is decided again from the start
            delete_path(spark, path)

    return write


def validate_stream(stream: DataFrame, rules, valid_path: str, invalid_path: str, checkpoint_location: str,
                    fmt: str = "parquet", available_now: bool = True, processing_time: str | None = None):
    """Start the streaming validation; returns the ``StreamingQuery``."""
    checked, checks = stream_checks(stream, rules)
    columns = prepare(stream).columns
    writer = checked.writeStream.foreachBatch(split_writer(valid_path, invalid_path, columns, checks, fmt))
    writer = writer.option("checkpointLocation", checkpoint_location)
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                     max_files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """File stream over a folder, or over one file via a glob filter."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if is_file(spark, path) and folder:
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def validate_stream_files(spark: SparkSession, path: str, schema: T.StructType, rules, valid_path: str,
                          invalid_path: str, checkpoint_location: str, fmt: str = "parquet",
                          max_files_per_trigger: int | None = FILES_PER_TRIGGER) -> None:
    """Run a file-source validation stream to completion (``availableNow``),
    at most ``max_files_per_trigger`` files a micro-batch."""
    q = validate_stream(read_file_stream(spark, path, schema, max_files_per_trigger=max_files_per_trigger), rules, valid_path, invalid_path,
                        checkpoint_location, fmt=fmt)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_failure_summary(spark: SparkSession, path: str, schema: T.StructType, rules,
                           query_name: str | None = None) -> DataFrame:
    """Run a file stream to completion with a running failure count
    (complete mode, one aggregate row kept by the memory sink; its state is
    checkpointed in the shared folder) and return the failure summary of
    everything read so far."""
    import uuid

    checked, checks = stream_checks(read_file_stream(spark, path, schema), rules)
    name = query_name or f"rowgate_counts_{uuid.uuid4().hex[:8]}"
    q = (running_failure_counts(checked, checks).writeStream.outputMode("complete").format("memory")
         .option("checkpointLocation", scratch_path(spark, "stream-state")).queryName(name).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return summary_from_counts(spark.table(name), checks)


# --- failures per event-time window ---------------------------------------------

WINDOW_COLUMNS = ["window_start", "window_end"]
STATE_PARTS_PER_FILE = 16  # state partitions whose changed windows are written as one file


def window_failure_counts(stream: DataFrame, rules, event_time: str, window: str, watermark: str,
                          translator=None) -> tuple[DataFrame, list[Check]]:
    """Streaming aggregate per event-time window: rows and failures per check.
    Rows that are later than ``watermark`` behind the newest event are left
    out by Spark, rows without an event time too; a window's state goes once
    the watermark has passed its end."""
    checked, checks = stream_checks(stream, rules, translator=translator)
    at = F.col(quote_ident(event_time)).cast("timestamp")
    timed = checked.withColumn("__rg_at", at).withWatermark("__rg_at", watermark)
    return (timed.groupBy(F.window("__rg_at", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("total_records"),
                 *[F.count_if(c.column == F.lit(False)).alias(c.name) for c in active(checks)])
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_records",
                    *[c.column for c in active(checks)])), checks


def window_writer(path: str, fmt: str = "parquet"):
    """``foreachBatch`` function: the windows that a micro-batch changed, with
    their totals so far, as the partition of its id. A replayed batch
    overwrites its own partition, so the table is the same after a restart.

    The windows are dealt to fewer tasks that write, so that files stay few;
    the counting itself keeps a task per state partition (with ``coalesce``
    one task would hold the state and the buffers of all partitions)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        parts = -(-int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")) // STATE_PARTS_PER_FILE)
        (batch.withColumn(BATCH_COLUMN, F.lit(batch_id).cast("long")).repartition(parts, *WINDOW_COLUMNS).write.format(fmt)
         .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH_COLUMN).save(path))
    return write


def failure_windows(stream: DataFrame, rules, event_time: str, window: str, watermark: str, path: str, checkpoint_location: str,
                    fmt: str = "parquet", available_now: bool = True, processing_time: str | None = None):
    """Start the windowed failure counts into the table at ``path``; returns
    the ``StreamingQuery``. Started again with the same checkpoint it goes on
    where it was."""
    counts, _ = window_failure_counts(stream, rules, event_time, window, watermark)
    writer = (counts.writeStream.outputMode("update").foreachBatch(window_writer(path, fmt))
              .option("checkpointLocation", checkpoint_location))
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_failure_windows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The table's present content: per window the totals of the last
    micro-batch that changed it, in the long form of the summary
    ``(window_start, window_end, check_name, failed_records, total_records,
    failure_rate_pct)`` for checks with a failure, plus a row with check name
    NULL for windows without any."""
    rows = spark.read.format(fmt).load(path)
    checks = [c for c in rows.columns if c not in [*WINDOW_COLUMNS, "total_records", BATCH_COLUMN]]
    values = F.struct(F.col(BATCH_COLUMN), F.col("total_records"), *[F.col(quote_ident(c)).alias(f"c{i}") for i, c in enumerate(checks)])
    last = rows.groupBy(*WINDOW_COLUMNS).agg(F.max_by(values, F.col(BATCH_COLUMN)).alias("x"))
    entries = [F.struct(F.lit(c).alias("check_name"), F.col(f"x.c{i}").alias("failed_records")) for i, c in enumerate(checks)]
    failed = F.filter(F.array(*entries), lambda e: e["failed_records"] > 0) if entries else F.array().cast(
        "array<struct<check_name: string, failed_records: bigint>>")
    long = last.select(*WINDOW_COLUMNS, F.col("x.total_records").alias("total_records"), F.inline_outer(failed))
    return long.withColumn("failed_records", F.coalesce("failed_records", F.lit(0).cast("long"))).withColumn(
        "failure_rate_pct", F.expr("CAST(round(failed_records / total_records * 100, 2) AS DOUBLE)"))
