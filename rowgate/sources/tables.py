"""Source tables (A4) and output writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, source: str, fmt: str | None = None, **options) -> DataFrame:
    """A4: a catalog table name, or a path read with ``fmt`` (default parquet)."""
    looks_like_path = "/" in source or source.endswith((".parquet", ".csv", ".json", ".orc"))
    if fmt is None and not looks_like_path:
        return spark.read.table(source)
    reader = spark.read.format(fmt or _format_of(source))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(source)


def _format_of(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    return ext if ext in ("parquet", "csv", "json", "orc", "avro", "text") else "parquet"


def write_frame(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None, **options) -> None:
    """A6/A7/A8 sink: always overwrites, also with zero rows, so an older
    output never survives a clean run."""
    w = df.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)


def preview(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    """The first ``n`` rows of a stage (a deterministic top-n when
    ``order_by`` is given); a limit is the feature here."""
    if order_by is not None:
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return df.limit(n)


def load_source_files(spark: SparkSession, path: str, pattern: str = "*.py", recursive: bool = True) -> DataFrame:
    """Files under ``path`` as a ``(path, text)`` table, one row per file (read
    whole), ready for ``review_sources``."""
    from pyspark.sql import functions as F

    reader = spark.read.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    # ``text()`` has its own ``wholetext`` argument that overrides options.
    return (reader.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
