"""Shared helpers of the llm operators."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.shared import delete_path, materialize, scratch_path  # noqa: F401  (re-exported)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """True when crc32 of the id's text leaves remainder ``fold``; a null id
    is in no fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """For blocks whose jobs all write tables: the shuffle files of a job are
    removed when it ends (its result is written, nothing reads them again),
    and scratch tables, which may carry whole texts, are written with zstd."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for all i, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string or binary array (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_slices(offsets: np.ndarray, most: int = 4 << 20):
    """Row ranges (lo, hi) whose texts have about ``most`` bytes together (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def sample_ids(df: DataFrame, id_col: str, class_col: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows ``(id, class, pri)`` with about as many of each
    class: the ``n`` smallest values of (hash of id) x (rows of the class)."""
    rows = df.select(col(id_col).alias("id"), col(class_col).alias("class")).where("id IS NOT NULL AND class IS NOT NULL")
    sizes = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}
    if not sizes:
        return rows.withColumn("pri", F.lit(0.0)).limit(0)
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("class")]
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    # as doubles: the whole product leaves a bigint when a class has more than 2^23 rows
    return rows.withColumn("pri", u.cast("double") * size).orderBy("pri", "id").limit(n)
