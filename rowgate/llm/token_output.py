"""Token ids as ORC files (operator 3).

Documents are range-partitioned and sorted by id, encoded in Arrow batches
and written as ORC: integer columns are run-length encoded by the format,
stripes are bounded in size (a reader task takes whole stripes), every stripe
has row indexes and a Bloom filter on ``doc_id``, so lookups by id skip
stripes and row groups from metadata alone.

A file holds one ascending run of ids, ``segment`` numbers the runs in order
and ``pos`` the rows of a run, so the position of any document in the whole
token stream is the total of the segments before it plus a running sum
inside its segment: no global sort and no single task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import col, freeing_shuffles, scratch_path, text_buffer
from .wordtokens import word_tokenizer

STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000


def write_token_ids(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                    end_id: int = 2, stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS) -> None:
    """Write ``doc_id, ids, segment, pos`` in ascending id order under ``path``.

    A null text is an empty one (only the end id). Null ids come first. Rows
    that repeat an id are ordered by their text's hash; such rows may lie in
    several segments, so no id is too frequent for a task. An empty table
    gives no rows. Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    key = [F.col("doc_id"), F.col("h"), F.col("m")]
    rows = (df.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
            .select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
            .repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text"))

    def encode(batches):
        import pyarrow as pa

        tok, pos = word_tokenizer(tokenizer), 0
        for b in batches:
            data, off = text_buffer(b.column(1))
            for lo, hi, ids, count in tok.encode_slices(data, off):
                ends = np.cumsum(count + 1)
                out = np.empty(int(ends[-1]), np.int32)
                last = np.zeros(len(out), bool)
                last[ends - 1] = True
                out[last], out[~last] = end_id, ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), lists, pa.array(np.arange(pos, pos + hi - lo))],
                    names=["doc_id", "ids", "pos"])
                pos += hi - lo

    out = rows.mapInArrow(encode, "doc_id long, ids array<int>, pos long").withColumn("segment", F.spark_partition_id())
    with freeing_shuffles(spark):
        (out.write.option("compression", "zstd").option("orc.create.index", "true")
         .option("orc.row.index.stride", index_rows).option("orc.stripe.size", stripe_bytes)
         .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


SCHEMA = "doc_id long, ids array<int>, pos long, segment int"


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None, first: int | None = None,
                   last: int | None = None) -> DataFrame:
    """The written rows; ``doc_ids`` and the range ``first``..``last`` are
    pushed to the files' row indexes and Bloom filters."""
    out = spark.read.schema(SCHEMA).orc(path)
    if doc_ids is not None:
        out = out.where(F.col("doc_id").isin([int(i) for i in doc_ids]))
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    if last is not None:
        out = out.where(F.col("doc_id") <= last)
    return out


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files:
    ids of all documents before it, its ids, and the unsigned CRC-32 of its ids
    as little-endian unsigned 32-bit integers."""
    def digest(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            ids = b.column(3)
            flat = np.ascontiguousarray(ids.flatten().to_numpy().astype("<u4"))
            off = ids.offsets.to_numpy().astype(np.int64)
            off = off - off[0]
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(off.tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(off)),
                                              pa.array(crc, pa.int64())],
                                             names=["segment", "pos", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_token_ids(spark, path).select("segment", "pos", "doc_id", "ids").mapInArrow(
        digest, "segment int, pos long, doc_id long, n_tokens long, ids_crc32 long")
    before = Window.partitionBy("segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # One row per file: the only step over all segments at once.
    totals = (read_token_ids(spark, path).groupBy("segment").agg(F.sum(F.size("ids")).alias("n"))
              .withColumn("base", F.coalesce(F.sum("n").over(
                  Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return (rows.join(totals.select("segment", "base"), "segment")
            .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def token_output(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 2) -> DataFrame:
    """Write into the shared scratch folder and return the index read back."""
    path = scratch_path(df.sparkSession, "token-ids")
    write_token_ids(df, path, tokenizer, id_col, text_col, end_id)
    return token_index(df.sparkSession, path)
