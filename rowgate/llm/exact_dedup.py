"""Exact dedup by distributed MSD radix partitioning (operator 5).

Documents are split by successive bytes of their normalised text. A round
takes the next digit (a run of bytes; runs grow geometrically, so a text of L
bytes needs O(log L) rounds) and splits every group by it. A group that
becomes a singleton is finished, a group whose texts have ended holds equal
texts and is finished, all others go into the next round with the bytes that
are left. Groups carry an opaque id; equality is decided by the bytes, never
by a digest.

Per round: (1) count rows per (group, digit, ended) with map-side partial
aggregation, write the keys that hold more than one row; (2) join the rows
to those keys and write them again, cut by one digit. Only rows that are not
yet finished carry text. A group of copies that holds a third of all rows is
one key of the count (one partial row per task) and a skewed key of the join
whose other side is one row, which AQE splits over tasks. The join is always
a merge join, so that a run costs and behaves alike at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from .common import col, delete_path, freeing_shuffles, lower_ascii, materialize, scratch_path

FIRST_DIGIT = 64
GROWTH = 8


def _cut(rest, width: int) -> list:
    """The next digit, what follows it, and whether the text ends with it."""
    size = F.octet_length(rest)
    return [F.substring(rest, 1, width).alias("digit"),
            F.substring(rest, F.lit(width + 1), size).alias("rest"),
            (size <= width).alias("ended")]


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
                 first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``
    and, in the struct column ``row``, the ``carry`` columns.

    Texts are equal when identical after lower-casing A-Z; a null text is an
    empty one. Of equal texts the row with the largest id stays; a null id
    ranks below every other; among rows that repeat the same id exactly one
    stays. An empty table gives an empty result. Other columns of ``df``,
    whatever their names, are not read.
    """
    spark = df.sparkSession
    text = lower_ascii(F.coalesce(col(text_col), F.lit("")))
    row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(None).cast("boolean")
    base = df.select(col(id_col).alias("doc_id"), row.alias("row"), F.unhex(F.sha2(text, 256)).alias("sha"),
                     text.cast("binary").alias("rest")).select("doc_id", "row", "sha", *_cut(F.col("rest"), first_digit))
    width = first_digit
    with freeing_shuffles(spark):
        # First digit: only whether it is alone. Rows get their row id when the others are written.
        keys, _ = materialize(base.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                              .select("digit", F.monotonically_increasing_id().alias("to")), "radix-keys")
        rows = base.join(keys.hint("merge"), "digit", "left")
        finals = []

        def step(rows, active, done, width):
            """Write finished and unfinished rows apart in one job."""
            cut = _cut(F.when(active, F.col("rest")), width)
            out = rows.select("doc_id", "row", "sha", "rid", *done, F.when(active, F.col("to")).alias("gid"), *cut,
                              active.alias("active"))
            path, obs = scratch_path(spark, "radix-rows"), Observation()
            out.observe(obs, F.count_if("active").alias("left")).write.partitionBy("active").parquet(path)
            schema = out.drop("active").schema
            read = spark.read.schema(schema.add("active", "boolean")).parquet(path)
            finals.append(read.where(~F.col("active")).select("doc_id", "row", "sha", "keep_id", "n", "kept"))
            return read.where("active"), int(obs.get["left"]), f"{path}/active=true"

        alone = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept")]
        width *= growth
        state, left, used = step(rows.withColumn("rid", F.monotonically_increasing_id()), F.col("to").isNotNull(), alone,
                           width)
        while left:
            keys, _ = materialize(
                state.groupBy("gid", "digit", "ended")
                .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "rid")).alias("top"))
                .where("size > 1").withColumn("to", F.monotonically_increasing_id()), "radix-keys")
            rows = state.join(keys.hint("merge"), ["gid", "digit", "ended"], "left")
            same = F.col("to").isNotNull() & F.col("ended")
            done = [F.when(same, F.col("top.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                    F.when(same, F.col("size")).otherwise(F.lit(1)).cast("long").alias("n"),
                    F.when(same, F.col("rid") == F.col("top.rid")).otherwise(F.lit(True)).alias("kept")]
            width *= growth
            spent = used
            state, left, used = step(rows, F.col("to").isNotNull() & ~F.col("ended"), done, width)
            delete_path(spark, spent)  # its rows are in the next round's table
    out = finals[0]
    for f in finals[1:]:
        out = out.unionByName(f)
    keep = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    return out.select(*keep, "row") if carry else out.select(*keep)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the copies: whole rows, one of each group of equal texts."""
    out = exact_groups(df, id_col, text_col, carry=df.columns).where("kept")
    return out.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
