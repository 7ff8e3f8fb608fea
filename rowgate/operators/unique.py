"""Uniqueness check (E8), exact and skew-safe.

A row passes when its key is missing (NULL or NaN) or occurs once. The plan never gathers a
key's rows in one task:

1. ``groupBy(key).count()`` with map-side partial aggregation; only keys seen
   more than once are kept (``dups``) and written once as a parquet table in
   the shared checkpoint folder. Their exact number and size are observed
   during that write, before any join is planned. For string/binary keys a
   hash-first pass shuffles 64-bit hashes instead of the keys and groups the
   real keys only for rows whose hash repeats.
2. If ``dups`` is small (row and byte bound checked), it is broadcast and
   joined in the scan stage: no shuffle of the source rows.
3. Otherwise rows whose answer is known without a join are set apart: a NULL
   key passes; a key whose hash is not in the bitmap of the listed keys passes
   (the bitmap is a broadcast table of bounded size, 16 bits a key up to
   ``BITMAP_BITS``); a hot key (more than ``rows_per_hot`` rows) *is* a
   duplicate and fails by a broadcast lookup of the hot list, which is bounded
   by key count and bytes (the threshold rises until it fits). Only the other
   rows are shuffled, joined on the plain key; none of their keys has more than
   the threshold's rows, so no task gets a hot key and nothing is replicated.

The key passes of several columns all read the bare source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.sql import quote_ident
from ..plans.shared import materialize

# Defaults; each can be set per session, e.g. spark.rowgate.unique.broadcastMaxKeys.
BROADCAST_MAX_KEYS = 2_000_000
BROADCAST_MAX_BYTES = 128 << 20
ROWS_PER_HOT = 100_000
MAX_HOT_KEYS = 100_000
BITMAP_BITS = (1 << 15, 1 << 27)  # least and most bits of a bitmap of key hashes (16 MB, 32 MB as longs)
BITS_PER_KEY = 16
_CONF = "spark.rowgate.unique."


def key_bytes():
    return F.octet_length(F.col("__rg_k").cast("string")) + 16


def _setting(df: DataFrame, name: str, given, default: int) -> int:
    if given is not None:
        return int(given)
    value = df.sparkSession.conf.get(_CONF + name, None)
    return int(value) if value is not None else default


def key_column(df: DataFrame, column: str):
    """The key column; a NaN is a missing value, like NULL (as in the profiler)."""
    c = F.col(quote_ident(column))
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def duplicated_keys(df: DataFrame, column: str) -> DataFrame:
    """Keys that occur more than once, with their count (lazy)."""
    k = key_column(df, column)
    return (df.select(k.alias("__rg_k")).where(F.col("__rg_k").isNotNull())
            .groupBy("__rg_k").agg(F.count(F.lit(1)).alias("__rg_n"))
            .where(F.col("__rg_n") > 1))


def hash_bitmap(hashes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Bitmap of the 64-bit hashes in the one column of ``hashes`` (some ``n``
    of them): rows ``(__rg_b, __rg_bits)``, one per 32,768 bits, and its size."""
    size = 1 << max(int(n * BITS_PER_KEY) - 1, 1).bit_length()
    size = min(max(size, BITMAP_BITS[0]), BITMAP_BITS[1])
    at = hashes.toDF("h").selectExpr(f"(h & {size - 1}L) + 1 AS p")
    bits = at.groupBy(F.expr("bitmap_bucket_number(p) - 1 AS __rg_b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    # 4 bytes a word, so that a row only has to test one bit of a long
    return bits.selectExpr("__rg_b", "transform(sequence(0, 1023), i -> CAST(conv(hex(substring(bits, 4 * i + 1, 4)), 16, 10) AS BIGINT)) "
                           "AS __rg_bits"), size


def in_bitmap(df: DataFrame, hash_sql: str, bitmap: DataFrame, size: int, flag: str) -> DataFrame:
    """``df`` plus a boolean: whether the bit of the hash is set (a broadcast
    lookup of the bitmap's row; false for a NULL hash)."""
    p = f"({hash_sql} & {size - 1}L)"
    joined = df.join(F.broadcast(bitmap), F.expr(f"shiftright({p}, 15)") == F.col("__rg_b"), "left")
    word = f"element_at(__rg_bits, CAST(shiftright({p} & 32767L, 5) + 1 AS INT))"
    shift = f"CAST((3 - (shiftright({p}, 3) & 3L)) * 8 + ({p} & 7L) AS INT)"
    return joined.withColumn(flag, F.expr(f"coalesce(shiftright({word}, {shift}) & 1L, 0L) = 1L")).drop("__rg_b", "__rg_bits")


def _hashed_candidates(df: DataFrame, column: str, broadcast_max_keys: int) -> DataFrame:
    """Hash-first pass for variable-length keys: shuffle 64-bit hashes
    instead of the keys to find hashes seen more than once, then keep only
    the rows whose hash is suspect: by a broadcast semi-join, or, beyond the
    bound, by the bitmap of the suspect hashes. Exact: equal keys have equal
    hashes, and the real keys are grouped afterwards."""
    k = key_column(df, column)
    keyed = df.select(k.alias("__rg_k")).where(F.col("__rg_k").isNotNull()) \
        .withColumn("__rg_h", F.xxhash64("__rg_k"))
    suspects, stats = materialize(
        keyed.groupBy("__rg_h").agg(F.count(F.lit(1)).alias("__rg_hn")).where(F.col("__rg_hn") > 1)
        .select("__rg_h"), "duphash", F.count(F.lit(1)).alias("hashes"))
    if stats["hashes"] > broadcast_max_keys:
        return in_bitmap(keyed, "__rg_h", *hash_bitmap(suspects, stats["hashes"]), "__rg_hit").where("__rg_hit").select("__rg_k")
    return keyed.join(F.broadcast(suspects), "__rg_h", "left_semi").select("__rg_k")


def _repeated(df: DataFrame, column: str, hash_keys: bool | None, broadcast_max_keys: int) -> DataFrame:
    """Keys that occur more than once, with their count; string and binary
    keys through the hash-first pass unless ``hash_keys=False``."""
    if hash_keys is None:
        hash_keys = isinstance(df.schema[column].dataType, (T.StringType, T.BinaryType))
    if not hash_keys:
        return duplicated_keys(df, column)
    return (_hashed_candidates(df, column, broadcast_max_keys).groupBy("__rg_k").agg(F.count(F.lit(1)).alias("__rg_n"))
            .where(F.col("__rg_n") > 1))


def duplicate_table(df: DataFrame, column: str, hash_keys: bool | None = None,
                    broadcast_max_keys: int = BROADCAST_MAX_KEYS) -> tuple[DataFrame, dict]:
    """``(key, count)`` of duplicated keys, written once to the shared folder,
    with its key count, byte size and largest count observed. String and
    binary keys go through the hash-first pass unless ``hash_keys=False``."""
    return materialize(
        _repeated(df, column, hash_keys, broadcast_max_keys), "dupkeys",
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(key_bytes()), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("__rg_n"), F.lit(0)).alias("max_n"),
    )


def duplicated_row_count(df: DataFrame, column: str, hash_keys: bool | None = None,
                         broadcast_max_keys: int | None = None) -> int:
    """Rows whose non-NULL key occurs more than once: the failure count of a
    uniqueness check, from partially aggregated passes over the key column
    (no join back to the rows; string/binary keys hash-first)."""
    max_keys = _setting(df, "broadcastMaxKeys", broadcast_max_keys, BROADCAST_MAX_KEYS)
    return int(_repeated(df, column, hash_keys, max_keys).agg(F.coalesce(F.sum("__rg_n"), F.lit(0))).first()[0])


def _hot_keys(dups: DataFrame, stats: dict, rows_per_hot: int, max_keys: int, max_bytes: int) -> DataFrame | None:
    """Keys with more rows than a threshold that starts at ``rows_per_hot`` and
    rises until the list fits both bounds; None without any."""
    limit = max(int(rows_per_hot), 1)
    while stats["max_n"] > limit:
        hot = dups.where(F.col("__rg_n") > limit)
        size = hot.agg(F.count(F.lit(1)).alias("keys"), F.sum(key_bytes()).alias("bytes")).first()
        if size["keys"] <= max_keys and size["bytes"] <= max_bytes:
            return hot.select(F.col("__rg_k").alias("__rg_hk"), F.lit(True).alias("__rg_hot"))
        limit *= 4
    return None


def flag_listed_keys(df: DataFrame, column: str, flag: str, listed: DataFrame, stats: dict, max_keys: int, max_bytes: int,
                     per_hot: int, max_hot: int) -> DataFrame:
    """``df`` plus a boolean: false when the key of ``column`` is among the
    written table ``listed`` (``__rg_k``, ``__rg_n`` rows), true otherwise and
    for NULL. See the module's steps 2 and 3."""
    out_cols = [F.col(quote_ident(c)) for c in df.columns]
    key = key_column(df, column)
    if stats["keys"] == 0:
        return df.select(*out_cols, F.lit(True).alias(flag))
    right = listed.select("__rg_k", F.lit(False).alias("__rg_dup"))
    passed = F.coalesce(F.col("__rg_dup"), F.lit(True)).alias(flag)
    if stats["keys"] <= max_keys and stats["bytes"] <= max_bytes:
        return df.join(F.broadcast(right), key == F.col("__rg_k"), "left").select(*out_cols, passed)
    bitmap, size = hash_bitmap(listed.select(F.xxhash64("__rg_k")), stats["keys"])
    tagged = in_bitmap(df.withColumn("__rg_own", key), "xxhash64(__rg_own)", bitmap, size, "__rg_hit")
    may, hot_row = F.col("__rg_own").isNotNull() & F.col("__rg_hit"), F.lit(False)
    hot = _hot_keys(listed, stats, per_hot, max_hot, max_bytes)
    if hot is not None:
        tagged = tagged.join(F.broadcast(hot), F.col("__rg_own") == F.col("__rg_hk"), "left")
        hot_row = F.coalesce(F.col("__rg_hot"), F.lit(False))
    known = tagged.where(~may | hot_row).select(*out_cols, (~hot_row).alias(flag))
    rest = tagged.where(may & ~hot_row).select(*out_cols, "__rg_own")
    return known.unionByName(rest.join(right, F.col("__rg_own") == F.col("__rg_k"), "left").select(*out_cols, passed))


def list_settings(df: DataFrame, broadcast_max_keys: int | None = None, broadcast_max_bytes: int | None = None,
                  rows_per_hot: int | None = None, max_hot_keys: int | None = None, hash_keys: bool | None = None) -> dict:
    """Bounds of ``flag_listed_keys``: given, set in the session, or default."""
    return {"max_keys": _setting(df, "broadcastMaxKeys", broadcast_max_keys, BROADCAST_MAX_KEYS),
            "max_bytes": _setting(df, "broadcastMaxBytes", broadcast_max_bytes, BROADCAST_MAX_BYTES),
            "per_hot": _setting(df, "rowsPerHot", rows_per_hot, ROWS_PER_HOT),
            "max_hot": _setting(df, "maxHotKeys", max_hot_keys, MAX_HOT_KEYS)}


def unique_flags(df: DataFrame, flags: dict[str, str], *, hash_keys: bool | None = None, **options) -> DataFrame:
    """``df`` plus a boolean column per entry of ``{column: flag}``: true when
    the column is NULL or unique. Column order of ``df`` is kept, flags are
    appended. All key passes run over ``df`` itself, before any join."""
    bounds = list_settings(df, **options)
    found = {c: duplicate_table(df, c, hash_keys, bounds["max_keys"]) for c in flags}
    for column, flag in flags.items():
        df = flag_listed_keys(df, column, flag, *found[column], **bounds)
    return df


def unique_flag(df: DataFrame, column: str, flag: str, **options) -> DataFrame:
    """``unique_flags`` for one column."""
    return unique_flags(df, {column: flag}, **options)
