import pytest
from pyspark.sql import functions as F

from rowgate.operators.unique import unique_flag, unique_flags


def brute(rows):
    from collections import Counter
    c = Counter(k for k, _ in rows if k is not None)
    return sorted(((k, i, k is None or c[k] == 1) for k, i in rows), key=repr)


@pytest.mark.parametrize("opts", [{}, {"broadcast_max_keys": 0, "rows_per_hot": 3},
                                  {"broadcast_max_keys": 0, "rows_per_hot": 1, "max_hot_keys": 2}])
def test_unique_matches_brute_force_with_hot_and_null_keys(spark, opts):
    rows = [(7, i) for i in range(60)]                    # one hot key: a third of the rows
    rows += [(None, 100 + i) for i in range(50)]          # many NULL keys (pass)
    rows += [(k, 200 + k) for k in range(40)]             # unique keys (7 collides)
    rows += [(k % 10 + 1000, 300 + k) for k in range(30)]  # small duplicate groups
    df = spark.createDataFrame(rows, "k bigint, i int").repartition(5)
    out = unique_flag(df, "k", "ok", **opts)
    assert out.columns == ["k", "i", "ok"]
    got = sorted(((r.k, r.i, r.ok) for r in out.collect()), key=repr)
    assert got == brute(rows)


def test_no_duplicates_and_string_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "k string")
    assert [r.ok for r in unique_flag(df, "k", "ok").collect()] == [True] * 4
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert sorted((r.k, r.ok) for r in unique_flag(df, "k", "ok", broadcast_max_keys=0).collect()) == \
        [("a", False), ("a", False), ("b", True)]


def test_broadcast_path_has_no_shuffle_of_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber")
    out = unique_flag(df, "l_orderkey", "ok")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    n_bad = out.agg(F.count_if(~F.col("ok"))).first()[0]
    expected = (df.groupBy("l_orderkey").count().where("count > 1")
                .agg(F.sum("count")).first()[0])
    assert n_bad == expected


def test_hot_key_is_split_across_salts(spark):
    # 300 identical rows of one key plus unique keys: the salted path must
    # spread the hot key over several join partitions and stay exact.
    rows = [(1,)] * 300 + [(k,) for k in range(2, 200)]
    df = spark.createDataFrame(rows, "k bigint").repartition(4)
    out = unique_flag(df, "k", "ok", broadcast_max_keys=0, rows_per_hot=50)
    got = {r.k: r.ok for r in out.collect()}
    assert got[1] is False and all(got[k] for k in range(2, 200))
    assert out.count() == len(rows)


def test_thresholds_from_session_conf(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k bigint")
    spark.conf.set("spark.rowgate.unique.broadcastMaxKeys", "0")
    try:
        out = unique_flag(df, "k", "ok")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Union" in plan  # shuffle path taken (Spark may still broadcast a tiny side itself)
        assert sorted((r.k, r.ok) for r in out.collect()) == [(1, False), (1, False), (2, True)]
    finally:
        spark.conf.unset("spark.rowgate.unique.broadcastMaxKeys")



@pytest.mark.parametrize("hash_keys", [True, False])
def test_string_keys_hash_first_is_exact(spark, hash_keys):
    rows = [("k7",)] * 40 + [(None,)] * 10 + [(f"u{i}",) for i in range(100)] + [(f"d{i % 7}",) for i in range(21)]
    df = spark.createDataFrame(rows, "k string").repartition(3)
    from collections import Counter
    c = Counter(r[0] for r in rows if r[0] is not None)
    for opts in ({}, {"broadcast_max_keys": 0, "rows_per_hot": 5}):
        out = unique_flag(df, "k", "ok", hash_keys=hash_keys, **opts)
        got = sorted(((r.k, r.ok) for r in out.collect()), key=repr)
        assert got == sorted(((k, k is None or c[k] == 1) for (k,) in rows), key=repr)


def test_several_columns_read_the_bare_source_and_nan_is_missing(spark):
    from rowgate.operators.unique import unique_flags

    nan = float("nan")
    rows = [(1, 1.0, "a"), (1, 2.0, "b"), (2, nan, "b"), (None, nan, None), (3, 2.0, "c")]
    df = spark.createDataFrame(rows, "i int, x double, s string")
    want = [(False, True, True), (False, False, False), (True, True, False), (True, True, True), (True, False, True)]
    for opts in ({}, {"broadcast_max_keys": 0, "rows_per_hot": 1}, {"broadcast_max_bytes": 0, "max_hot_keys": 1, "rows_per_hot": 1}):
        out = unique_flags(df, {"i": "ui", "x": "ux", "s": "us"}, **opts)
        assert out.columns == ["i", "x", "s", "ui", "ux", "us"]
        assert sorted(map(repr, ((r.ui, r.ux, r.us) for r in out.collect()))) == sorted(map(repr, want))


def test_beyond_the_broadcast_bound_only_possible_matches_are_shuffled(spark):
    """Rows whose hash is in no listed bucket never reach the exchange of the join."""
    from pyspark.sql import functions as F

    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") < 200, F.col("id") % 100).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    for col in ("k", "s"):
        src = df.withColumn("s", F.concat(F.lit("key "), F.col("k").cast("string")))
        out = unique_flags(src, {col: "u"}, broadcast_max_keys=0, rows_per_hot=10)
        assert out.where("NOT u").count() == 200 and out.count() == n
        assert out.where("NOT u").agg(F.max("k")).first()[0] == 99
        from rowgate.operators.unique import duplicate_table, hash_bitmap, in_bitmap
        listed, stats = duplicate_table(src, col, None, 0)
        bitmap, size = hash_bitmap(listed.select(F.xxhash64("__rg_k")), stats["keys"])
        hits = in_bitmap(src, f"xxhash64({col})", bitmap, size, "hit").where("hit").count()
        assert 200 <= hits < 400  # of 20,000: what the join moves


def test_bitmap_has_exactly_the_bits_of_its_hashes(spark):
    from rowgate.operators.unique import hash_bitmap, in_bitmap

    values = [0, 1, 7, 8, 31, 32, 63, 64, 32767, 32768, 40000, 65535, -1, -2, 2 ** 62]
    hashes = spark.createDataFrame([(v,) for v in values], "h long")
    bitmap, size = hash_bitmap(hashes, 3000)
    assert size == 65536
    probe = spark.createDataFrame([(v,) for v in [*values, 2, 9, 30, 33, 32766, 32769, -3, None]], "h long")
    got = {r.h: r.hit for r in in_bitmap(probe, "h", bitmap, size, "hit").collect()}
    marked = {v % 65536 for v in values}
    assert got == {r: (r is not None and r % 65536 in marked) for r in got}
