import random

import pytest
from pyspark.sql import functions as F

from rowgate.operators.profile import profile_columns, suggest_rules
from rowgate.operators.profile_state import add_part, merged_profile, merged_suggestions, parts

SCHEMA = ("id long, small int, key string, mail string, grade string, x double, day date, at timestamp, flag boolean, amount decimal(10,2), "
          "long_text string, empty string")


def rows(rng, n, start=0):
    out = []
    for i in range(start, start + n):
        out.append((i, rng.randint(0, 5), f" key {i} ", f"u{i}@x.org" if i % 10 else "none", rng.choice(["A", "B", "C", None]),
                    float("nan") if i % 7 == 0 else i / 3, None, None, i % 2 == 0, None, f"{'t' * 200}{i % 50}", None))
    return out


def same(spark, path, whole):
    got, want = merged_profile(spark, path).collect(), profile_columns(whole).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert [tuple(r) for r in merged_suggestions(spark, path).collect()] == [tuple(r) for r in suggest_rules(whole).collect()]


def test_merged_parts_are_the_whole(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "s")
    data = [rows(rng, 40), rows(rng, 25, 40), rows(rng, 1, 65), []]
    assert parts(spark, path) == []
    for i, d in enumerate(data):
        add_part(spark.createDataFrame(d, SCHEMA), path, f"p{i}")
    assert parts(spark, path) == ["p0", "p1", "p2", "p3"]
    same(spark, path, spark.createDataFrame([r for d in data for r in d], SCHEMA))


def test_a_value_that_repeats_only_across_parts(spark, tmp_path):
    path = str(tmp_path / "s")
    a = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5)], "i int, s string, d double")
    b = spark.createDataFrame([(3, "c", 2.5), (4, "a", -0.0)], "i int, s string, d double")
    add_part(a, path, "a")
    assert [r.is_unique for r in merged_profile(spark, path).collect()] == [True, True, True]
    add_part(b, path, "b")
    assert [r.is_unique for r in merged_profile(spark, path).collect()] == [True, False, False]
    same(spark, path, a.unionByName(b))


def test_more_values_than_a_list_holds_only_together(spark, tmp_path):
    path = str(tmp_path / "s")
    for p in range(3):
        add_part(spark.createDataFrame([(f"v{p}-{i % 4}",) for i in range(20)], "s string"), path, str(p))
    r = merged_profile(spark, path).first()
    assert r["values"] is None and r.small_distinct is None and not r.is_unique


def test_a_part_is_replaced_by_its_next_load_and_a_dead_load_is_no_part(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "s"), spark.range(10).toDF("i")
    add_part(df, path, "a")
    add_part(df.where("i < 4"), path, "a")
    assert merged_profile(spark, path).first().row_count == 4
    from rowgate.operators import profile_state
    with monkeypatch.context() as m:
        m.setattr(profile_state, "STATE", None)  # dies after the hashes, before the columns
        with pytest.raises(Exception):
            add_part(df.where("i >= 2"), path, "b")
    r = merged_profile(spark, path).first()
    assert parts(spark, path) == ["a"] and r.row_count == 4 and r.is_unique
    with pytest.raises(ValueError):
        add_part(df, path, "a/b")
    with pytest.raises(ValueError, match="do not agree"):
        add_part(df.toDF("j"), path, "c")
        merged_profile(spark, path)


def test_merging_reads_no_data_again(spark, tmp_path):
    path, src = str(tmp_path / "s"), str(tmp_path / "data")
    spark.range(100).selectExpr("id", "CAST(id % 3 AS STRING) AS s").write.parquet(src)
    add_part(spark.read.parquet(src), path, "one")
    import shutil
    shutil.rmtree(src)
    assert [r.is_unique for r in merged_profile(spark, path).collect()] == [True, False]


def test_two_moments_with_one_text_are_two_values(spark, tmp_path):
    """01:30 happens twice when the clocks go back in New York."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1,), (2,)], "i int").select(F.expr(
            "CASE i WHEN 1 THEN TIMESTAMP '2023-11-05 05:30:00 UTC' ELSE TIMESTAMP '2023-11-05 06:30:00 UTC' END").alias("at"))
        assert df.select(F.col("at").cast("string")).distinct().count() == 1
        assert [tuple(r) for r in suggest_rules(df).collect()] == [("at", "timestamp", "Not Null"), ("at", "timestamp", "Must be unique")]
        add_part(df, str(tmp_path / "s"), "a")
        assert merged_profile(spark, str(tmp_path / "s")).first().is_unique
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
