import pytest

from rowgate.operators.prepare import strip_column_names, trim_strings


def test_strip_names(spark):
    df = spark.createDataFrame([(1, "x")], "` a ` int, `b  ` string")
    assert strip_column_names(df).columns == ["a", "b"]


def test_strip_collision_raises(spark):
    df = spark.createDataFrame([(1, 2)], "`a` int, ` a` int")
    with pytest.raises(ValueError):
        strip_column_names(df)


def test_trim_only_spaces_and_only_strings(spark):
    df = spark.createDataFrame([("  x ", "\tx\n", 3)], "a string, b string, n int")
    r = trim_strings(df).first()
    assert r.a == "x" and r.b == "\tx\n" and r.n == 3


def test_names_that_differ_in_case_only_collide_as_in_the_session(spark):
    import pytest

    from rowgate.operators.prepare import strip_column_names

    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", " A ")
    with pytest.raises(ValueError):
        strip_column_names(df)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert strip_column_names(df).columns == ["a", "A"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
