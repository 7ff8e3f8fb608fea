import pytest

from rowgate import ExpressionCache, Validator, compile_rules, read_expressions
from rowgate.sources.expressions import compact_expressions

RULES = [("a", "int", "looks fine"), ("a", "integer", "looks fine"), ("b", "string", "looks fine"), ("a", "int", "at least 1"), ("a", "int", "breaks")]


class Model:
    def __init__(self):
        self.calls = []

    def __call__(self, column, data_type, rule):
        self.calls.append((column, data_type, rule))
        if rule == "breaks":
            raise RuntimeError("no answer")
        return f"`{column}` IS NOT NULL OR now() > TIMESTAMP '2000-01-01'"


def test_the_translator_is_asked_once_per_key(spark, tmp_path):
    df, path, model = spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "cache"), Model()
    for n in (1, 2):
        checks = compile_rules(RULES, df, translator=ExpressionCache(spark, path, model), type_checks=False)
        assert [c.error is None for c in checks] == [True, True, True, True, False]
        # answers are kept, failures are asked again; both spellings of a type are one key
        assert len(model.calls) == 2 + n and model.calls.count(("a", "int", "looks fine")) == 1
    assert "now()" in checks[0].expression and "now()" not in checks[0].sql  # kept as given, bound per run
    assert read_expressions(spark, path).count() == 2
    compile_rules(RULES[:3], df, translator=ExpressionCache(spark, path), type_checks=False, on_error="raise")


def test_the_last_write_wins_and_compaction_keeps_it(spark, tmp_path):
    path = str(tmp_path / "cache")
    for text in ("a = 1", "a = 2"):
        cache = ExpressionCache(spark, path)
        cache.put("a", "int", "r", "never seen")
        cache.put("a", "int", "r", text)
        cache.flush()
        cache.flush()
    assert ExpressionCache(spark, path)("a", "INT", "r") == "a = 2"
    assert spark.read.parquet(path).count() == 4
    assert compact_expressions(spark, path, str(tmp_path / "small")) == 1
    assert ExpressionCache(spark, str(tmp_path / "small"))("a", "int", "r") == "a = 2"


def test_an_empty_cache_knows_nothing(spark, tmp_path):
    assert read_expressions(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([(1,)], "a int")
    assert compile_rules([("a", "int", "looks fine")], df, translator=ExpressionCache(spark, str(tmp_path / "none")), type_checks=False)[0].error
    v = Validator(spark, translator=Model(), cache_path=str(tmp_path / "v"))
    assert v.validate(df, [("a", "int", "looks fine")]).count() == 0 and read_expressions(spark, str(tmp_path / "v")).count() == 1


def test_a_damaged_cache_is_not_taken_for_an_empty_one(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        ExpressionCache(spark, str(tmp_path / "cache"))
