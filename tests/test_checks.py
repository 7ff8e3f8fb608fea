from pyspark.sql import functions as F

from rowgate.operators.checks import active, apply_checks, compile_rules, compiled_rules


def frame(spark):
    return spark.createDataFrame(
        [(1, "a@b.com", "ACTIVE", "20"), (2, "bad", "X", "abc"), (None, None, None, None)],
        "id int, email string, status string, age string")


def test_order_and_names(spark):
    rules = [("age", "int", "value must be greater than 18"), ("email", "string", "Should be a valid email address"),
             ("age", "int", "Not Null")]
    checks = compile_rules(rules, frame(spark))
    assert [c.name for c in checks] == [
        "age_type_ok", "email_type_ok",
        "age_value_must_be_greater_than_18_0_ok", "email_should_be_a_valid_email_addres_1_ok", "age_not_null_2_ok"]
    assert [c.kind for c in checks] == ["type", "type", "rule", "rule", "rule"]


def test_type_checks_keyed_on_column_and_type(spark):
    # Two spellings that sanitise to one name keep both checks (suffixed).
    df = spark.createDataFrame([("1", "2")], "`a b` string, a_b string")
    checks = compile_rules([("a b", "int", "Not Null"), ("a_b", "int", "Not Null"), ("a_b", "date", "Not Null")], df)
    types = [c for c in checks if c.kind == "type"]
    assert [c.name for c in types] == ["a_b_type_ok", "a_b_type_ok_2", "a_b_type_ok_3"]
    assert [(c.column_name, c.data_type) for c in types] == [("a b", "int"), ("a_b", "int"), ("a_b", "date")]


def test_bad_rules_are_isolated(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    rules = [("o_orderdate", "int", "Not Null"),          # illegal cast timestamp_ntz -> int (type check)
             ("nope", "int", "Not Null"),                  # unknown column
             ("o_orderkey", "bigint", "should look nice"),  # not understood
             ("o_orderkey", "bigint", "sql: o_orderkey +"),  # parse error
             ("o_orderkey", "bigint", "sql: o_orderkey + 1"),  # not boolean
             ("o_totalprice", "double", "at least 0")]
    checks = compile_rules(rules, df)
    errors = {c.name: c.error for c in checks}
    assert errors["o_orderdate_type_ok"] is not None
    assert errors["nope_type_ok"] is not None
    assert errors["o_orderkey_type_ok"] is None
    assert errors["o_orderkey_should_look_nice_2_ok"].startswith("rule not understood")
    assert errors["o_orderkey_sql__o_orderkey___3_ok"] is not None
    assert "not boolean" in errors["o_orderkey_sql__o_orderkey___1_4_ok"]
    assert errors["o_totalprice_at_least_0_5_ok"] is None
    checked = apply_checks(df, checks)
    assert set(c.name for c in active(checks)) <= set(checked.columns)
    assert checked.count() == df.count()
    table = compiled_rules(spark, checks).collect()
    assert len(table) == len(checks) and sum(r.error is not None for r in table) == 6


def test_uncastable_values_give_null_not_ansi_error(spark):
    df = frame(spark)
    checks = compile_rules([("age", "int", "greater than 18")], df)
    rows = apply_checks(df, checks).orderBy("id").collect()
    rule = "age_greater_than_18_0_ok"
    assert [r[rule] for r in rows] == [True, True, None] or [r[rule] for r in rows] == [None, True, None]
    by_id = {r.id: r for r in rows}
    assert by_id[1][rule] is True and by_id[2][rule] is None and by_id[2]["age_type_ok"] is False


def test_translator_hook(spark):
    df = frame(spark)
    checks = compile_rules([("status", "string", "looks like a status")], df,
                           translator=lambda c, t, r: f"`{c}` RLIKE '^[A-Z]+$'")
    assert all(c.ok for c in checks)
    out = apply_checks(df, checks).select(F.count_if(~F.col(checks[-1].name))).first()[0]
    assert out == 0


def test_single_projection(spark):
    df = frame(spark)
    checks = compile_rules([("age", "int", "Not Null"), ("email", "string", "Not Null")], df)
    plan = apply_checks(df, checks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1


def test_compiled_table_works_as_expression_cache(spark, tmp_path):
    from rowgate.operators.checks import expression_cache
    df = frame(spark)
    rules = [("status", "string", "looks like a status")]
    first = compile_rules(rules, df)
    assert first[-1].error is not None
    table = compiled_rules(spark, first).toPandas()
    table.loc[table.check_name == first[-1].name, ["expression", "error"]] = ["`status` RLIKE '^[A-Z]{2,}$'", None]
    path = str(tmp_path / "compiled")
    spark.createDataFrame(table, compiled_rules(spark, first).schema).write.parquet(path)
    cached = compile_rules(rules, df, translator=expression_cache(spark.read.parquet(path)))
    assert all(c.ok for c in cached)
    assert apply_checks(df, cached).where(f"NOT {cached[-1].name}").count() == 1  # 'X' passes, NULL -> NULL


def test_decimal_and_date_rules(spark):
    df = spark.createDataFrame([("12.345", "2024-02-01"), ("abc", "2023-12-31"), ("999999999.5", "not a date")],
                               "amount string, d string")
    rules = [("amount", "decimal(10,2)", "at most 1000"), ("d", "date", "after '2024-01-01'"),
             ("d", "date", "valid date")]
    checks = compile_rules(rules, df)
    assert all(c.ok for c in checks), [c.error for c in checks]
    rows = {r.amount: r for r in apply_checks(df, checks).collect()}
    assert rows["12.345"]["amount_type_ok"] is True and rows["abc"]["amount_type_ok"] is False
    assert rows["999999999.5"]["amount_type_ok"] is False  # does not fit decimal(10,2)
    assert rows["12.345"]["amount_at_most_1000_0_ok"] is True
    assert rows["12.345"]["d_after__2024_01_01__1_ok"] is True
    assert rows["abc"]["d_after__2024_01_01__1_ok"] is False
    assert rows["999999999.5"]["d_after__2024_01_01__1_ok"] is None
    assert rows["12.345"]["d_valid_date_2_ok"] is True  # same type as declared: left to the type check


def test_sql_rule_with_trailing_comment(spark):
    df = frame(spark)
    checks = compile_rules([("id", "int", "sql: id > 1 -- ids start at 2")], df, type_checks=False)
    assert checks[0].ok, checks[0].error
    assert apply_checks(df, checks).where(f"{checks[0].name} = false").count() == 1


def test_grammar_output_always_analyses(spark):
    import random

    from rowgate.functions.grammar import RuleSyntaxError, parse_rule, to_sql
    from rowgate.operators.checks import _analyze_all

    words = ["must", "should", "be", "not", "null", "unique", "one", "of", "['A', 'B']", "[1, 2]", "greater",
             "less", "than", "at", "least", "most", "between", "and", "5", "-2.5", "'x'", "valid", "email",
             "number", "length", "positive", "'2024-01-01'", "=", ">=", "allowed", "values:", "date", "format",
             "'yyyy-MM-dd'", "starts", "with", "contains", "match", "pattern", "'^a'", "empty", "required",
             "after", "before", "integer", "characters", "in the past", "not in the future", "uppercase",
             "digits only", "valid url", "alphanumeric", "must be null"]
    df = spark.createDataFrame([], "s string, i int, d double, t date, ts timestamp, b boolean")
    rnd = random.Random(7)
    sqls = []
    for _ in range(3000):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))
        try:
            spec = parse_rule(text)
        except RuleSyntaxError:
            continue
        for col, dtype in (("s", "string"), ("i", "int"), ("d", "double"), ("t", "date"), ("ts", "timestamp")):
            try:
                q = to_sql(spec, f"`{col}`", dtype, dtype)
            except RuleSyntaxError:
                continue
            if q is not None:
                sqls.append((text, dtype, q))
    assert len(sqls) > 100
    errors = _analyze_all(df, [q for _, _, q in sqls])
    bad = [(t, d, q, e) for (t, d, q), e in zip(sqls, errors) if e]
    assert not bad, bad[:5]


def test_shape_rules_run(spark):
    df = spark.createDataFrame([("ABC", "http://x.org/a", "2020-01-01"), ("aBc", "ftp://x", "2999-01-01")],
                               "s string, u string, d string")
    checks = compile_rules([("s", "string", "uppercase"), ("u", "string", "valid url"),
                            ("d", "string", "not in the future")], df, type_checks=False)
    rows = {r.s: r for r in apply_checks(df, checks).collect()}
    assert [rows["ABC"][c.name] for c in checks] == [True, True, True]
    assert [rows["aBc"][c.name] for c in checks] == [False, False, False]


def test_unique_on_map_column_is_a_compile_error(spark):
    df = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    checks = compile_rules([("m", "string", "unique")], df, type_checks=False)
    assert checks[0].error and "map" in checks[0].error
    assert apply_checks(df, checks).count() == 1


def test_faulty_sql_is_refused_and_the_rest_still_counts(spark):
    from rowgate.operators.checks import active, apply_checks, compile_rules

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "Id int, s string")
    bad = ["sql: count(*) > 1", "sql: max(id) > 1", "sql: explode(array(true, false))", "sql: rand() > 0.5", "sql: nope = 1",
           "sql: count(*) over () > 1", "sql: row_number() over (order by id) = 1", "sql: id", "sql: id = ", "sql: uuid() <> ''"]
    good = ["sql: id > 1 -- a comment", "sql: count(*) over (partition by id) = 1", "Must be unique", "unique and not null"]
    checks = compile_rules([("id", "int", r) for r in bad + good], df, type_checks=False)
    assert [c.error is not None for c in checks] == [True] * len(bad) + [False] * len(good)
    out = apply_checks(df, checks)
    assert out.count() == 3
    got = {c.rule: sorted(r[c.name] for r in out.select(c.column.alias(c.name)).collect()) for c in active(checks)}
    assert got == {good[0]: [False, False, True], **{r: [False, False, True] for r in good[1:]}}


def test_one_run_time_for_all_jobs(spark):
    from datetime import datetime, timezone

    from rowgate.operators.checks import compile_rules

    df = spark.createDataFrame([("2020-01-01",)], "d string")
    c = compile_rules([("d", "date", "in the past")], df, type_checks=False, run_time=datetime(2021, 1, 1, tzinfo=timezone.utc))[0]
    assert "TIMESTAMP '2021-01-01 00:00:00.000000 UTC'" in c.expression and "current_timestamp" not in c.expression
