import pytest

from rowgate.sources.rules_io import collect_rules, export_rules, load_rules, rule_stats, rules_frame


def test_csv_round_trip_with_quotes_and_commas(spark, tmp_path):
    rules = rules_frame(spark, [("status", "string", "Should be one of ['A, B', \"C\"]"),
                                ("age", "int", "value must be greater than 18")])
    export_rules(rules, str(tmp_path / "r"))
    back = load_rules(spark, str(tmp_path / "r"))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in rules.collect()]


def test_csv_columns_by_header_with_extras(spark, tmp_path):
    p = tmp_path / "rules.csv"
    p.write_text('note,rule,column_name,data_type\nx,"Not Null",id,int\ny,"say ""hi""",name,string\n')
    rows = collect_rules(load_rules(spark, str(p)))
    assert rows == [{"column_name": "id", "data_type": "int", "rule": "Not Null"},
                    {"column_name": "name", "data_type": "string", "rule": 'say "hi"'}]


def test_missing_columns_rejected(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("column_name,rule\nid,Not Null\n")
    with pytest.raises(ValueError):
        load_rules(spark, str(p))


def test_rule_stats(spark):
    rules = rules_frame(spark, [("a", "int", "x"), ("b", "int", "y"), ("c", "string", "z")])
    got = [(r.data_type, r.rule_count) for r in rule_stats(rules).collect()]
    assert got == [(None, 3), ("int", 2), ("string", 1)]


def test_invalid_rows_from_rules_path(spark, tmp_path):
    from rowgate.operators.split import invalid_rows
    p = tmp_path / "rules.csv"
    p.write_text("column_name,data_type,rule\nid,int,Not Null\nemail,string,Should be a valid email address\n")
    df = spark.createDataFrame([(None, "x"), (1, "a@b.co")], "id int, email string")
    rows = invalid_rows(df, str(p)).collect()
    assert len(rows) == 1 and len(rows[0].validation_errors) == 2


def test_export_single_csv_file(spark, tmp_path):
    import os
    rules = rules_frame(spark, [("a", "int", "Not Null"), ("b", "string", 'say "hi", then go')])
    target = str(tmp_path / "validation_rules.csv")
    export_rules(rules, target)
    assert os.path.isfile(target) and not os.path.exists(target + ".parts")
    assert [tuple(r) for r in load_rules(spark, target).collect()] == [tuple(r) for r in rules.collect()]
    export_rules(rules.limit(1), target)  # overwrite
    assert load_rules(spark, target).count() == 1
