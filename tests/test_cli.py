from rowgate.__main__ import main


def test_cli_suggest_validate_review(spark, tmp_path, capsys):
    src = "/root/testdata/sf0.001/orders.parquet"
    assert main(["suggest", "--source", src, "--out", str(tmp_path / "rules")]) == 0
    assert main(["validate", "--rules", str(tmp_path / "rules"), "--source", src,
                 "--valid", str(tmp_path / "v"), "--invalid", str(tmp_path / "i")]) == 0
    out = capsys.readouterr().out
    n = spark.read.parquet(src).count()
    assert f"valid={n} invalid=0" in out
    (tmp_path / "nb").mkdir()
    (tmp_path / "nb" / "x.py").write_text('password = "hunter22"\n')
    assert main(["review", "--source", str(tmp_path / "nb"), "--out", str(tmp_path / "report")]) == 0
    rep = {r.standard: r.verdict for r in spark.read.parquet(str(tmp_path / "report")).collect()}
    assert rep["secrets"] == "FAIL" and rep["performance"] == "PASS"
    assert main(["sample", "--rules", str(tmp_path / "rules"), "--n", "3", "--out", str(tmp_path / "s")]) == 0
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_cli_summary_only(spark, tmp_path, capsys):
    rules = tmp_path / "r.csv"
    rules.write_text("column_name,data_type,rule\no_orderstatus,string,\"Should be one of ['F', 'O']\"\n")
    assert main(["validate", "--rules", str(rules), "--source", "/root/testdata/sf0.001/orders.parquet"]) == 0
    assert "o_orderstatus_should_be_one_of" in capsys.readouterr().out


def test_example_rules_compile_and_pass_on_orders(spark):
    from rowgate.operators.checks import compile_rules
    from rowgate.plans.runner import validation_summary
    from rowgate.sources.rules_io import load_rules
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples", "rules_orders.csv")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    checks = compile_rules(load_rules(spark, path), orders)
    assert all(c.ok for c in checks), [(c.name, c.error) for c in checks if not c.ok]
    got = {r.check_name: r.failed_records for r in validation_summary(orders, path).collect()}
    # the data holds o_custkey = 0 rows: "positive" finds exactly those, every other rule passes
    assert got == {"o_custkey_positive_2_ok": orders.where("o_custkey <= 0").count()}
