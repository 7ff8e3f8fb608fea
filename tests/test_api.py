from rowgate import Validator, review_notebook
from rowgate.plans.fixtures import DIRTY_RULES, dirty_customers


def test_validator_facade(spark, tmp_path):
    df = dirty_customers(spark.read.parquet("/root/testdata/sf0.01/customer.parquet"))
    v = Validator(spark)
    res = v.run(df, DIRTY_RULES, str(tmp_path / "v"), str(tmp_path / "i"))
    assert (res.valid_count, res.invalid_count) == (691, 809)
    s = v.summaries(df, DIRTY_RULES)
    assert s["type_checks"].count() == 5 and s["business_rules"].count() == 6
    assert v.validate(df, DIRTY_RULES).count() > 0
    assert v.sample(DIRTY_RULES).count() == 5
    assert v.suggest(spark.read.parquet("/root/testdata/sf0.001/region.parquet")).count() >= 2


def test_review_notebook_text(spark):
    rows = {r.standard: r.verdict for r in review_notebook(spark, 'pwd = "secret123"\nx = 1\n').collect()}
    assert rows["secrets"] == "FAIL" and rows["error_handling"] == "PASS"
