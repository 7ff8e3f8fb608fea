"""Invariants of checks, splits and summaries on random small tables."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowgate.operators.checks import active, apply_checks, compile_rules
from rowgate.operators.report import error_array, failure_counts, split_counts
from rowgate.operators.split import split_rows

RULES = [
    ("n", "int", "Not Null"),
    ("n", "int", "between 0 and 50"),
    ("s", "string", "Should be one of ['A', 'B']"),
    ("s", "string", "Should be a valid email address"),
    ("t", "int", "greater than 5"),
    ("n", "bigint", "Must be unique"),
]

values_n = st.one_of(st.none(), st.integers(-5, 60))
values_s = st.one_of(st.none(), st.sampled_from(["A", "B", "C", "a@b.co", "bad@x", " A "]))
values_t = st.one_of(st.none(), st.sampled_from(["1", "9", "x", "", "12.5", " 7 "]))
rows_st = st.lists(st.tuples(values_n, values_s, values_t), min_size=0, max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st)
def test_split_and_error_invariants(spark, rows):
    df = spark.createDataFrame(rows, "n int, s string, t string")
    checks = compile_rules(RULES, df, type_checks=True)
    usable = active(checks)
    checked = apply_checks(df, usable, broadcast_max_keys=1)  # also exercise the salted path
    valid, invalid = split_rows(checked, usable)
    total = len(rows)
    assert valid.count() + invalid.count() == total
    counts = {r.split: r.records for r in split_counts(checked, usable).collect()}
    assert sum(counts.values()) == total

    rule_checks = [c for c in usable if c.kind != "type"]
    fails = failure_counts(checked, rule_checks).first()
    sizes = checked.select(F.size(error_array(rule_checks)).alias("k")).agg(F.sum("k")).first()[0] or 0
    assert sizes == sum(fails[c.name] for c in rule_checks)

    # brute-force uniqueness on the raw values
    from collections import Counter
    seen = Counter(r[0] for r in rows if r[0] is not None)
    uniq = [c for c in usable if c.kind == "unique"][0]
    expected = sum(1 for r in rows if r[0] is not None and seen[r[0]] > 1)
    assert fails[uniq.name] == expected
