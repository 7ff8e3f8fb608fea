import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["check_name", "failed_records", "failure_rate_pct"] and len(rows) > 0


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["failure_summary", "rule_compare", "unique_orderkey_salted", "suggest_rules_orders",
                                  "review_sources", "invalid_rows", "compiled_rules", "sample_rows"])
def test_matches_duckdb_at_smallest_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)

    def norm(cols, rows):
        idx = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx) for r in rows),
                      key=repr)
    assert norm(df.columns, [tuple(r) for r in df.collect()]) == norm(dcols, cur.fetchall())
