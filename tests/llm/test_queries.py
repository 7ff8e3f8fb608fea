import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from rowgate.llm.oracle import ORACLE
from rowgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(E.queries()) and "pipeline" in E.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in sorted(cols)) for r in df.collect()))) == \
        sorted(map(repr, (tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall())))


def test_pipeline_stages_take_effect(spark, docs, tricky_texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    df, counts = docs([(i, t, "en", f"src{i % 4}", 0) for i, t in enumerate(tricky_texts)], clashes=True), []
    from rowgate.llm.common import scratch_path
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        if name != "encode":
            assert out.columns == df.columns
        path = scratch_path(spark, "stage-test")
        out.write.parquet(path)
        df = spark.read.parquet(path)
        counts.append(df.count())
    no_letters = sum(not any(c.isalpha() for c in t or "") for t in tricky_texts)
    assert counts[0] <= len(tricky_texts) - no_letters
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[4] == counts[3]
    assert all(r.round_trip for r in df.collect())


def test_pipeline_runs_over_documents_and_over_none(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids_crc32" in out.columns
    df = docs([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert out.count() == 0
        df = out if "text" in out.columns else df
