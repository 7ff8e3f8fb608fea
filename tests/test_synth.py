import datetime

from rowgate.operators.synth import sample_rows


def test_golden_sample_rows(spark):
    rules = [("id", "int", "Not Null"), ("email", "string", "Should be a valid email address"),
             ("status", "string", "Should be one of ['ACTIVE', 'INACTIVE']"), ("name", "string", "Not Null"),
             ("joined", "date", "Not Null"), ("id", "bigint", "Must be unique")]
    rows = [tuple(r) for r in sample_rows(spark, rules).collect()]
    d = datetime.date
    assert rows == [
        (10, "invalid-email", "ACTIVE", "FirstName0", d(2024, 1, 1)),
        (20, "user1@example.com", "INACTIVE", "FirstName1", d(2024, 1, 2)),
        (30, "user2@example.com", "ACTIVE", "FirstName2", d(2024, 1, 3)),
        (40, "user3@example.com", "INACTIVE", "FirstName3", d(2024, 1, 4)),
        (None, None, None, None, None),
    ]


def test_other_types(spark):
    rules = [("amount", "double", "x"), ("at", "timestamp", "x"), ("ok", "boolean", "x"), ("code", "string", "x"),
             ("n", "bigint", "x")]
    df = sample_rows(spark, rules, n=3)
    assert df.schema.simpleString() == "struct<amount:double,at:timestamp,ok:boolean,code:string,n:bigint>"
    rows = df.collect()
    assert [r.amount for r in rows[:3]] == [1.1, 2 * 1.1, 3 * 1.1]
    assert rows[1].at == datetime.datetime(2024, 1, 2, 12, 0, 0)
    assert [r.ok for r in rows] == [True, False, True, None]
    assert rows[2].code == "value_2" and rows[0].n == 10


def test_scales_with_n(spark):
    df = sample_rows(spark, [("d", "date", "x")], n=1000)
    assert df.count() == 1001
    assert df.where("d = date'2024-01-28'").count() == len([i for i in range(1000) if i % 28 == 27])


def test_large_n_gets_bounded_partitions(spark, monkeypatch):
    import rowgate.operators.synth as S
    monkeypatch.setattr(S, "ROWS_PER_PARTITION", 100)
    df = S.sample_rows(spark, [("n", "int", "x")], n=2_000, null_row=False)
    assert df.rdd.getNumPartitions() >= 20 and df.count() == 2_000
