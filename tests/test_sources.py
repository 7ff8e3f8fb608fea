"""Rules over any source: the source's own plan refuses no rule, and no row is
lost whatever the rules' SQL says of the time."""
import pytest
from pyspark.sql import functions as F

from rowgate import run_validation
from rowgate.operators.checks import compile_rules
from rowgate.operators.split import invalid_rows
from rowgate.plans.runner import RulesRefused

SF = "/root/testdata/sf0.001"


def sources(spark):
    base = spark.createDataFrame([(i % 5, i, [i, i + 1]) for i in range(20)], "k int, v int, xs array<int>")
    base.createOrReplaceTempView("rg_base")
    spark.sql("SELECT k, sum(v) AS v, any_value(xs) AS xs FROM rg_base GROUP BY k").createOrReplaceTempView("rg_view")
    yield "aggregate", base.groupBy("k").agg(F.sum("v").alias("v"), F.first("xs").alias("xs"))
    yield "explode", base.select("k", F.explode("xs").alias("v"))
    yield "lateral view", spark.sql("SELECT k, x AS v FROM rg_base LATERAL VIEW explode(xs) t AS x")
    yield "window", spark.sql("SELECT k, row_number() OVER (ORDER BY v) AS v FROM rg_base")
    yield "view", spark.table("rg_view")
    yield "clock", base.select("k", "v", F.current_timestamp().alias("ts"))
    yield "random", base.select("k", F.rand(3).alias("v"))
    yield "union", base.select("k", "v").unionAll(base.groupBy("k").agg(F.max("v").alias("v")))
    yield "join", base.select("k", "v").join(base.groupBy("k").count(), "k")


GOOD = ["not null", "greater than 1000", "sql: v > 1000 OR k > 1000", "sql: count(*) over (partition by k) > 1000"]
BAD = {"sql: max(v) > 1": "aggregat", "sql: explode(array(true))": "generator", "sql: row_number() over (order by v) = 1": "PARTITION BY",
       "sql: rand() > 0.5": "deterministic", "sql: v": "not boolean"}


@pytest.mark.parametrize("which", range(9))
def test_what_the_source_is_made_of_refuses_no_rule(spark, which):
    name, df = list(sources(spark))[which]
    checks = compile_rules([("v", "int", r) for r in [*GOOD, *BAD]], df, type_checks=False)
    for c in checks[:len(GOOD)]:
        assert c.error is None, (name, c.rule, c.error)
    for c, (rule, why) in zip(checks[len(GOOD):], BAD.items()):
        assert c.error and (why in c.error or "GROUP" in c.error.upper()), (name, rule, c.error)
    assert invalid_rows(df, [("v", "int", "greater than 1000000")]).count() == df.count()


@pytest.mark.parametrize("which", [0, 1, 3, 6])
def test_every_row_that_breaks_a_rule_is_invalid(spark, tmp_path, which):
    name, df = list(sources(spark))[which]
    res = run_validation(df, [("v", "int", "greater than 1000000")], f"{tmp_path}/v", f"{tmp_path}/i")
    assert (res.valid_count, res.invalid_count) == (0, df.count()), name


def test_a_run_whose_rules_are_all_refused_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(RulesRefused, match="must look nice.*not understood.*nope"):
        run_validation(df, [("a", "int", "must look nice"), ("nope", "int", "not null")], f"{tmp_path}/v", f"{tmp_path}/i")
    assert not (tmp_path / "v").exists()
    res = run_validation(df, [("a", "int", "must look nice"), ("a", "int", "not null")], f"{tmp_path}/v", f"{tmp_path}/i")
    assert res.valid_count == 1 and len([c for c in res.checks if c.error]) == 1
    assert run_validation(df, [], f"{tmp_path}/v", f"{tmp_path}/i").valid_count == 1


TIME_RULES = ["ts <= current_timestamp()", "ts <= now()", "ts <= current_timestamp", "CAST(ts AS DATE) <= current_date",
              "unix_timestamp(ts) <= unix_timestamp()", "CAST(ts AS TIMESTAMP_NTZ) <= localtimestamp()",
              "CAST(ts AS DATE) <= curdate() /* now() */ AND '-- now()' <> 'now()'"]


def test_free_sql_is_judged_at_one_moment(spark):
    from datetime import datetime, timezone

    when = datetime(2021, 5, 4, 3, 2, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(1,)], "id int").selectExpr("id", "TIMESTAMP '2021-05-04 03:02:01 UTC' AS ts",
                                                            "TIMESTAMP '2021-05-06 03:02:01 UTC' AS late")
    rules = [("ts", "timestamp", f"sql: {r}") for r in TIME_RULES] + [("ts", "timestamp", "sql: " + r.replace("ts", "late", 1)
                                                                       .replace("(late", "(late")) for r in TIME_RULES if r.startswith("ts")]
    checks = compile_rules(rules, df, type_checks=False, run_time=when)
    assert not any(c.error or c.clock for c in checks), [(c.rule, c.error) for c in checks]
    for c in checks:
        assert "current_timestamp" not in c.sql and "2021-05-04" in c.sql and c.expression == c.rule[5:]
    row = df.selectExpr(*[f"({c.sql}) AS c{i}" for i, c in enumerate(checks)]).first()
    assert list(row) == [True] * len(TIME_RULES) + [False] * (len(checks) - len(TIME_RULES))


def test_a_column_may_be_called_like_the_clock(spark):
    df = spark.createDataFrame([(1, 2)], "current_date int, now int")
    checks = compile_rules([("now", "int", "sql: current_date < now AND `now` = 2 AND 'now()' = 'now()'")], df, type_checks=False)
    assert checks[0].error is None and checks[0].run_sql is None


def test_a_clock_that_cannot_be_bound_is_judged_in_one_job(spark, tmp_path):
    from rowgate.operators.checks import active

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rg_not_late(t TIMESTAMP) RETURNS BOOLEAN RETURN t <= current_timestamp()")
    df = spark.range(0, 60000, 1, 6).selectExpr("id", "timestampadd(MILLISECOND, CAST((id % 20000) - 4000 AS INT), TIMESTAMP '2000-01-01') AS old")
    df = df.selectExpr("id", "CASE WHEN id % 2 = 0 THEN old ELSE TIMESTAMP '2999-01-01' END AS ts")
    rule = [("ts", "timestamp", "sql: rg_not_late(ts)")]
    assert active(compile_rules(rule, df, type_checks=False))[0].clock
    res = run_validation(df, rule, f"{tmp_path}/v", f"{tmp_path}/i")
    v, i = spark.read.parquet(f"{tmp_path}/v"), spark.read.parquet(f"{tmp_path}/i")
    assert (v.count(), i.count(), res.total) == (30000, 30000, 60000)


def test_no_row_is_lost_while_the_clock_passes_its_timestamp(spark, tmp_path):
    """Timestamps spread over the seconds in which the run takes place."""
    from datetime import datetime, timezone

    base = int(datetime.now(timezone.utc).timestamp() * 1000)
    n = 200_000
    df = spark.range(0, n, 1, 8).selectExpr("id", f"timestamp_millis({base} + (id * 8000) div {n}) AS ts")
    for name, rule in (("sql", "sql: ts <= current_timestamp()"), ("udf", "sql: rg_not_late(ts)"), ("text", "not in the future")):
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rg_not_late(t TIMESTAMP) RETURNS BOOLEAN RETURN t <= current_timestamp()")
        res = run_validation(df, [("ts", "timestamp", rule)], f"{tmp_path}/{name}/v", f"{tmp_path}/{name}/i")
        ids = spark.read.parquet(f"{tmp_path}/{name}/v").select("id").unionAll(spark.read.parquet(f"{tmp_path}/{name}/i").select("id"))
        assert (ids.count(), ids.distinct().count(), res.total) == (n, n, n), rule
