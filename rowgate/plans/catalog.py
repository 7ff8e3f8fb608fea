"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator, each over whole tables of ``sf_dir`` (or data Spark derives from
them). The DuckDB oracle for each key lives in ``oracle.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.checks import active, apply_checks, compile_rules, compiled_rules
from ..operators.prepare import strip_column_names, trim_strings
from ..operators.profile import profile_columns, suggest_rules
from ..operators.report import failure_counts, failure_summary, split_counts
from ..operators.review import review_sources, secret_lines
from ..operators.split import invalid_rows, invalid_split, valid_split
from ..operators.synth import sample_rows
from ..operators.unique import unique_flag, unique_flags
from ..sources.expressions import ExpressionCache
from ..sources.rules_io import export_rules, load_rules, read_sample, rule_stats, rules_frame
from ..sources.tables import load_table, preview
from .fixtures import DIRTY_RULES, dirty_customers
from .publish import publish_validation, published
from .runner import checked_frame, run_validation, run_validation_single_pass, validation_summary
from .shared import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_customers(table(spark, sf_dir, "customer"))


def _rule_columns(df: DataFrame, rules, keep: list[str]) -> DataFrame:
    """``keep`` columns plus one boolean column per business rule."""
    checks = active(compile_rules(rules, df, type_checks=False))
    return apply_checks(df, checks).select(*keep, *[c.name for c in checks])


# --- rule families (E1-E9) --------------------------------------------------

def q_type_check(spark, sf):
    d = trim_strings(dirty(spark, sf))
    checks = [c for c in compile_rules(DIRTY_RULES, d) if c.kind == "type"]
    return apply_checks(d, checks)


def q_rule_not_null(spark, sf):
    d = trim_strings(dirty(spark, sf))
    return _rule_columns(d, [("id", "bigint", "Not Null"), ("email", "string", "must not be null"),
                             ("age", "int", "required")], ["id", "email", "age"])


def q_rule_in_list(spark, sf):
    d = trim_strings(dirty(spark, sf))
    return _rule_columns(d, [("status", "string", "Should be one of ['ACTIVE', 'INACTIVE']"),
                             ("segment", "string",
                              "must be one of ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY']")],
                         ["id", "status", "segment"])


def q_rule_email(spark, sf):
    d = trim_strings(dirty(spark, sf))
    return _rule_columns(d, [("email", "string", "Should be a valid email address")], ["id", "email"])


def q_rule_compare(spark, sf):
    li = table(spark, sf, "lineitem")
    return _rule_columns(li, [
        ("l_quantity", "double", "between 1 and 40"),
        ("l_discount", "double", "at most 0.05"),
        ("l_tax", "double", "greater than or equal to 0.02"),
        ("l_extendedprice", "double", "value must be greater than 20000"),
        ("l_linenumber", "int", "< 7"),
    ], ["l_orderkey", "l_linenumber"])


def q_rule_number(spark, sf):
    d = trim_strings(dirty(spark, sf))
    return _rule_columns(d, [("age", "string", "Must be a number"), ("balance", "double", "Must be a number"),
                             ("signup", "string", "should be numeric")], ["id", "age", "balance", "signup"])


def q_rule_compound(spark, sf):
    d = trim_strings(dirty(spark, sf))
    return _rule_columns(d, [("id", "int", "Should be a number and not null"),
                             ("age", "int", "must be at least 10 and at most 60"),
                             ("balance", "double", "must be not null and between 0 and 5000")],
                         ["id", "age", "balance"])


COMPOUND_TEXTS = [
    ("email", "string", "Should be a valid email address and not null"),
    ("email", "string", "Not null and must be a valid email address"),
    ("email", "string", "should not be a valid email address"),
    ("email", "string", "must not contain 'user1' and must not be null"),
    ("email", "string", "must match pattern '^user' and not null"),
    ("email", "string", "must be a valid email or null"),
    ("id", "bigint", "Must be unique and not null"),
    ("id", "bigint", "greater than 1,000 or unique"),
    ("status", "string", "Should be one of ['ACTIVE','INACTIVE'] and not null"),
    ("status", "string", "one of: ACTIVE, PENDING and not null"),
    ("status", "string", "in ('ACTIVE') and in ('PENDING')"),
    ("status", "string", "must not be one of ['PENDING']"),
    ("status", "string", "must be 6 characters"),
    ("status", "string", "must not be null or empty"),
    ("age", "string", "must be an integer"),
    ("age", "int", "greater than 50 or null"),
    ("balance", "double", "must not be negative"),
]


def q_rule_compound_texts(spark, sf):
    """Compound, negated and alternative rules; a unique part inside a compound."""
    d = trim_strings(dirty(spark, sf))
    checks = active(compile_rules(COMPOUND_TEXTS, d, type_checks=False))
    names = {c.name: f"r{c.index}" for c in checks}
    return apply_checks(d, checks).select("id", "email", "status", "age", "balance",
                                          *[c.column.alias(names[c.name]) for c in checks])


FAULTY_RULES = [
    ("O_ORDERKEY", "bigint", "Must be unique"),
    ("o_totalprice", "double", "sql: count(*) > 1"),
    ("o_totalprice", "double", "sql: max(o_totalprice) > 5"),
    ("o_orderstatus", "string", "sql: explode(array(true, false))"),
    ("o_orderkey", "bigint", "sql: rand() > 0.5"),
    ("o_orderkey", "bigint", "sql: count(*) over () > 1"),
    ("o_orderkey", "bigint", "sql: no_such_column = 1"),
    ("o_orderstatus", "string", "sql: o_orderstatus"),
    ("o_orderstatus", "string", "must look nice"),
    ("o_orderdate", "timestamp_ntz", "sql: CAST(o_orderdate AS INT) > 1"),
    ("o_totalprice", "double", "greater than 100000"),
    ("o_orderstatus", "string", "sql: o_orderstatus <> 'F' -- a comment"),
]


def q_compiled_rules_errors(spark, sf):
    """Faulty free SQL is refused rule by rule; the others keep their counts."""
    o = table(spark, sf, "orders")
    checks = compile_rules(FAULTY_RULES, o, type_checks=False)
    counts = failure_counts(apply_checks(o, checks), checks)
    rows = [F.struct(F.lit(c.index).alias("rule_index"), F.lit(c.error is not None).alias("refused"),
                     (F.lit(None) if c.error else c.column).cast("long").alias("failed_records")) for c in checks]
    return counts.select(F.inline(F.array(*rows)))


def q_unique_two_columns(spark, sf):
    """Two unique columns: both key passes read the bare source."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return unique_flags(o, {"o_orderkey": "key_unique", "o_custkey": "cust_unique"}, broadcast_max_keys=0, rows_per_hot=5)


def q_rule_sql(spark, sf):
    o = table(spark, sf, "orders")
    return _rule_columns(o, [
        ("o_totalprice", "double", "sql: o_totalprice > 1000 AND o_orderstatus IN ('F', 'O')"),
        ("o_orderpriority", "string", "sql: length(o_orderpriority) > 5 OR o_orderpriority LIKE '1%'"),
    ], ["o_orderkey"])


def q_rule_text(spark, sf):
    p = table(spark, sf, "part")
    return _rule_columns(p, [
        ("p_name", "string", "length at most 30"),
        ("p_brand", "string", "must match pattern '^Brand#[1-3][0-9]$'"),
        ("p_type", "string", "starts with 'STANDARD'"),
        ("p_size", "int", "positive"),
        ("p_retailprice", "double", "in range 950 to 1800"),
        ("p_name", "string", "not empty"),
    ], ["p_partkey"])


def q_rule_documents(spark, sf):
    """Rules over whole texts of ``documents``."""
    d = table(spark, sf, "documents")
    return _rule_columns(d, [
        ("text", "string", "sql: length(text) = n_chars"),
        ("text", "string", "length at most 20000"),
        ("lang", "string", "Should be one of ['de', 'en', 'fr']"),
        ("text", "string", "sql: NOT (text RLIKE '[0-9]{3}-[0-9]{4}')"),
        ("doc_id", "bigint", "Must be unique"),
        ("doc_id", "bigint", "unique"),
    ], ["doc_id"])


def q_rule_events(spark, sf):
    """Rules over the event stream table, including JSON properties."""
    e = table(spark, sf, "events")
    return _rule_columns(e, [
        ("props", "string", "sql: get_json_object(props, '$.k') IS NOT NULL"),
        ("props", "string", "sql: CAST(get_json_object(props, '$.k') AS INT) BETWEEN 0 AND 50"),
        ("event_type", "string", "Should be one of ['click', 'view', 'purchase']"),
        ("value", "double", "between 0 and 400"),
        ("ts", "timestamp_ntz", "after '2024-01-15'"),
        ("event_id", "bigint", "Must be unique"),
    ], ["event_id"])


def q_rule_unique(spark, sf):
    d = trim_strings(dirty(spark, sf))
    return _rule_columns(d, [("id", "bigint", "Must be unique")], ["id", "email"])


def q_unique_orderkey(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return unique_flag(li, "l_orderkey", "l_orderkey_unique")


def q_unique_orderkey_salted(spark, sf):
    """Same result through the salted shuffle path (hot keys split)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return unique_flag(li, "l_orderkey", "l_orderkey_unique", broadcast_max_keys=0, rows_per_hot=2)


def q_unique_document_text(spark, sf):
    """Exact copies among whole texts: the hash-first pass shuffles 64-bit
    hashes, not the texts."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return unique_flag(d, "text", "text_unique").select("doc_id", "text_unique")


def q_unique_custkey_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return unique_flag(o, "o_custkey", "o_custkey_unique")


# --- rules over other columns, conditions, other tables, any source ------------

def _numbered(df: DataFrame, rules, keep: list[str], references=None) -> DataFrame:
    """``keep`` columns plus the checks of the rules as ``r0``, ``r1``, ..."""
    checks = compile_rules(rules, df, type_checks=False, references=references)
    faulty = [c for c in checks if c.error]
    if faulty:
        raise ValueError(f"{faulty[0].rule!r}: {faulty[0].error}")
    return apply_checks(df, checks).select(*keep, *[c.column.alias(f"r{c.index}") for c in checks])


def received_lines(spark, sf):
    """Line items with a receipt date, some before the shipment, some missing."""
    return table(spark, sf, "lineitem").withColumn(
        "l_receiptdate", F.expr("CASE WHEN l_partkey % 11 <> 0 THEN l_shipdate + make_dt_interval(l_linenumber * 5 - 10) END"))


CROSS_COLUMN_RULES = [
    ("l_receiptdate", "timestamp_ntz", "must be after l_shipdate"),
    ("l_receiptdate", "timestamp_ntz", "within 10 days after l_shipdate"),
    ("l_receiptdate", "timestamp_ntz", "at least 3 days after the l shipdate and not null"),
    ("l_receiptdate", "date", "not before l_shipdate"),
    ("l_extendedprice", "double", "greater than l_quantity * 1500"),
    ("l_discount", "double", "at most l_tax"),
    ("l_tax", "double", "between l_discount and 0.06"),
    ("l_discount", "double", "no more than 50% of l_tax"),
    ("l_suppkey", "bigint", "different from l_partkey"),
    ("l_linenumber", "int", "l_quantity must be at least l_linenumber and l_discount must not be negative"),
]


def q_rule_cross_column(spark, sf):
    return _numbered(received_lines(spark, sf), CROSS_COLUMN_RULES, ["l_orderkey", "l_linenumber", "l_partkey"])


CONDITIONAL_RULES = [
    ("o_totalprice", "double", "if o_orderstatus is 'F' then must be greater than 100000"),
    ("o_orderpriority", "string", "if o_totalprice is greater than 200000 and o_orderstatus is not 'P' then one of ['1-URGENT', '2-HIGH']"),
    ("note", "string", "required if o_orderstatus is P or o_orderpriority starts with '1'"),
    ("note", "string", "must be null unless o_orderstatus is 'P'"),
    ("o_totalprice", "double", "if note is missing then must be at least 50000, otherwise must be at most 300000"),
    ("o_orderkey", "bigint", "when note is 'y', o_totalprice must be less than 250000"),
    ("o_totalprice", "double", "if note is not 'x' then must be positive else must be greater than 1e5"),
]


def q_rule_conditional(spark, sf):
    """Implications; a condition about a NULL makes the rule not applicable."""
    o = table(spark, sf, "orders").withColumn("note", F.expr(
        "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 <> 0 THEN 'x' WHEN o_orderkey % 7 = 0 THEN 'y' END"))
    return _numbered(o, CONDITIONAL_RULES, ["o_orderkey", "note"])


def q_rule_exists(spark, sf):
    """Orders whose customer is not in ``customer`` (planted), NULL keys, and suppliers' nations by catalog name."""
    customers, nations = table(spark, sf, "customer"), table(spark, sf, "nation")
    o = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN -o_orderkey "
        "WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS o_custkey", "o_orderstatus")
    return _numbered(o, [("o_custkey", "bigint", "must exist in customer.c_custkey"),
                         ("o_custkey", "bigint", "not null and references customer(c_custkey)"),
                         ("o_custkey", "bigint", "if o_orderstatus is 'F' then must exist in customer.c_custkey"),
                         ("o_orderkey", "bigint", "must not exist in nation.n_nationkey")],
                     ["o_orderkey", "o_custkey"], references={"customer": customers, "nation": nations})


def q_rule_exists_shuffled(spark, sf):
    """The same beyond the broadcast bounds: bitmap, hot keys, shuffled join."""
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_linenumber = 3 THEN -7 "
                                                 "WHEN l_orderkey % 4 = 0 THEN l_partkey + 1000000000 ELSE l_partkey END AS part")
    checks = compile_rules([("part", "bigint", "must exist in part.p_partkey")], li, type_checks=False,
                           references={"part": table(spark, sf, "part")})
    return apply_checks(li, checks, broadcast_max_keys=0, rows_per_hot=100).select(
        "l_orderkey", "l_linenumber", "part", checks[0].column.alias("known"))


def q_rule_wordings(spark, sf):
    """Lists of bare words, classes of characters, a value by itself."""
    p = table(spark, sf, "part")
    return _numbered(p, [("p_type", "string", "should be ECONOMY, STANDARD or PROMO"), ("p_type", "string", "either ECONOMY or LARGE"),
                         ("p_name", "string", "must not contain special characters"), ("p_name", "string", "must not contain spaces"),
                         ("p_brand", "string", "contains only letters and digits"), ("p_brand", "string", "ends with a digit"),
                         ("p_type", "string", "must not be 'PROMO'"), ("p_name", "string", "either starts with 'red' or contains 'g'")], ["p_partkey"])


def q_checks_on_aggregated_source(spark, sf):
    """Rules over a GROUP BY; what the source is made of refuses no rule."""
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"), F.max("l_shipdate").alias("last_ship"))
    return _numbered(per_order, [("quantity", "double", "between 10 and 150"), ("lines", "bigint", "at most 6"),
                                 ("quantity", "double", "sql: quantity >= lines * 20"), ("l_orderkey", "bigint", "Must be unique"),
                                 ("last_ship", "timestamp_ntz", "after '1995-06-01'")], ["l_orderkey", "lines"])


def q_checks_on_exploded_source(spark, sf):
    """Rules over exploded rows of a view."""
    table(spark, sf, "orders").createOrReplaceTempView("rowgate_orders")
    parts = spark.sql("SELECT o_orderkey, pos, part FROM rowgate_orders LATERAL VIEW posexplode(split(o_orderpriority, '-')) t AS pos, part")
    return _numbered(parts, [("part", "string", "if pos is 0 then must match pattern '^[1-3]$'"), ("part", "string", "length at most 6"),
                             ("o_orderkey", "bigint", "Must be unique")], ["o_orderkey", "pos"])


def q_checks_on_windowed_source(spark, sf):
    """Rules over a source with a window without partitions in it."""
    table(spark, sf, "supplier").createOrReplaceTempView("rowgate_supplier")
    ranked = spark.sql("SELECT s_suppkey, s_acctbal, rank() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM rowgate_supplier")
    return _numbered(ranked, [("place", "int", "at most 50"), ("place", "int", "unique and not null"),
                              ("s_acctbal", "double", "sql: s_acctbal > 0 OR place > 10")], ["s_suppkey", "place"])


def q_run_validation_aggregated(spark, sf):
    """F9 over a GROUP BY: both outputs, read back."""
    base = scratch_path(spark, "run-aggregated")
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    run_validation(per_order, [("lines", "bigint", "at most 4"), ("l_orderkey", "bigint", "not null")], f"{base}/valid", f"{base}/invalid")
    return (spark.read.parquet(f"{base}/valid").select(F.lit("valid").alias("split"), "l_orderkey", "lines")
            .unionByName(spark.read.parquet(f"{base}/invalid").select(F.lit("invalid").alias("split"), "l_orderkey", "lines")))


def q_run_validation_sql_time(spark, sf):
    """F9 with the current time in free SQL, over timestamps that the clock
    passes while the run takes place: every row is in exactly one output."""
    base = scratch_path(spark, "run-sql-time")
    start = spark.sql("SELECT unix_millis(current_timestamp())").first()[0]
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 f"timestamp_millis({start} + pmod(l_partkey * 37 + l_suppkey, 9000)) AS ts")
    res = run_validation(li, [("ts", "timestamp", "sql: ts <= current_timestamp()"), ("ts", "timestamp", "sql: ts <= now() OR ts > current_date")],
                         f"{base}/valid", f"{base}/invalid")
    v, i = spark.read.parquet(f"{base}/valid"), spark.read.parquet(f"{base}/invalid")
    rows = v.unionByName(i.select(*v.columns)).groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("copies"))
    return rows.withColumn("total", F.lit(res.total).cast("long"))


# --- results (F1-F9) --------------------------------------------------------

def _dirty_checked(spark, sf):
    return checked_frame(dirty(spark, sf), DIRTY_RULES)


def q_failure_summary(spark, sf):
    checked, checks = _dirty_checked(spark, sf)
    return failure_summary(checked, checks)


def q_validation_summary(spark, sf):
    """F4 with uniqueness counted from duplicate-key statistics (no row join)."""
    return validation_summary(dirty(spark, sf), DIRTY_RULES)


def q_summary_documents(spark, sf):
    """Summary-only run over whole texts; text uniqueness is counted from the
    hash-first duplicate pass."""
    return validation_summary(table(spark, sf, "documents"), [
        ("text", "string", "unique"),
        ("lang", "string", "Should be one of ['de', 'en', 'fr']"),
        ("text", "string", "length at most 20000"),
    ])


def q_checked_rows(spark, sf):
    checked, _ = _dirty_checked(spark, sf)
    return checked


def q_invalid_rows(spark, sf):
    out = invalid_rows(dirty(spark, sf), rules_frame(spark, DIRTY_RULES))
    return out.select(*[c for c in out.columns if c != "validation_errors"],
                      F.array_join("validation_errors", "|").alias("validation_errors"))


def q_split_valid(spark, sf):
    checked, checks = _dirty_checked(spark, sf)
    return valid_split(checked, checks).select(*dirty(spark, sf).columns)


def q_split_invalid(spark, sf):
    checked, checks = _dirty_checked(spark, sf)
    return invalid_split(checked, checks)


def q_preview_invalid(spark, sf):
    """The first 10 invalid rows in a total order (top-n is the feature)."""
    checked, checks = _dirty_checked(spark, sf)
    inv = invalid_split(checked, checks)
    order = [F.col(c).asc_nulls_last() for c in ["id", "email", "status", "age", "signup", "balance", "segment"]]
    return preview(inv, 10, order_by=order)


def q_split_counts(spark, sf):
    checked, checks = _dirty_checked(spark, sf)
    return split_counts(checked, checks)


def q_run_validation(spark, sf):
    base = scratch_path(spark, "run")
    res = run_validation(dirty(spark, sf), DIRTY_RULES, f"{base}/valid", f"{base}/invalid")
    return res.summary


def q_run_validation_single_pass(spark, sf):
    base = scratch_path(spark, "run1")
    return run_validation_single_pass(dirty(spark, sf), DIRTY_RULES, f"{base}/out").summary


def q_run_validation_outputs(spark, sf):
    """Rows per written output, read back from storage."""
    base = scratch_path(spark, "run")
    run_validation(dirty(spark, sf), DIRTY_RULES, f"{base}/valid", f"{base}/invalid")
    v = spark.read.parquet(f"{base}/valid").select(F.lit("valid").alias("split"), F.col("id"))
    i = spark.read.parquet(f"{base}/invalid").select(F.lit("invalid").alias("split"), F.col("id"))
    return v.unionByName(i).groupBy("split").agg(F.count(F.lit(1)).alias("records"),
                                                 F.count("id").alias("ids"))


def q_run_validation_time_rule(spark, sf):
    """F9 with a rule against the run time: valid + invalid = total."""
    base = scratch_path(spark, "run-time")
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("2999-01-01 00:00:00"))
                                          .otherwise(F.col("ts").cast("string")).cast("timestamp").alias("ts"))
    res = run_validation(e, [("ts", "timestamp", "not in the future"), ("ts", "timestamp", "sql: ts <= now()")],
                         f"{base}/valid", f"{base}/invalid")
    v, i = spark.read.parquet(f"{base}/valid"), spark.read.parquet(f"{base}/invalid")
    return v.agg(F.count("event_id").alias("valid")).crossJoin(i.agg(F.count("event_id").alias("invalid"))).withColumn(
        "total", F.lit(res.total).cast("long"))


def _written(spark, base):
    v = spark.read.parquet(f"{base}/valid")
    i = spark.read.parquet(f"{base}/invalid")
    flags = [c for c in i.columns if c not in v.columns]
    return (v.select(F.lit("valid").alias("split"), "*", *[F.lit(None).cast("boolean").alias(c) for c in flags])
            .unionByName(i.select(F.lit("invalid").alias("split"), "*")))


def q_run_validation_written(spark, sf):
    """All written columns of both outputs (valid rows have no check columns)."""
    base = scratch_path(spark, "run-written")
    run_validation(dirty(spark, sf), DIRTY_RULES, f"{base}/valid", f"{base}/invalid")
    return _written(spark, base)


def q_run_validation_staged(spark, sf):
    """The same for a source that two jobs might read differently (a shuffle is in it)."""
    base = scratch_path(spark, "run-staged")
    run_validation(dirty(spark, sf).repartition(5), DIRTY_RULES, f"{base}/valid", f"{base}/invalid")
    return _written(spark, base)


def q_run_no_rules(spark, sf):
    """Without a usable check every row is valid and the invalid output is empty."""
    base = scratch_path(spark, "run-none")
    run_validation(table(spark, sf, "orders"), [], f"{base}/valid", f"{base}/invalid")
    v, i = spark.read.parquet(f"{base}/valid"), spark.read.parquet(f"{base}/invalid")
    return v.withColumn("split", F.lit("valid")).unionByName(i.withColumn("split", F.lit("invalid")))


def q_run_validation_republished(spark, sf):
    """A6/A7 as a pair: a first run, a second one that takes its place, and the
    second's id once more with other rules, which changes nothing."""
    base = scratch_path(spark, "published")
    publish_validation(dirty(spark, sf), [("id", "bigint", "Not Null")], base, "day 1")
    publish_validation(dirty(spark, sf), DIRTY_RULES, base, "day 2")
    publish_validation(dirty(spark, sf), [], base, "day 2")
    last = published(spark, base)
    v, i = last.valid(spark), last.invalid(spark)
    flags = [c for c in i.columns if c not in v.columns]
    return (v.select(F.lit("valid").alias("split"), "*", *[F.lit(None).cast("boolean").alias(c) for c in flags])
            .unionByName(i.select(F.lit("invalid").alias("split"), "*")))


FREE_TEXTS = [("o_orderpriority", "string", "sounds urgent"), ("o_totalprice", "double", "worth a call"), ("o_orderstatus", "string", "sounds urgent"),
              ("o_totalprice", "double", "worth a call")]


def q_compiled_rules_cached(spark, sf):
    """Texts outside the grammar, translated once per key, read back by a
    second compilation that has no translator, and one of them overwritten."""
    path, asked = scratch_path(spark, "expressions"), []
    known = {"sounds urgent": "`{c}` RLIKE '^[12F]'", "worth a call": "`{c}` > 250000"}

    def translate(column, data_type, rule):
        asked.append(rule)
        return known[rule].format(c=column)
    o = table(spark, sf, "orders")
    compile_rules(FREE_TEXTS, o, translator=ExpressionCache(spark, path, translate), type_checks=False)
    compile_rules(FREE_TEXTS, o, translator=ExpressionCache(spark, path, translate), type_checks=False)
    changed = ExpressionCache(spark, path)
    changed.put("o_totalprice", "double", "worth a call", "`o_totalprice` > 400000")
    changed.flush()
    checks = compile_rules(FREE_TEXTS, o, translator=ExpressionCache(spark, path), type_checks=False)
    counts = failure_counts(apply_checks(o, checks), checks)
    rows = [F.struct(F.lit(c.index).alias("rule_index"), F.lit(c.expression).alias("expression"), F.lit(len(asked)).cast("long").alias("asked"),
                     c.column.cast("long").alias("failed_records")) for c in checks]
    return counts.select(F.inline(F.array(*rows)))


# --- reading and writing (A1-A5) ----------------------------------------------

def q_rules_csv_roundtrip(spark, sf):
    """A5 -> A1/A2: suggested rules and rules with commas, quotes and
    backslashes, written as CSV and read again."""
    path = scratch_path(spark, "rules-csv")
    extra = rules_frame(spark, [("a,b", "string", "one of ['x, y', 'O''B']"), ("c", "string", 'contains "q,"'),
                                ("d", "string", "must match pattern '^\\d+$'")])
    export_rules(suggest_rules(table(spark, sf, "orders")).unionByName(extra), path)
    return load_rules(spark, path)


def q_read_sample(spark, sf):
    """A3: orders as CSV, read with inferred types and null tokens."""
    path = scratch_path(spark, "sample-csv")
    (table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, "NA")
                                       .otherwise(F.col("o_orderstatus")).alias("status"))
     .write.csv(path, header=True))
    return read_sample(spark, path, null_tokens=["NA"]).select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), "status")


def q_load_table(spark, sf):
    """A4: a path in its own format, and a catalog name."""
    path = scratch_path(spark, "load-table") + ".orc"
    c = load_table(spark, f"{sf.rstrip('/')}/customer.parquet")
    c.write.orc(path)
    name = "rowgate_load_table"
    load_table(spark, path).createOrReplaceTempView(name)
    return load_table(spark, name)


# --- preparation (C1/C2) ----------------------------------------------------

def q_trim_strings(spark, sf):
    return trim_strings(dirty(spark, sf))


def q_strip_names(spark, sf):
    o = table(spark, sf, "orders")
    padded = o.toDF(*[f"  {c} " for c in o.columns])
    return strip_column_names(padded)


# --- profiling (D1-D7) and rule tables (B3/B4) ------------------------------

def _suggest(table_name):
    def q(spark, sf):
        return suggest_rules(table(spark, sf, table_name))
    q.__name__ = f"q_suggest_rules_{table_name}"
    return q


def q_profile_columns(spark, sf):
    p = profile_columns(table(spark, sf, "orders"))
    return p.select(*[c for c in p.columns if c != "values"], F.array_join("values", "|").alias("value_list"))


def q_profile_customer(spark, sf):
    p = profile_columns(table(spark, sf, "customer"))
    return p.select(*[c for c in p.columns if c != "values"], F.array_join("values", "|").alias("value_list"))


def q_rule_stats(spark, sf):
    rules = suggest_rules(table(spark, sf, "customer")).unionByName(suggest_rules(table(spark, sf, "orders")))
    return rule_stats(rules)


def q_compiled_rules(spark, sf):
    o = table(spark, sf, "orders")
    checks = compile_rules(suggest_rules(o), o)
    return compiled_rules(spark, checks)


def q_suggested_rules_recheck(spark, sf):
    """Round trip D7 -> F4: rules suggested from a table find no failures there."""
    o = table(spark, sf, "orders")
    checked, checks = checked_frame(o, suggest_rules(o))
    return split_counts(checked, checks)


def odd_values(spark, sf):
    """Customers with values that are hard to quote, NaN and leading zeros."""
    k = F.col("c_custkey")
    odd = ["a\\b", "O'B", "two  spaces", 'say "x"', "x, y", "ends\\"]
    pick = F.element_at(F.array(*[F.lit(v) for v in odd]), (F.pmod(k, F.lit(len(odd))) + 1).cast("int"))
    return table(spark, sf, "customer").select(
        k.alias("id"), pick.alias("odd"), F.concat(F.lit("0"), F.pmod(k, F.lit(3)).cast("string")).alias("code"),
        F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("balance"),
        F.when(k % 10 == 0, F.lit("no mail")).otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com"))).alias("mail"))


def q_suggest_rules_odd_values(spark, sf):
    """D4/D5 with values that need quoting, a column of 90 % emails, NaN as missing."""
    return suggest_rules(odd_values(spark, sf))


def q_recheck_tables(spark, sf):
    """Suggested rules find no failures, over five tables."""
    frames = {n: table(spark, sf, n) for n in ("customer", "part", "events", "documents")} | {"odd": odd_values(spark, sf).drop("mail")}
    out = None
    for name, df in frames.items():
        part = split_counts(*checked_frame(df, suggest_rules(df))).select(F.lit(name).alias("source"), "split", "records")
        out = part if out is None else out.unionByName(part)
    return out


# --- generation and review (G1-G7) ------------------------------------------

def q_sample_rows(spark, sf):
    c = table(spark, sf, "customer")
    return sample_rows(spark, suggest_rules(c), n=c.count())


def q_review_secrets(spark, sf):
    return secret_lines(table(spark, sf, "documents"), path="doc_id")


def _flat_evidence(report):
    return report.withColumn("evidence", F.array_join(F.transform(
        "evidence", lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), x["line"])), "\n"))


def q_review_sources(spark, sf):
    return _flat_evidence(review_sources(table(spark, sf, "documents"), path="doc_id"))


#: (modulus, remainder, lines) of the cells that are put in front of a document.
NOTEBOOK_CELLS = [
    (2, 0, "# MAGIC %md title\n# a comment\n"),
    (3, 0, "df = spark.read.parquet('/mnt/data/x')\n"),
    (5, 0, "try:\n    df.write.save(out)\nexcept Exception:\n    raise\n"),
    (7, 0, "rows = df.collect()\nmore = df.toPandas()\n"),
    (7, 1, "rows = df.limit(5).collect()\n"),
    (11, 0, "password = 'x1'\n"),
    (4, 1, "def load():\n    return spark.read.table('t')\ntry:\n    if x:\n\n# try:\n\ty = spark.read.table('u')\n"
           "except Exception:\n    y.write.save(out)\n"),
]


def q_review_notebooks(spark, sf):
    """Both verdicts of every standard: documents with notebook cells in front."""
    cells = [F.when(F.col("doc_id") % m == r, F.lit(t)).otherwise(F.lit("")) for m, r, t in NOTEBOOK_CELLS]
    files = table(spark, sf, "documents").select("doc_id", F.concat(*cells, "text").alias("text"))
    return _flat_evidence(review_sources(files, path="doc_id"))


def q_sample_rows_types(spark, sf):
    """G1 for every kind of type; as many rows as orders."""
    rules = [("mail_email", "string", "Should be a valid email address"), ("status", "string", "Not Null"), ("first_name", "string", "x"),
             ("other", "string", "x"), ("n", "int", "x"), ("big", "bigint", "x"), ("d", "double", "x"), ("day", "date", "x"),
             ("at", "timestamp", "x"), ("flag", "boolean", "x")]
    out = sample_rows(spark, rules_frame(spark, rules), n=table(spark, sf, "orders").count())
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")).withColumn("day", F.col("day").cast("string"))


def q_review_conversations(spark, sf):
    conv = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("path"), "text")
    return _flat_evidence(review_sources(conv))


# --- streaming extension -----------------------------------------------------

def q_stream_split_counts(spark, sf):
    from ..streaming.stream import validate_stream_files
    base = scratch_path(spark, "stream")
    rules = [("o_orderstatus", "string", "Should be one of ['F', 'O']"),
             ("o_totalprice", "double", "value must be greater than 1000")]
    src = f"{sf.rstrip('/')}/orders.parquet"
    validate_stream_files(spark, src, table(spark, sf, "orders").schema, rules,
                          f"{base}/valid", f"{base}/invalid", f"{base}/_checkpoint")
    v = spark.read.parquet(f"{base}/valid").select(F.lit("valid").alias("split"))
    i = spark.read.parquet(f"{base}/invalid").select(F.lit("invalid").alias("split"))
    return v.unionByName(i).groupBy("split").agg(F.count(F.lit(1)).alias("records"))


def q_stream_failure_summary(spark, sf):
    from ..streaming.stream import stream_failure_summary
    rules = [("o_orderstatus", "string", "Should be one of ['F', 'O']"),
             ("o_totalprice", "double", "value must be greater than 1000"),
             ("o_orderpriority", "string", "sql: o_orderpriority <> '5-LOW'")]
    src = f"{sf.rstrip('/')}/orders.parquet"
    return stream_failure_summary(spark, src, table(spark, sf, "orders").schema, rules)


def q_stream_failure_windows(spark, sf):
    """Failures per hour of event time: the older half of the events in one
    run of the stream, the newer half in a second one that goes on from the
    first one's checkpoint, and a third one without any new file."""
    from ..streaming.stream import failure_windows, read_failure_windows, read_file_stream
    base = scratch_path(spark, "windows")
    e = table(spark, sf, "events")
    rules = [("event_type", "string", "Should be one of ['click', 'view', 'purchase']"), ("value", "double", "between 0 and 400")]
    for condition in ("ts < TIMESTAMP_NTZ '2024-01-15 12:30:00'", "ts >= TIMESTAMP_NTZ '2024-01-15 12:30:00'", None):
        if condition:
            e.where(condition).write.mode("append").parquet(f"{base}/in")
        q = failure_windows(read_file_stream(spark, f"{base}/in", e.schema), rules, "ts", "1 hour", "2 days", f"{base}/out", f"{base}/checkpoint")
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return read_failure_windows(spark, f"{base}/out").drop("window_end").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def _three_parts(spark, sf, name, key):
    from ..operators.profile_state import add_part
    path, df = scratch_path(spark, "profile-state"), table(spark, sf, name)
    for i in (0, 1, 1, 2):  # the second part arrives twice
        add_part(df.where(F.pmod(F.col(key), F.lit(3)) == i), path, f"day-{i}")
    return path


def q_profile_merged(spark, sf):
    """D2-D5 from the merged states of three parts of ``lineitem``."""
    from ..operators.profile_state import merged_profile
    p = merged_profile(spark, _three_parts(spark, sf, "lineitem", "l_orderkey"))
    return p.select(*[c for c in p.columns if c != "values"], F.array_join("values", "|").alias("value_list"))


def q_suggest_rules_merged(spark, sf):
    """D7 from the merged states of three parts of ``customer``."""
    from ..operators.profile_state import merged_suggestions
    return merged_suggestions(spark, _three_parts(spark, sf, "customer", "c_custkey"))


QUERIES: dict[str, Query] = {
    "failure_summary": q_failure_summary,
    "validation_summary": q_validation_summary,
    "summary_documents": q_summary_documents,
    "checked_rows": q_checked_rows,
    "type_check": q_type_check,
    "rule_not_null": q_rule_not_null,
    "rule_in_list": q_rule_in_list,
    "rule_email": q_rule_email,
    "rule_compare": q_rule_compare,
    "rule_number": q_rule_number,
    "rule_compound": q_rule_compound,
    "rule_sql": q_rule_sql,
    "rule_text": q_rule_text,
    "rule_unique": q_rule_unique,
    "rule_documents": q_rule_documents,
    "rule_events": q_rule_events,
    "unique_orderkey": q_unique_orderkey,
    "unique_orderkey_salted": q_unique_orderkey_salted,
    "unique_custkey_orders": q_unique_custkey_orders,
    "unique_document_text": q_unique_document_text,
    "invalid_rows": q_invalid_rows,
    "split_valid": q_split_valid,
    "split_invalid": q_split_invalid,
    "split_counts": q_split_counts,
    "preview_invalid": q_preview_invalid,
    "run_validation": q_run_validation,
    "run_validation_single_pass": q_run_validation_single_pass,
    "run_validation_outputs": q_run_validation_outputs,
    "trim_strings": q_trim_strings,
    "strip_names": q_strip_names,
    "suggest_rules": _suggest("customer"),
    "suggest_rules_orders": _suggest("orders"),
    "suggest_rules_lineitem": _suggest("lineitem"),
    "suggest_rules_part": _suggest("part"),
    "suggest_rules_events": _suggest("events"),
    "profile_columns": q_profile_columns,
    "profile_customer": q_profile_customer,
    "rule_stats": q_rule_stats,
    "compiled_rules": q_compiled_rules,
    "suggested_rules_recheck": q_suggested_rules_recheck,
    "sample_rows": q_sample_rows,
    "review_secrets": q_review_secrets,
    "review_sources": q_review_sources,
    "review_conversations": q_review_conversations,
    "rule_compound_texts": q_rule_compound_texts,
    "compiled_rules_errors": q_compiled_rules_errors,
    "unique_two_columns": q_unique_two_columns,
    "run_validation_time_rule": q_run_validation_time_rule,
    "run_validation_written": q_run_validation_written,
    "run_validation_staged": q_run_validation_staged,
    "run_no_rules": q_run_no_rules,
    "rules_csv_roundtrip": q_rules_csv_roundtrip,
    "read_sample": q_read_sample,
    "load_table": q_load_table,
    "suggest_rules_documents": _suggest("documents"),
    "suggest_rules_odd_values": q_suggest_rules_odd_values,
    "recheck_tables": q_recheck_tables,
    "review_notebooks": q_review_notebooks,
    "sample_rows_types": q_sample_rows_types,
    "rule_cross_column": q_rule_cross_column,
    "rule_conditional": q_rule_conditional,
    "rule_exists": q_rule_exists,
    "rule_exists_shuffled": q_rule_exists_shuffled,
    "rule_wordings": q_rule_wordings,
    "checks_on_aggregated_source": q_checks_on_aggregated_source,
    "checks_on_exploded_source": q_checks_on_exploded_source,
    "checks_on_windowed_source": q_checks_on_windowed_source,
    "run_validation_aggregated": q_run_validation_aggregated,
    "run_validation_sql_time": q_run_validation_sql_time,
    "run_validation_republished": q_run_validation_republished,
    "compiled_rules_cached": q_compiled_rules_cached,
    "stream_failure_windows": q_stream_failure_windows,
    "profile_merged": q_profile_merged,
    "suggest_rules_merged": q_suggest_rules_merged,
    "stream_split_counts": q_stream_split_counts,
    "stream_failure_summary": q_stream_failure_summary,
}
