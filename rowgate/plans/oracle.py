"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code: plain SQL over the same parquet
tables. Engine differences are avoided, not papered over: casts only on
values both engines agree on, RE2-compatible regexes, explicit DOUBLE casts
so rates are computed with the same floating-point operations.
"""

from __future__ import annotations

import re

from ..functions.fixed import EMAIL_REGEX
from .fixtures import DIRTY_SQL


# The review's standards, restated here from their description: the oracle
# shares no pattern or text with the code it checks.
EXPLANATIONS = {
    "secrets": ("hard-coded secret at line {line}; read it with dbutils.secrets.get", "no hard-coded secret"),
    "parameters": ("literal storage path at line {line}; take it from dbutils.widgets.get", "no literal storage path"),
    "documentation": ("needs # MAGIC %md cells and # comments", "markdown cells and comments present"),
    "performance": ("collect/display/toPandas on a full frame at line {line}; add .limit(n)", "no unbounded collect or display"),
    "error_handling": ("read or write at line {line} outside try/except", "reads and writes are guarded"),
}
SECRET_NAMES = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "accesskey", "access_key"]
BLANK = r"[ \t\n\f\r]*"
SECRET_RE = "(?i)(" + "|".join(SECRET_NAMES) + ")" + BLANK + "[:=]" + BLANK + "['\"][^'\"]+"
LOCAL_ROOTS = ["dbfs", "mnt", "Volumes", "tmp", "data", "user", "home"]
STORES = ["dbfs:/", "s3://", "s3a://", "abfs://", "abfss://", "gs://", "wasb://", "wasbs://", "file:/"]
LITERAL_PATH_RE = "['\"](/(" + "|".join(LOCAL_ROOTS) + ")/|" + "|".join(STORES) + ")"
ACTIONS = [r"\.collect\(\)", r"(^|[^A-Za-z0-9_.])display\(", r"\.toPandas\(\)"]
LIMITS = [r"\.limit\(", r"\.take\(", r"\.head\("]
IO_CALLS = ["spark.read", ".write.", ".save(", ".saveAsTable(", "spark.table(", ".load(", ".insertInto("]


def rn(column: str, rule: str, i: int) -> str:
    """Check-column name of rule ``i`` (same naming contract as the checks)."""
    def san(t: str) -> str:
        return re.sub(r"[^a-zA-Z0-9_]", "_", t).lower()
    return f"{san(column)}_{san(rule)[:30]}_{i}_ok"


def s(text: str) -> str:
    """DuckDB string literal (backslashes are literal in DuckDB)."""
    return "'" + text.replace("'", "''") + "'"


DIRTY_TRIMMED = f"""
SELECT id, trim(email) AS email, trim(status) AS status, trim(age) AS age, trim(signup) AS signup,
       balance, trim(segment) AS segment
FROM ({DIRTY_SQL}) d0
"""

EMAIL_OK = f"regexp_matches(email, {s(EMAIL_REGEX)})"

# Checks of the dirty rule set, in check order (type checks, then rules).
DIRTY_CHECKS = [
    ("id_type_ok", "(id IS NULL) OR (TRY_CAST(id AS BIGINT) IS NOT NULL)"),
    ("email_type_ok", "(email IS NULL) OR (TRY_CAST(email AS VARCHAR) IS NOT NULL)"),
    ("status_type_ok", "(status IS NULL) OR (TRY_CAST(status AS VARCHAR) IS NOT NULL)"),
    ("age_type_ok", "(age IS NULL) OR (TRY_CAST(age AS INTEGER) IS NOT NULL)"),
    ("signup_type_ok", "(signup IS NULL) OR (TRY_CAST(signup AS DATE) IS NOT NULL)"),
    ("id_not_null_0_ok", "id IS NOT NULL"),
    ("email_should_be_a_valid_email_addres_1_ok", f"(email IS NULL) OR {EMAIL_OK}"),
    ("status_should_be_one_of___active____i_2_ok", "(status IS NULL) OR (status IN ('ACTIVE', 'INACTIVE'))"),
    ("age_value_must_be_greater_than_18_3_ok", "(age IS NULL) OR (TRY_CAST(age AS INTEGER) > 18)"),
    ("signup_not_null_4_ok", "signup IS NOT NULL"),
    ("id_must_be_unique_5_ok", "(id IS NULL) OR (COUNT(*) OVER (PARTITION BY id) = 1)"),
]
DIRTY_COLS = "id, email, status, age, signup, balance, segment"
CHECKED = f"SELECT {DIRTY_COLS}, " + ", ".join(f"{e} AS {n}" for n, e in DIRTY_CHECKS) + f" FROM ({DIRTY_TRIMMED}) p"
ANY_FALSE = " OR ".join(f"COALESCE({n} = false, false)" for n, _ in DIRTY_CHECKS)


def _summary(checked_sql: str, names: list[str]) -> str:
    counts = ", ".join(f"count_if({n} = false) AS {n}" for n in names)
    parts = [f"SELECT {s(n)} AS check_name, {i} AS ord, {n} AS failed, total FROM cnt" for i, n in enumerate(names)]
    return f"""
WITH c AS ({checked_sql}),
cnt AS (SELECT count(*) AS total, {counts} FROM c),
l AS ({' UNION ALL '.join(parts)})
SELECT check_name, CAST(failed AS BIGINT) AS failed_records,
       round(CAST(failed AS DOUBLE) / CAST(total AS DOUBLE) * 100, 2) AS failure_rate_pct
FROM l WHERE total > 0 AND failed > 0
"""


FAILURE_SUMMARY = _summary(CHECKED, [n for n, _ in DIRTY_CHECKS])

_DOC_CHECKS = [
    ("text_type_ok", "true"),
    ("lang_type_ok", "true"),
    (rn("text", "unique", 0), "(text IS NULL) OR (COUNT(*) OVER (PARTITION BY text) = 1)"),
    (rn("lang", "Should be one of ['de', 'en', 'fr']", 1), "(lang IS NULL) OR (lang IN ('de', 'en', 'fr'))"),
    (rn("text", "length at most 20000", 2), "(text IS NULL) OR (length(text) <= 20000)"),
]
SUMMARY_DOCUMENTS = _summary(
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _DOC_CHECKS)
    + " FROM (SELECT doc_id, trim(text) AS text, trim(lang) AS lang, trim(source) AS source, n_chars FROM documents) d",
    [n for n, _ in _DOC_CHECKS])

RAW_RULE_CHECKS = [  # validate(): no trim, no type checks
    ("id_not_null_0_ok", "id IS NOT NULL", "id", "Not Null"),
    ("email_should_be_a_valid_email_addres_1_ok", f"(email IS NULL) OR {EMAIL_OK}", "email",
     "Should be a valid email address"),
    ("status_should_be_one_of___active____i_2_ok", "(status IS NULL) OR (status IN ('ACTIVE', 'INACTIVE'))",
     "status", "Should be one of ['ACTIVE', 'INACTIVE']"),
    ("age_value_must_be_greater_than_18_3_ok", "(age IS NULL) OR (TRY_CAST(age AS INTEGER) > 18)", "age",
     "value must be greater than 18"),
    ("signup_not_null_4_ok", "signup IS NOT NULL", "signup", "Not Null"),
    ("id_must_be_unique_5_ok", "(id IS NULL) OR (COUNT(*) OVER (PARTITION BY id) = 1)", "id", "Must be unique"),
]
_msgs = ", ".join(
    f"CASE WHEN ({e}) = false THEN {s(f'FAILED RULE: For column {chr(39)}{c}{chr(39)}, rule was: {chr(39)}{r}{chr(39)}')} END"
    for _, e, c, r in RAW_RULE_CHECKS)
INVALID_ROWS = f"""
WITH e AS (SELECT {DIRTY_COLS}, list_filter([{_msgs}], lambda x: x IS NOT NULL) AS errs FROM ({DIRTY_SQL}) d)
SELECT {DIRTY_COLS}, array_to_string(errs, '|') AS validation_errors FROM e WHERE len(errs) > 0
"""


def _rules_sql(keep: str, rules: list[tuple[str, str, str]], source: str) -> str:
    # rules: (column, rule text, DuckDB expression), in rule order
    return (f"SELECT {keep}, " + ", ".join(f"{e} AS {rn(c, r, i)}" for i, (c, r, e) in enumerate(rules))
            + f" FROM {source}")


DT = f"({DIRTY_TRIMMED}) p"

# --------------------------------------------------------------------------- #
# profiling / suggestion oracles, generated from the table layouts

TABLES = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "events": [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
}


def _stats_ctes(table: str) -> tuple[str, list]:
    cols = TABLES[table]
    src = ", ".join(f"trim({c}) AS {c}" if t == "string" else c for c, t in cols)
    aggs = ["count(*) AS n"]
    for c, t in cols:
        aggs += [f"count({c}) AS nn_{c}", f"count(DISTINCT {c}) AS d_{c}"]
        if t == "string":
            aggs.append(f"count_if(regexp_matches({c}, {s(EMAIL_REGEX)})) AS em_{c}")
    ctes = [f"src AS (SELECT {src} FROM {table})", f"st AS (SELECT {', '.join(aggs)} FROM src)"]
    for c, t in cols:
        if t == "string":
            ctes.append(
                rf"v_{c} AS (SELECT string_agg('''' || replace(replace(v, '\', '\\'), '''', '''''') || '''', ', ' ORDER BY v) AS lst, "
                f"string_agg(v, '|' ORDER BY v) AS plain, "
                rf"string_agg('''' || replace(replace(v, '\', '\\'), '''', '\''') || '''', ', ' ORDER BY v) AS spark_lst "
                f"FROM (SELECT DISTINCT {c} AS v FROM src WHERE {c} IS NOT NULL) x)")
    return "WITH " + ",\n".join(ctes), cols


def suggest_sql(table: str) -> str:
    head, cols = _stats_ctes(table)
    parts = []
    for pos, (c, t) in enumerate(cols):
        parts.append(f"SELECT {s(c)} AS column_name, {s(t)} AS data_type, 'Not Null' AS rule FROM st WHERE n - nn_{c} = 0")
        parts.append(f"SELECT {s(c)}, {s(t)}, 'Must be unique' FROM st WHERE nn_{c} > 0 AND d_{c} = nn_{c}")
        if t == "string":
            parts.append(f"SELECT {s(c)}, {s(t)}, 'Should be one of [' || lst || ']' FROM st, v_{c} "
                         f"WHERE d_{c} BETWEEN 2 AND 10")
            parts.append(f"SELECT {s(c)}, {s(t)}, 'Should be a valid email address' FROM st "
                         f"WHERE nn_{c} > 0 AND CAST(em_{c} AS DOUBLE) / nn_{c} > 0.8")
    return head + "\n" + "\nUNION ALL ".join(parts)


def suggest_ordered_sql(table: str) -> str:
    """Suggestions with their row index (rule order)."""
    head, cols = _stats_ctes(table)
    parts = []
    for pos, (c, t) in enumerate(cols):
        parts.append(f"SELECT {pos} AS pos, 1 AS sub, {s(c)} AS column_name, {s(t)} AS data_type, 'Not Null' AS rule, "
                     f"NULL AS lst FROM st WHERE n - nn_{c} = 0")
        parts.append(f"SELECT {pos}, 2, {s(c)}, {s(t)}, 'Must be unique', NULL FROM st WHERE nn_{c} > 0 AND d_{c} = nn_{c}")
        if t == "string":
            parts.append(f"SELECT {pos}, 3, {s(c)}, {s(t)}, 'Should be one of [' || lst || ']', spark_lst FROM st, v_{c} "
                         f"WHERE d_{c} BETWEEN 2 AND 10")
            parts.append(f"SELECT {pos}, 4, {s(c)}, {s(t)}, 'Should be a valid email address', NULL FROM st "
                         f"WHERE nn_{c} > 0 AND CAST(em_{c} AS DOUBLE) / nn_{c} > 0.8")
    return head + ",\nsug AS (" + "\nUNION ALL ".join(parts) + \
        ")\nSELECT *, CAST(row_number() OVER (ORDER BY pos, sub) - 1 AS INTEGER) AS i FROM sug"


def profile_sql(table: str) -> str:
    head, cols = _stats_ctes(table)
    parts = []
    for pos, (c, t) in enumerate(cols):
        if t == "string":
            parts.append(
                f"SELECT {pos} AS column_position, {s(c)} AS column_name, {s(t)} AS data_type, n AS row_count, "
                f"n - nn_{c} AS null_count, (nn_{c} > 0 AND d_{c} = nn_{c}) AS is_unique, "
                f"CAST(CASE WHEN d_{c} <= 10 THEN d_{c} END AS INTEGER) AS small_distinct, "
                f"CASE WHEN nn_{c} > 0 THEN CAST(em_{c} AS DOUBLE) / nn_{c} END AS email_share, "
                f"CASE WHEN d_{c} BETWEEN 2 AND 10 THEN plain END AS value_list FROM st, v_{c}")
        else:
            parts.append(
                f"SELECT {pos} AS column_position, {s(c)} AS column_name, {s(t)} AS data_type, n AS row_count, "
                f"n - nn_{c} AS null_count, (nn_{c} > 0 AND d_{c} = nn_{c}) AS is_unique, "
                f"CAST(NULL AS INTEGER) AS small_distinct, CAST(NULL AS DOUBLE) AS email_share, "
                f"CAST(NULL AS VARCHAR) AS value_list FROM st")
    return head + "\n" + "\nUNION ALL ".join(parts)


def _sanitize_sql(expr: str) -> str:
    return f"lower(regexp_replace({expr}, '[^a-zA-Z0-9_]', '_', 'g'))"


def compiled_rules_sql(table: str) -> str:
    cols = TABLES[table]
    duck = {"bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "string": "STRING", "timestamp": "TIMESTAMP"}
    type_rows = " UNION ALL ".join(
        f"SELECT {pos} AS pos, {s(c)} AS column_name, {s(t)} AS data_type, "
        f"{s(f'(`{c}` IS NULL) OR (TRY_CAST(`{c}` AS {duck[t]}) IS NOT NULL)')} AS expression"
        for pos, (c, t) in enumerate(cols))
    rule_expr = (
        "CASE WHEN rule = 'Not Null' THEN '`' || column_name || '` IS NOT NULL' "
        "WHEN rule = 'Must be unique' THEN '(`' || column_name || '` IS NULL) OR (COUNT(*) OVER (PARTITION BY `' "
        "|| column_name || '`) = 1)' "
        "WHEN rule = 'Should be a valid email address' THEN '(`' || column_name || '` IS NULL) OR (`' || column_name "
        f"|| '` RLIKE ' || {s(chr(39) + EMAIL_REGEX.replace(chr(92), chr(92) * 2) + chr(39))} || ')' "
        "ELSE '(`' || column_name || '` IS NULL) OR (`' || column_name || '` IN (' || lst || '))' END")
    head = suggest_ordered_sql(table).replace(
        "\nSELECT *, CAST(row_number()", "\n, ordered AS (SELECT *, CAST(row_number()")
    return head + f"""),
types AS (SELECT t.* FROM ({type_rows}) t WHERE t.column_name IN (SELECT column_name FROM ordered)),
tc AS (SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS check_order,
              {_sanitize_sql('column_name')} || '_type_ok' AS check_name, 'type' AS kind, column_name, data_type,
              CAST(NULL AS VARCHAR) AS rule, expression, CAST(NULL AS VARCHAR) AS error FROM types),
rc AS (SELECT CAST((SELECT count(*) FROM tc) + i AS INTEGER) AS check_order,
              {_sanitize_sql('column_name')} || '_' || left({_sanitize_sql('rule')}, 30) || '_' || CAST(i AS VARCHAR) || '_ok'
              AS check_name,
              CASE WHEN rule = 'Must be unique' THEN 'unique' ELSE 'rule' END AS kind, column_name, data_type, rule,
              {rule_expr} AS expression, CAST(NULL AS VARCHAR) AS error FROM ordered)
SELECT * FROM tc UNION ALL SELECT * FROM rc
"""


def rule_stats_sql() -> str:
    return f"""
WITH r AS (SELECT * FROM ({suggest_sql('customer')}) a UNION ALL SELECT * FROM ({suggest_sql('orders')}) b)
SELECT data_type, count(*) AS rule_count FROM r GROUP BY ROLLUP (data_type)
"""


# --------------------------------------------------------------------------- #
# source review

LINES = """
SELECT {path} AS path, unnest(string_split({text}, chr(10))) AS line,
       CAST(unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS INTEGER) AS line_no
FROM {source}
"""


def _explain(standard: str, fail_sql: str, line_sql: str) -> str:
    fail_text, pass_text = EXPLANATIONS[standard]
    head, _, tail = fail_text.partition("{line}")
    fail_expr = (f"{s(head)} || coalesce(CAST({line_sql} AS VARCHAR), '?') || {s(tail)}"
                 if "{line}" in fail_text else s(fail_text))
    return f"CASE WHEN {fail_sql} THEN {fail_expr} ELSE {s(pass_text)} END"


def review_sql(path: str, text: str, source: str) -> str:
    lines = LINES.format(path=path, text=text, source=source)
    io = "(" + " OR ".join(f"contains(line, {s(c)})" for c in IO_CALLS) + ")"
    hit = lambda patterns: "(" + " OR ".join(f"regexp_matches(line, {s(p)})" for p in patterns) + ")"
    stripped = "ltrim(line, ' ' || chr(9) || chr(10) || chr(12) || chr(13))"
    flags = {
        "secret": hit([SECRET_RE]),
        "literal_path": hit([LITERAL_PATH_RE]),
        "markdown": f"starts_with({stripped}, '# MAGIC %md')",
        "comment": f"(starts_with({stripped}, '#') AND NOT starts_with({stripped}, '# MAGIC') AND NOT starts_with({stripped}, "
                   f"'# COMMAND') AND NOT starts_with({stripped}, '# Databricks notebook source'))",
        "full_action": f"({hit(ACTIONS)} AND NOT {hit(LIMITS)})",
    }
    # a line is guarded when some try line above it has less indentation than every line of code from there on
    lead = "regexp_extract(line, '^[ \\t]*')"
    code = (f"SELECT path, line_no, line, length({lead}) + 7 * (length({lead}) - length(replace({lead}, chr(9), ''))) AS d, {io} AS is_io, "
            f"regexp_matches(line, {s('^' + BLANK + 'try' + BLANK + ':')}) AS is_try FROM l WHERE {stripped} <> '' AND NOT starts_with({stripped}, '#')")
    fl = ", ".join(f"{e} AS f_{k}" for k, e in flags.items())
    aggs = ", ".join(
        f"count_if(f_{k}) AS n_{k}, min(line_no) FILTER (WHERE f_{k}) AS l_{k}, "
        f"coalesce(string_agg(line_no || ':' || line, chr(10) ORDER BY line_no) FILTER (WHERE f_{k}), '') AS e_{k}" for k in [*flags, "unguarded_io"])
    return f"""
WITH l AS MATERIALIZED ({lines}), c AS MATERIALIZED ({code}),
p AS (SELECT i.path, i.line_no, t.line_no AS try_no, t.d FROM c AS i JOIN c AS t ON i.is_io AND NOT i.is_try AND t.is_try
      AND t.path = i.path AND t.line_no < i.line_no),
g AS MATERIALIZED (SELECT p.path, p.line_no FROM p JOIN c ON c.path = p.path AND c.line_no > p.try_no AND c.line_no <= p.line_no
      GROUP BY p.path, p.line_no, p.try_no, p.d HAVING min(c.d) > p.d),
u AS MATERIALIZED (SELECT path, line_no FROM c WHERE is_io AND NOT is_try EXCEPT SELECT path, line_no FROM g),
f AS (SELECT l.path, l.line_no, line, {fl}, u.line_no IS NOT NULL AS f_unguarded_io FROM l LEFT JOIN u ON u.path = l.path AND u.line_no = l.line_no),
io AS (SELECT path, {aggs} FROM f GROUP BY path)
SELECT path, 'secrets' AS standard, CASE WHEN n_secret > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict,
       n_secret AS hits, l_secret AS first_line, e_secret AS evidence,
       {_explain("secrets", "n_secret > 0", "l_secret")} AS explanation FROM io
UNION ALL SELECT path, 'parameters', CASE WHEN n_literal_path > 0 THEN 'FAIL' ELSE 'PASS' END,
       n_literal_path, l_literal_path, e_literal_path,
       {_explain("parameters", "n_literal_path > 0", "l_literal_path")} FROM io
UNION ALL SELECT path, 'documentation', CASE WHEN n_markdown > 0 AND n_comment > 0 THEN 'PASS' ELSE 'FAIL' END,
       n_markdown + n_comment, NULL, '',
       {_explain("documentation", "NOT (n_markdown > 0 AND n_comment > 0)", "NULL")} FROM io
UNION ALL SELECT path, 'performance', CASE WHEN n_full_action > 0 THEN 'FAIL' ELSE 'PASS' END,
       n_full_action, l_full_action, e_full_action,
       {_explain("performance", "n_full_action > 0", "l_full_action")} FROM io
UNION ALL SELECT path, 'error_handling', CASE WHEN n_unguarded_io > 0 THEN 'FAIL' ELSE 'PASS' END,
       n_unguarded_io, l_unguarded_io, e_unguarded_io,
       {_explain("error_handling", "n_unguarded_io > 0", "l_unguarded_io")} FROM io
"""


def secrets_sql() -> str:
    lines = LINES.format(path="doc_id", text="text", source="documents")
    return f"SELECT path, line_no, line FROM ({lines}) l WHERE regexp_matches(line, {s(SECRET_RE)})"


# --------------------------------------------------------------------------- #
# rules over other columns, conditions, other tables, any source

def _r(keep: str, checks: list[str], source: str) -> str:
    return f"SELECT {keep}, " + ", ".join(f"({c}) AS r{i}" for i, c in enumerate(checks)) + f" FROM {source}"


RECEIVED = """(SELECT *, CASE WHEN l_partkey % 11 <> 0 THEN l_shipdate + to_days(CAST(l_linenumber * 5 - 10 AS INTEGER)) END AS l_receiptdate
               FROM lineitem) l"""
CROSS_COLUMN = _r("l_orderkey, l_linenumber, l_partkey", [
    "l_receiptdate IS NULL OR l_receiptdate > l_shipdate",
    "l_receiptdate IS NULL OR (l_receiptdate >= l_shipdate AND l_receiptdate <= l_shipdate + INTERVAL 10 DAY)",
    "l_receiptdate IS NOT NULL AND l_receiptdate >= l_shipdate + INTERVAL 3 DAY",
    "l_receiptdate IS NULL OR CAST(l_receiptdate AS DATE) >= CAST(l_shipdate AS DATE)",
    "l_extendedprice > l_quantity * 1500", "l_discount <= l_tax", "l_tax >= l_discount AND l_tax <= 0.06",
    "l_discount <= 50 * l_tax / 100", "l_suppkey <> l_partkey", "l_quantity >= l_linenumber AND l_discount >= 0"], RECEIVED)
NOTED = """(SELECT *, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 <> 0 THEN 'x' WHEN o_orderkey % 7 = 0 THEN 'y' END AS note FROM orders) o"""
CONDITIONAL = _r("o_orderkey, note", [
    "o_orderstatus IS DISTINCT FROM 'F' OR o_totalprice > 100000",
    "NOT (o_totalprice > 200000 AND o_orderstatus <> 'P') OR o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "NOT (o_orderstatus = 'P' OR o_orderpriority LIKE '1%') OR note IS NOT NULL",
    "o_orderstatus = 'P' OR note IS NULL",
    "CASE WHEN note IS NULL THEN o_totalprice >= 50000 ELSE o_totalprice <= 300000 END",
    "note IS DISTINCT FROM 'y' OR o_totalprice < 250000",
    "CASE WHEN note <> 'x' THEN o_totalprice > 0 WHEN note = 'x' THEN o_totalprice > 100000 ELSE true END"], NOTED)
LINKED = """(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN -o_orderkey
                  WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders) o"""
_KNOWN = "o_custkey IN (SELECT c_custkey FROM customer)"
EXISTS = _r("o_orderkey, o_custkey", [
    f"o_custkey IS NULL OR {_KNOWN}", f"o_custkey IS NOT NULL AND {_KNOWN}", f"o_orderstatus <> 'F' OR o_custkey IS NULL OR {_KNOWN}",
    "o_orderkey NOT IN (SELECT n_nationkey FROM nation)"], LINKED)
WORDINGS = _r("p_partkey", [
    "p_type IN ('ECONOMY', 'STANDARD', 'PROMO')", "p_type IN ('ECONOMY', 'LARGE')", "NOT regexp_matches(p_name, '[^A-Za-z0-9 ]')",
    "NOT contains(p_name, ' ')", "regexp_full_match(p_brand, '[A-Za-z0-9]*')", "regexp_matches(p_brand, '[0-9]$')", "p_type <> 'PROMO'",
    "p_name LIKE 'red%' OR p_name LIKE '%g%'"], "part")
PER_ORDER = "(SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS lines, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) l"


# --------------------------------------------------------------------------- #

ORACLE: dict[str, str] = {
    "rule_cross_column": CROSS_COLUMN,
    "rule_conditional": CONDITIONAL,
    "rule_exists": EXISTS,
    "rule_exists_shuffled": "SELECT *, part IN (SELECT p_partkey FROM part) AS known FROM (SELECT l_orderkey, l_linenumber, CASE "
                            "WHEN l_linenumber = 3 THEN -7 WHEN l_orderkey % 4 = 0 THEN l_partkey + 1000000000 ELSE l_partkey END AS part FROM lineitem) l",
    "rule_wordings": WORDINGS,
    "checks_on_aggregated_source": _r("l_orderkey, lines", ["quantity BETWEEN 10 AND 150", "lines <= 6", "quantity >= lines * 20", "true",
                                                            "last_ship > TIMESTAMP '1995-06-01'"], PER_ORDER),
    "checks_on_exploded_source": _r("o_orderkey, pos", ["pos <> 0 OR regexp_matches(part, '^[1-3]$')", "length(part) <= 6", "false"],
                                    "(SELECT o_orderkey, unnest(range(0, len(ps))) AS pos, unnest(ps) AS part "
                                    "FROM (SELECT o_orderkey, string_split(o_orderpriority, '-') AS ps FROM orders)) o"),
    "checks_on_windowed_source": _r("s_suppkey, place", ["place <= 50", "true", "s_acctbal > 0 OR place > 10"],
                                    "(SELECT s_suppkey, s_acctbal, CAST(rank() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS place FROM supplier) s"),
    "run_validation_aggregated": "SELECT CASE WHEN count(*) <= 4 THEN 'valid' ELSE 'invalid' END AS split, l_orderkey, count(*) AS lines "
                                 "FROM lineitem GROUP BY l_orderkey",
    "run_validation_sql_time": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS copies, "
                               "(SELECT count(*) FROM lineitem) AS total FROM lineitem GROUP BY ALL",
    "failure_summary": FAILURE_SUMMARY,
    "run_validation": FAILURE_SUMMARY,
    "validation_summary": FAILURE_SUMMARY,
    "summary_documents": SUMMARY_DOCUMENTS,
    "run_validation_single_pass": FAILURE_SUMMARY,
    "checked_rows": CHECKED,
    "type_check": f"SELECT {DIRTY_COLS}, " + ", ".join(f"{e} AS {n}" for n, e in DIRTY_CHECKS[:5]) + f" FROM {DT}",
    "rule_not_null": _rules_sql("id, email, age", [
        ("id", "Not Null", "id IS NOT NULL"),
        ("email", "must not be null", "email IS NOT NULL"),
        ("age", "required", "age IS NOT NULL")], DT),
    "rule_in_list": _rules_sql("id, status, segment", [
        ("status", "Should be one of ['ACTIVE', 'INACTIVE']",
         "(status IS NULL) OR (status IN ('ACTIVE', 'INACTIVE'))"),
        ("segment", "must be one of ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY']",
         "(segment IS NULL) OR (segment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY'))")], DT),
    "rule_email": _rules_sql("id, email", [
        ("email", "Should be a valid email address", f"(email IS NULL) OR {EMAIL_OK}")], DT),
    "rule_compare": _rules_sql("l_orderkey, l_linenumber", [
        ("l_quantity", "between 1 and 40", "(l_quantity IS NULL) OR (l_quantity BETWEEN 1 AND 40)"),
        ("l_discount", "at most 0.05", "(l_discount IS NULL) OR (l_discount <= 0.05)"),
        ("l_tax", "greater than or equal to 0.02", "(l_tax IS NULL) OR (l_tax >= 0.02)"),
        ("l_extendedprice", "value must be greater than 20000",
         "(l_extendedprice IS NULL) OR (l_extendedprice > 20000)"),
        ("l_linenumber", "< 7", "(l_linenumber IS NULL) OR (l_linenumber < 7)")], "lineitem"),
    "rule_number": _rules_sql("id, age, balance, signup", [
        ("age", "Must be a number", "(age IS NULL) OR (TRY_CAST(age AS DOUBLE) IS NOT NULL)"),
        ("balance", "Must be a number", "true"),
        ("signup", "should be numeric", "(signup IS NULL) OR (TRY_CAST(signup AS DOUBLE) IS NOT NULL)")], DT),
    "rule_compound": _rules_sql("id, age, balance", [
        ("id", "Should be a number and not null", "id IS NOT NULL"),
        ("age", "must be at least 10 and at most 60",
         "((age IS NULL) OR (TRY_CAST(age AS INTEGER) >= 10)) AND ((age IS NULL) OR (TRY_CAST(age AS INTEGER) <= 60))"),
        ("balance", "must be not null and between 0 and 5000",
         "(balance IS NOT NULL) AND ((balance IS NULL) OR (balance BETWEEN 0 AND 5000))")], DT),
    "rule_sql": _rules_sql("o_orderkey", [
        ("o_totalprice", "sql: o_totalprice > 1000 AND o_orderstatus IN ('F', 'O')",
         "o_totalprice > 1000 AND o_orderstatus IN ('F', 'O')"),
        ("o_orderpriority", "sql: length(o_orderpriority) > 5 OR o_orderpriority LIKE '1%'",
         "length(o_orderpriority) > 5 OR o_orderpriority LIKE '1%'")], "orders"),
    "rule_text": _rules_sql("p_partkey", [
        ("p_name", "length at most 30", "(p_name IS NULL) OR (length(p_name) <= 30)"),
        ("p_brand", "must match pattern '^Brand#[1-3][0-9]$'",
         "(p_brand IS NULL) OR regexp_matches(p_brand, '^Brand#[1-3][0-9]$')"),
        ("p_type", "starts with 'STANDARD'", "(p_type IS NULL) OR starts_with(p_type, 'STANDARD')"),
        ("p_size", "positive", "(p_size IS NULL) OR (p_size > 0)"),
        ("p_retailprice", "in range 950 to 1800", "(p_retailprice IS NULL) OR (p_retailprice BETWEEN 950 AND 1800)"),
        ("p_name", "not empty", "(p_name IS NULL) OR (trim(p_name) <> '')")], "part"),
    "rule_documents": _rules_sql("doc_id", [
        ("text", "sql: length(text) = n_chars", "length(text) = n_chars"),
        ("text", "length at most 20000", "(text IS NULL) OR (length(text) <= 20000)"),
        ("lang", "Should be one of ['de', 'en', 'fr']", "(lang IS NULL) OR (lang IN ('de', 'en', 'fr'))"),
        ("text", "sql: NOT (text RLIKE '[0-9]{3}-[0-9]{4}')", "NOT regexp_matches(text, '[0-9]{3}-[0-9]{4}')"),
        ("doc_id", "Must be unique", "(doc_id IS NULL) OR (COUNT(*) OVER (PARTITION BY doc_id) = 1)"),
        ("doc_id", "unique", "(doc_id IS NULL) OR (COUNT(*) OVER (PARTITION BY doc_id) = 1)")], "documents"),
    "rule_events": _rules_sql("event_id", [
        ("props", "sql: get_json_object(props, '$.k') IS NOT NULL", "json_extract(props, '$.k') IS NOT NULL"),
        ("props", "sql: CAST(get_json_object(props, '$.k') AS INT) BETWEEN 0 AND 50",
         "CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 0 AND 50"),
        ("event_type", "Should be one of ['click', 'view', 'purchase']",
         "(event_type IS NULL) OR (event_type IN ('click', 'view', 'purchase'))"),
        ("value", "between 0 and 400", "(value IS NULL) OR (value BETWEEN 0 AND 400)"),
        ("ts", "after '2024-01-15'", "(ts IS NULL) OR (ts > TIMESTAMP '2024-01-15')"),
        ("event_id", "Must be unique", "(event_id IS NULL) OR (COUNT(*) OVER (PARTITION BY event_id) = 1)")],
        "events"),
    "rule_unique": _rules_sql("id, email", [
        ("id", "Must be unique", "(id IS NULL) OR (COUNT(*) OVER (PARTITION BY id) = 1)")], DT),
    "unique_orderkey": "SELECT l_orderkey, l_linenumber, (l_orderkey IS NULL) OR "
                       "(COUNT(*) OVER (PARTITION BY l_orderkey) = 1) AS l_orderkey_unique FROM lineitem",
    "unique_orderkey_salted": "SELECT l_orderkey, l_linenumber, (l_orderkey IS NULL) OR "
                              "(COUNT(*) OVER (PARTITION BY l_orderkey) = 1) AS l_orderkey_unique FROM lineitem",
    "unique_custkey_orders": "SELECT o_orderkey, o_custkey, (o_custkey IS NULL) OR "
                             "(COUNT(*) OVER (PARTITION BY o_custkey) = 1) AS o_custkey_unique FROM orders",
    "unique_document_text": "SELECT doc_id, (text IS NULL) OR (COUNT(*) OVER (PARTITION BY text) = 1) AS text_unique "
                            "FROM documents",
    "invalid_rows": INVALID_ROWS,
    "split_valid": f"SELECT {DIRTY_COLS} FROM ({CHECKED}) c WHERE NOT ({ANY_FALSE})",
    "split_invalid": f"SELECT * FROM ({CHECKED}) c WHERE {ANY_FALSE}",
    "preview_invalid": f"SELECT * FROM ({CHECKED}) c WHERE {ANY_FALSE} ORDER BY id ASC NULLS LAST, "
                       "email ASC NULLS LAST, status ASC NULLS LAST, age ASC NULLS LAST, signup ASC NULLS LAST, "
                       "balance ASC NULLS LAST, segment ASC NULLS LAST LIMIT 10",
    "split_counts": f"SELECT CASE WHEN {ANY_FALSE} THEN 'invalid' ELSE 'valid' END AS split, count(*) AS records "
                    f"FROM ({CHECKED}) c GROUP BY 1",
    "run_validation_outputs": f"SELECT CASE WHEN {ANY_FALSE} THEN 'invalid' ELSE 'valid' END AS split, "
                              f"count(*) AS records, count(id) AS ids FROM ({CHECKED}) c GROUP BY 1",
    "trim_strings": f"SELECT * FROM ({DIRTY_TRIMMED}) t",
    "strip_names": "SELECT * FROM orders",
    "suggest_rules": suggest_sql("customer"),
    "suggest_rules_orders": suggest_sql("orders"),
    "suggest_rules_lineitem": suggest_sql("lineitem"),
    "suggest_rules_part": suggest_sql("part"),
    "suggest_rules_events": suggest_sql("events"),
    "profile_columns": profile_sql("orders"),
    "profile_customer": profile_sql("customer"),
    "rule_stats": rule_stats_sql(),
    "compiled_rules": compiled_rules_sql("orders"),
    "suggested_rules_recheck": "SELECT 'valid' AS split, count(*) AS records FROM orders",
    "sample_rows": """
SELECT CAST((i + 1) * 10 AS BIGINT) AS c_custkey, 'FirstName' || CAST(i AS VARCHAR) AS c_name,
       CAST((i + 1) * 10 AS INTEGER) AS c_nationkey, CAST(i + 1 AS DOUBLE) * CAST(1.1 AS DOUBLE) AS c_acctbal,
       'value_' || CAST(i AS VARCHAR) AS c_mktsegment
FROM range((SELECT count(*) FROM customer)) t(i)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL
""",
    "review_secrets": secrets_sql(),
    "review_sources": review_sql("doc_id", "text", "documents"),
    "review_conversations": review_sql("conv_id * 1000 + turn", "text", "conversations"),
    "stream_failure_summary": _summary(
        "SELECT (o_orderstatus IS NULL) OR (o_orderstatus IN ('F', 'O')) AS "
        + rn("o_orderstatus", "Should be one of ['F', 'O']", 0)
        + ", (o_totalprice IS NULL) OR (o_totalprice > 1000) AS "
        + rn("o_totalprice", "value must be greater than 1000", 1)
        + ", o_orderpriority <> '5-LOW' AS " + rn("o_orderpriority", "sql: o_orderpriority <> '5-LOW'", 2)
        + " FROM (SELECT trim(o_orderstatus) AS o_orderstatus, o_totalprice, trim(o_orderpriority) AS o_orderpriority"
        " FROM orders) o",
        [rn("o_orderstatus", "Should be one of ['F', 'O']", 0),
         rn("o_totalprice", "value must be greater than 1000", 1),
         rn("o_orderpriority", "sql: o_orderpriority <> '5-LOW'", 2)]),
    "stream_split_counts": """
SELECT CASE WHEN COALESCE(NOT (o_orderstatus IN ('F', 'O')), false) OR COALESCE(NOT (o_totalprice > 1000), false)
            THEN 'invalid' ELSE 'valid' END AS split, count(*) AS records
FROM (SELECT trim(o_orderstatus) AS o_orderstatus, o_totalprice FROM orders) o GROUP BY 1
""",
}

# --------------------------------------------------------------------------- #
# compound rules, end-to-end outputs, round trips

_EMAIL = f"regexp_matches(email, {s(EMAIL_REGEX)})"
_UNIQ = "(id IS NULL OR count(*) OVER (PARTITION BY id) = 1)"
_ST = "status IN ('ACTIVE', 'INACTIVE')"
COMPOUND = [
    f"(email IS NULL OR {_EMAIL}) AND email IS NOT NULL",
    f"email IS NOT NULL AND (email IS NULL OR {_EMAIL})",
    f"email IS NULL OR NOT {_EMAIL}",
    "(email IS NULL OR NOT contains(email, 'user1')) AND email IS NOT NULL",
    "(email IS NULL OR starts_with(email, 'user')) AND email IS NOT NULL",
    f"email IS NULL OR {_EMAIL}",
    f"{_UNIQ} AND id IS NOT NULL",
    f"id IS NULL OR id > 1000 OR {_UNIQ}",
    f"(status IS NULL OR {_ST}) AND status IS NOT NULL",
    "(status IS NULL OR status IN ('ACTIVE', 'PENDING')) AND status IS NOT NULL",
    "(status IS NULL OR status = 'ACTIVE') AND (status IS NULL OR status = 'PENDING')",
    "status IS NULL OR status <> 'PENDING'",
    "status IS NULL OR length(status) = 6",
    "status IS NOT NULL AND (status IS NULL OR trim(status) <> '')",
    "age IS NULL OR coalesce(TRY_CAST(age AS DOUBLE) = floor(TRY_CAST(age AS DOUBLE)), false)",
    "age IS NULL OR TRY_CAST(age AS INTEGER) > 50",
    "balance IS NULL OR NOT balance < 0",
]

WRITTEN = (
    f"SELECT 'valid' AS split, {DIRTY_COLS}, " + ", ".join(f"CAST(NULL AS BOOLEAN) AS {n}" for n, _ in DIRTY_CHECKS)
    + f" FROM ({CHECKED}) c WHERE NOT ({ANY_FALSE}) UNION ALL SELECT 'invalid', {DIRTY_COLS}, "
    + ", ".join(n for n, _ in DIRTY_CHECKS) + f" FROM ({CHECKED}) c WHERE {ANY_FALSE}")

SUGGEST_ODD = r"""
SELECT * FROM (VALUES
  ('id', 'bigint', 'Not Null'), ('id', 'bigint', 'Must be unique'),
  ('odd', 'string', 'Not Null'),
  ('odd', 'string', 'Should be one of [''O''''B'', ''a\\b'', ''ends\\'', ''say "x"'', ''two  spaces'', ''x, y'']'),
  ('code', 'string', 'Not Null'), ('code', 'string', 'Should be one of [''00'', ''01'', ''02'']'),
  ('mail', 'string', 'Not Null'), ('mail', 'string', 'Should be a valid email address')) t(column_name, data_type, rule)
UNION ALL
SELECT 'balance', 'double', 'Must be unique' FROM customer
HAVING count(DISTINCT CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END) = count(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END)
"""

NOTEBOOKS = """
(SELECT doc_id,
   CASE WHEN doc_id % 2 = 0 THEN '# MAGIC %md title' || chr(10) || '# a comment' || chr(10) ELSE '' END
   || CASE WHEN doc_id % 3 = 0 THEN 'df = spark.read.parquet(''/mnt/data/x'')' || chr(10) ELSE '' END
   || CASE WHEN doc_id % 5 = 0 THEN 'try:' || chr(10) || '    df.write.save(out)' || chr(10) || 'except Exception:' || chr(10)
           || '    raise' || chr(10) ELSE '' END
   || CASE WHEN doc_id % 7 = 0 THEN 'rows = df.collect()' || chr(10) || 'more = df.toPandas()' || chr(10) ELSE '' END
   || CASE WHEN doc_id % 7 = 1 THEN 'rows = df.limit(5).collect()' || chr(10) ELSE '' END
   || CASE WHEN doc_id % 11 = 0 THEN 'password = ''x1''' || chr(10) ELSE '' END
   || CASE WHEN doc_id % 4 = 1 THEN 'def load():' || chr(10) || '    return spark.read.table(''t'')' || chr(10) || 'try:' || chr(10)
           || '    if x:' || chr(10) || chr(10) || '# try:' || chr(10) || chr(9) || 'y = spark.read.table(''u'')' || chr(10)
           || 'except Exception:' || chr(10) || '    y.write.save(out)' || chr(10) ELSE '' END || text AS text FROM documents)
"""

ORACLE |= {
    "rule_compound_texts": "SELECT id, email, status, age, balance, " + ", ".join(
        f"{e} AS r{i}" for i, e in enumerate(COMPOUND)) + f" FROM {DT}",
    "compiled_rules_errors": """
SELECT CAST(i AS INTEGER) AS rule_index, i NOT IN (0, 10, 11) AS refused,
       CASE i WHEN 0 THEN (SELECT count(*) FROM orders WHERE o_orderkey IN
                           (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1))
              WHEN 10 THEN (SELECT count(*) FROM orders WHERE o_totalprice <= 100000)
              WHEN 11 THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') END AS failed_records
FROM range(12) t(i)
""",
    "unique_two_columns": "SELECT o_orderkey, o_custkey, o_orderkey IS NULL OR count(*) OVER (PARTITION BY o_orderkey) = 1 "
                          "AS key_unique, o_custkey IS NULL OR count(*) OVER (PARTITION BY o_custkey) = 1 AS cust_unique FROM orders",
    "run_validation_time_rule": "SELECT count_if(event_id % 3 <> 0) AS valid, count_if(event_id % 3 = 0) AS invalid, "
                                "count(*) AS total FROM events",
    "run_validation_written": WRITTEN,
    "run_validation_staged": WRITTEN,
    "run_no_rules": "SELECT *, 'valid' AS split FROM orders",
    "rules_csv_roundtrip": f"SELECT * FROM ({suggest_sql('orders')}) r UNION ALL " + r"""
SELECT * FROM (VALUES ('a,b', 'string', 'one of [''x, y'', ''O''''B'']'), ('c', 'string', 'contains "q,"'),
                      ('d', 'string', 'must match pattern ''^\d+$''')) t""",
    "read_sample": "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status "
                   "FROM orders",
    "load_table": "SELECT * FROM customer",
    "suggest_rules_documents": suggest_sql("documents"),
    "suggest_rules_odd_values": SUGGEST_ODD,
    "recheck_tables": " UNION ALL ".join(f"SELECT '{n}' AS source, 'valid' AS split, count(*) AS records FROM {t}" for n, t in (
        ("customer", "customer"), ("part", "part"), ("events", "events"), ("documents", "documents"), ("odd", "customer"))),
    "review_notebooks": review_sql("doc_id", "text", NOTEBOOKS),
    "sample_rows_types": """
SELECT CASE WHEN i > 0 THEN 'user' || i || '@example.com' ELSE 'invalid-email' END AS mail_email,
       CASE WHEN i % 2 = 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, 'FirstName' || i AS first_name, 'value_' || i AS other,
       CAST((i + 1) * 10 AS INTEGER) AS n, CAST((i + 1) * 10 AS BIGINT) AS big, CAST(i + 1 AS DOUBLE) * CAST(1.1 AS DOUBLE) AS d,
       CAST(DATE '2024-01-01' + CAST(i % 28 AS INTEGER) AS VARCHAR) AS day,
       CAST(DATE '2024-01-01' + CAST(i % 28 AS INTEGER) AS VARCHAR) || ' 12:00:00' AS at, i % 2 = 0 AS flag
FROM range((SELECT count(*) FROM orders)) t(i)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
""",
}

# Sanity: every oracle is plain text without Python formatting leftovers.
assert all("{" not in re.sub(r"\{\d+,?\d*\}", "", q) for q in ORACLE.values())

ORACLE |= {
    "run_validation_republished": ORACLE["run_validation_written"],
    "compiled_rules_cached": """
SELECT CAST(i AS INTEGER) AS rule_index, e AS expression, CAST(3 AS BIGINT) AS asked,
       CASE i WHEN 0 THEN (SELECT count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[12F]'))
              WHEN 2 THEN (SELECT count(*) FROM orders WHERE NOT regexp_matches(o_orderstatus, '^[12F]'))
              ELSE (SELECT count(*) FROM orders WHERE NOT o_totalprice > 400000) END AS failed_records
FROM (VALUES (0, '`o_orderpriority` RLIKE ''^[12F]'''), (1, '`o_totalprice` > 400000'), (2, '`o_orderstatus` RLIKE ''^[12F]'''),
             (3, '`o_totalprice` > 400000')) t(i, e)
""",
}

ORACLE |= {
    "profile_merged": profile_sql("lineitem"),
    "suggest_rules_merged": suggest_sql("customer"),
    "stream_failure_windows": """
WITH w AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS total_records,
                  count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS f0, count(*) FILTER (NOT value BETWEEN 0 AND 400) AS f1
           FROM events GROUP BY 1),
l AS (SELECT window_start, total_records, {0} AS check_name, f0 AS failed_records FROM w WHERE f0 > 0
      UNION ALL SELECT window_start, total_records, {1}, f1 FROM w WHERE f1 > 0
      UNION ALL SELECT window_start, total_records, NULL, 0 FROM w WHERE f0 = 0 AND f1 = 0)
SELECT *, round(CAST(failed_records AS DOUBLE) / CAST(total_records AS DOUBLE) * 100, 2) AS failure_rate_pct FROM l
""".format(s(rn("event_type", "Should be one of ['click', 'view', 'purchase']", 0)), s(rn("value", "between 0 and 400", 1))),
}
