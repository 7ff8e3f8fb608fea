"""Compile rule rows into checks (B1-B3, B5) and apply them.

A ``Check`` is one boolean column: ``true`` passes, ``false`` fails, NULL is
"not applicable" and never counts as a failure. Type checks come first (one
per distinct column/type pair), then business rules in rule order.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.fixed import (
    NAME_SANITIZE_PATTERN,
    RULE_CHECK_SUFFIX,
    RULE_NAME_PREFIX_LENGTH,
    TYPE_CHECK_SUFFIX,
)
from ..functions.grammar import UNIQUE_REF, Columns, RuleSyntaxError, exists_parts, exists_ref, has_unique, parse_rule, to_sql
from ..functions.sql import bind_time, quote_ident
from ..functions.types import normalize_type
from ..sources.rules_io import collect_rules
from .references import Reference, exists_flags
from .unique import unique_flags

log = logging.getLogger("rowgate")

Translator = Callable[[str, str, str], str]


@dataclass(frozen=True)
class Check:
    name: str
    kind: str  # "type" | "rule" | "unique" | "exists"
    column_name: str
    data_type: str
    rule: str | None
    expression: str | None
    error: str | None = None
    index: int = -1
    run_sql: str | None = None  # what is executed, when simpler than ``expression``
    unique_part: bool = False  # the expression refers to the column's uniqueness flag
    references: tuple = field(default=(), compare=False)  # what its "must exist in" parts are looked up in
    clock: bool = False  # the expression still depends on when its job runs

    @property
    def ok(self) -> bool:
        return self.error is None

    @property
    def sql(self) -> str | None:
        return self.run_sql or self.expression

    @property
    def whole_table(self) -> bool:
        """Whether the check needs more than its row."""
        return self.unique_part or bool(self.references)

    @property
    def column(self) -> Column:
        """The boolean column of an already-applied check."""
        return F.col(quote_ident(self.name))


class _SchemaLookup(dict):
    """Column name -> type, resolved like Spark does (case-insensitive unless
    ``spark.sql.caseSensitive``)."""

    def __init__(self, schema: T.StructType, case_sensitive: bool):
        super().__init__((f.name if case_sensitive else f.name.lower(), f.dataType) for f in schema.fields)
        self.case_sensitive = case_sensitive

        self.spelling = {self._k(f.name): f.name for f in schema.fields}

    def _k(self, name):
        return name if self.case_sensitive else str(name).lower()

    def __contains__(self, name):
        return super().__contains__(self._k(name))

    def __getitem__(self, name):
        return super().__getitem__(self._k(name))


def _sanitize(text: str) -> str:
    return re.sub(NAME_SANITIZE_PATTERN, "_", text).lower()


def type_check_sql(column: str, data_type: str) -> str:
    """NULL or castable to the declared type."""
    c = quote_ident(column)
    return f"({c} IS NULL) OR (TRY_CAST({c} AS {normalize_type(data_type).upper()}) IS NOT NULL)"


def unique_check_sql(column: str) -> str:
    c = quote_ident(column)
    return f"({c} IS NULL) OR (COUNT(*) OVER (PARTITION BY {c}) = 1)"


def _plan(df: DataFrame):
    """The analysed plan; None where the client has none (Spark Connect)."""
    try:
        return df._jdf.queryExecution().analyzed()
    except AttributeError:
        return None


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _added(plan, source) -> list:
    """Nodes of ``plan`` above ``source``, the plan it was derived from: what
    the expressions of a projection turned into. Whatever the source itself is
    made of (aggregates, generators, windows) is not among them."""
    out = []
    while not plan.fastEquals(source):
        out.append(plan)
        children = _seq(plan.children())
        if len(children) != 1:
            break
        plan = children[0]
    return out


def _type_refusal(dt: T.DataType) -> str | None:
    return None if isinstance(dt, (T.BooleanType, T.NullType)) else f"expression is {dt.simpleString()}, not boolean"


def _refusal(added: list) -> str | None:
    """Why expressions that resolve are still no row-level checks."""
    for node in added:
        name = node.nodeName()
        if name == "Generate":
            return "expression makes rows (a generator); a check needs one value per row"
        if name == "Aggregate":
            return "expression aggregates; a check needs one value per row"
        if name == "Window" and node.partitionSpec().isEmpty():
            return "window without PARTITION BY (all rows in one task)"
        if not all(e.deterministic() for e in _seq(node.expressions())):
            return "expression is not deterministic; each row must be judged alike whenever it is read"
    return None


#: Expressions that Spark replaces by the time at which a query starts.
CLOCK_NODES = re.compile(r'"class":"[\w.]*\.(?:CurrentTimestamp|Now|CurrentDate|LocalTimestamp|CurrentTime)"')


def _reads_clock(added: list) -> bool:
    """Whether an expression depends on when its job runs (``current_date``
    and the like, also inside SQL functions): by the classes of its tree, which
    text in quotes cannot look like."""
    return any(CLOCK_NODES.search(e.toJSON()) for node in added for e in _seq(node.expressions()))


def _beside(df: DataFrame) -> list[str]:
    """A plain source column analysed beside an expression, so that an
    aggregate cannot pass as a query of its own."""
    return [f"{quote_ident(df.columns[0])} AS __rg_row"] if df.columns else []


def _projected(df: DataFrame, sqls: list[str]) -> tuple[DataFrame, list[str]]:
    # newline before ")": a trailing "-- comment" in user SQL cannot swallow it
    names = [f"__rg_{i}" for i in range(len(sqls))]
    return df.selectExpr(*_beside(df), *[f"({q}\n) AS {n}" for q, n in zip(sqls, names)]), names


def _analyze(df: DataFrame, sql: str) -> tuple[str | None, bool]:
    """Resolve ``sql`` against ``df`` without running a job: the error text
    when it does not parse or resolve or is no deterministic boolean per row,
    and whether its value depends on when the job runs."""
    try:
        alone, names = _projected(df, [sql])
        if alone.columns[len(_beside(df)):] != names:
            return "expression gives more than one column", False
        plan, source = _plan(alone), _plan(df)
        added = _added(plan, source) if plan is not None else []
        return _type_refusal(alone.schema[names[0]].dataType) or _refusal(added), _reads_clock(added)
    except PySparkException as e:  # parse and analysis errors
        lines = [ln.strip() for ln in str(e).splitlines() if ln.strip()]
        return (lines[0] if lines else type(e).__name__), False


def _analyze_all(df: DataFrame, sqls: list[str]) -> list[str | None]:
    """The error texts alone of ``_analyses``."""
    return [error for error, _ in _analyses(df, sqls)]


def _analyses(df: DataFrame, sqls: list[str]) -> list[tuple[str | None, bool]]:
    """Analyse all expressions in one projection; only when that finds a fault
    or a clock are they analysed one by one (analysis only, no job)."""
    if not sqls:
        return []
    try:
        together, names = _projected(df, sqls)
        if together.columns[len(_beside(df)):] == names:
            plan, schema = _plan(together), together.schema
            added = _added(plan, _plan(df)) if plan is not None else []
            if not any(_type_refusal(schema[n].dataType) for n in names) and not _refusal(added) and not _reads_clock(added):
                return [(None, False)] * len(sqls)
    except PySparkException:
        pass
    return [_analyze(df, q) for q in sqls]


def compile_rules(rules, df: DataFrame, translator: Translator | None = None,
                  on_error: str = "skip", type_checks: bool = True, run_time: datetime | None = None,
                  references: dict[str, DataFrame] | None = None, fixed_time: bool = True) -> list[Check]:
    """Rule rows -> ordered checks for ``df``.

    Time rules ("not in the future") and calls for the current time in free SQL
    compare with ``run_time``, one moment bound here (now, if not given), so
    every job that applies the checks judges a row alike. With ``fixed_time``
    false they stay functions of the time at which a job (or a micro-batch)
    runs. Column names take the spelling of ``df``'s schema; rules may name the
    other columns of ``df``. "Must exist in <table>.<column>" looks the table
    up in ``references`` (name -> frame), else in the catalog.

    A rule that cannot be parsed, translated, resolved against ``df`` or that
    needs an illegal cast is kept with its ``error`` set (``on_error="skip"``)
    and contributes no column; ``on_error="raise"`` raises instead.
    """
    rows = collect_rules(rules)
    case_sensitive = str(df.sparkSession.conf.get("spark.sql.caseSensitive", "false")).lower() == "true"
    schema = _SchemaLookup(df.schema, case_sensitive)
    when = (run_time or datetime.now(timezone.utc)).astimezone(timezone.utc)
    now = f"TIMESTAMP '{when:%Y-%m-%d %H:%M:%S.%f} UTC'" if fixed_time else "current_timestamp()"
    columns = Columns({f.name: f.dataType.simpleString() for f in df.schema.fields})
    fold = (lambda n: n) if case_sensitive else str.lower
    taken = {fold(c) for c in df.columns}
    type_checks_out: list[Check] = []
    rule_checks: list[Check] = []
    seen_types: set[tuple[str, str]] = set()

    def unique_name(base: str) -> str:
        name, n = base, 2
        while fold(name) in taken:
            name = f"{base}_{n}"
            n += 1
        taken.add(fold(name))
        return name

    for i, row in enumerate(rows):
        column = row.get("column_name")
        column = None if column is None else str(column).strip()  # data names are stripped too (C1)
        column = schema.spelling.get(schema._k(column), column) if column else column
        data_type = normalize_type(row.get("data_type"))
        text = row.get("rule")
        text = None if text is None else str(text)
        if not column:
            rule_checks.append(Check(unique_name(f"rule_{i}{RULE_CHECK_SUFFIX}"), "rule", column or "",
                                     data_type, text, None, "empty column_name", i))
            continue
        col_sql = quote_ident(column)
        col_type = schema[column].simpleString() if column in schema else None

        if type_checks and (column, data_type) not in seen_types:
            seen_types.add((column, data_type))
            sql = type_check_sql(column, data_type)
            # a column that already has the declared type always passes: run the
            # literal so Catalyst folds it away (the table still shows the cast)
            run = "true" if col_type is not None and normalize_type(col_type) == data_type else None
            type_checks_out.append(Check(unique_name(f"{_sanitize(column)}{TYPE_CHECK_SUFFIX}"), "type",
                                         column, data_type, None, sql, None, i, run))

        name = unique_name(f"{_sanitize(column)}_{_sanitize(text or '')[:RULE_NAME_PREFIX_LENGTH]}_{i}{RULE_CHECK_SUFFIX}")
        kind, sql, err, run, part, found = "rule", None, None, None, False, []
        try:
            spec = parse_rule(text or "", columns)
            part = has_unique(spec)
            if spec.kind == "unique":
                kind, sql = "unique", unique_check_sql(column)
            else:
                sql = to_sql(spec, col_sql, data_type, col_type, now, columns.types)
            if part:
                if column not in schema:
                    err = f"column {column!r} not found"
                elif isinstance(schema[column], T.MapType):
                    err = "uniqueness of a map column cannot be checked (maps are not comparable)"
            for where, table, key in [] if err else exists_parts(spec, column):
                if spec.kind == "exists":
                    kind = "exists"
                found.append(Reference(df, schema.spelling.get(schema._k(where), where), table, key, references))
                err = err or found[-1].error
            if kind == "rule" and (part or found):
                run = sql
            if found:
                run = sql
                for r, (where, table, key) in zip(found, exists_parts(spec, column)):
                    sql = sql.replace(exists_ref(quote_ident(where), table, key), r.sql)
            if part and kind != "unique":
                sql = sql.replace(UNIQUE_REF, unique_check_sql(column))
            if spec.kind == "sql":
                run = _bound(sql, now, columns, fixed_time)
        except RuleSyntaxError as e:
            if translator is not None:
                try:
                    sql = translator(column, data_type, text or "")
                    run = _bound(sql, now, columns, fixed_time)
                except Exception as te:  # translator is user code
                    err = f"translator failed: {te}"
            else:
                err = str(e)
        rule_checks.append(Check(name, kind, column, data_type, text, sql, err, i, run, part, tuple(found)))

    if hasattr(translator, "flush"):  # a cache writes through what it was told
        translator.flush()
    out = type_checks_out + rule_checks
    pending = [k for k, c in enumerate(out) if c.error is None and c.kind not in ("unique", "exists") and c.expression]
    for k, (err, clock) in zip(pending, _analyses(df, [_run_text(out[k], lambda _: "true") for k in pending])):
        if err or clock:
            out[k] = replace(out[k], error=err, clock=clock)
    for c in out:
        if c.error:
            log.warning("check %s (%r, %r) skipped: %s", c.name, c.column_name, c.rule, c.error)
    if on_error == "raise":
        bad = [c for c in out if c.error]
        if bad:
            raise ValueError(f"check {bad[0].name}: {bad[0].error}")
    return out


def _bound(sql: str, now: str, columns: Columns, fixed_time: bool) -> str | None:
    """Free SQL with the run's moment in place of the current time; None when
    nothing changes."""
    bound = bind_time(sql, now, columns.types) if fixed_time else sql
    return bound if bound != sql else None


def _run_text(check: Check, flag) -> str:
    """What is executed for a check, with ``flag(key)`` for the flag columns of
    its plan-level parts: the key is the column of a uniqueness part, or the
    ``Reference`` of an existence part."""
    text = check.sql
    if check.unique_part:
        text = text.replace(UNIQUE_REF, flag(check.column_name))
    for r in check.references:
        text = text.replace(r.placeholder, flag(r))
    return text


def active(checks: list[Check]) -> list[Check]:
    return [c for c in checks if c.ok]


def apply_checks(df: DataFrame, checks: list[Check], **unique_options) -> DataFrame:
    """``df`` plus one boolean column per usable check, in check order,
    built by a single projection (uniqueness flags first come from joins)."""
    checks = active(checks)
    flag_of: dict = {}  # one computation per column or reference
    for c in checks:
        for key in ([c.column_name] if c.unique_part else []) + list(c.references):
            flag_of.setdefault(key, f"__rg_flag_{len(flag_of)}")
    out = df
    unique = {k: v for k, v in flag_of.items() if isinstance(k, str)}
    known = {k: v for k, v in flag_of.items() if not isinstance(k, str)}
    if unique:
        out = unique_flags(df, unique, **unique_options)
    if known:
        out = exists_flags(df, known, onto=out, **unique_options)
    cols = [quote_ident(c) for c in df.columns]
    for c in checks:
        if c.kind == "unique":
            sql = quote_ident(flag_of[c.column_name])
        else:
            sql = _run_text(c, lambda k: quote_ident(flag_of[k]))
        cols.append(f"({sql}\n) AS {quote_ident(c.name)}")
    return out.selectExpr(*cols)


def compiled_rules(spark: SparkSession, checks: list[Check]) -> DataFrame:
    """The compiled-rules table (replaces a JSON expression cache)."""
    schema = T.StructType([
        T.StructField("check_order", T.IntegerType(), False),
        T.StructField("check_name", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("column_name", T.StringType(), True),
        T.StructField("data_type", T.StringType(), True),
        T.StructField("rule", T.StringType(), True),
        T.StructField("expression", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
    ])
    rows = [(i, c.name, c.kind, c.column_name, c.data_type, c.rule, c.expression, c.error)
            for i, c in enumerate(checks)]
    return spark.createDataFrame(rows, schema)


def expression_cache(compiled: DataFrame) -> Translator:
    """A translator backed by a compiled-rules table (B3), e.g. one saved with
    ``compiled_rules(...).write`` and completed by hand for rule texts the
    grammar does not know: ``(column, type, rule) -> expression``. The table
    holds one row per rule, so it is collected once."""
    rows = (compiled.where(F.col("expression").isNotNull() & F.col("error").isNull() & (F.col("kind") == "rule"))
            .select("column_name", "data_type", "rule", "expression").collect())
    table = {(r.column_name, normalize_type(r.data_type), r.rule): r.expression for r in rows}

    def translate(column: str, data_type: str, rule: str) -> str:
        key = (column, normalize_type(data_type), rule)
        if key not in table:
            raise RuleSyntaxError(f"no cached expression for {key}")
        return table[key]

    return translate
