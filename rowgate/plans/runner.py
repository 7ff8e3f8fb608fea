"""End-to-end runs: ``run_validation`` (F9) and ``checked_frame``.

Every row's split is decided once. Time rules and calls for the current time
compare with one moment bound when the rules are compiled. A source that two
jobs provably read alike (files through projections and filters), under checks
that two jobs judge alike, is read once per output write; any other is checked
once into a staging table partitioned by ``split``, from which both outputs
are written. So no row can be in neither output or in both.

When rules are given and every single one is refused, nothing is written and
``RulesRefused`` names the reasons: "no usable check, all rows valid" is for
tables that have no rules.
The failure summary needs no pass of its own: per-check failure counts are
observed (``Observation``) during the write.
``run_validation_single_pass`` always reads the source once, writing one table
partitioned by ``split``.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.sql import quote_ident
from ..operators.checks import Check, Translator, active, apply_checks, compile_rules
from ..operators.prepare import prepare
from ..operators.references import missing_row_count
from ..operators.report import SUMMARY_SCHEMA, failure_counts, is_invalid, summary_from_totals
from ..operators.split import invalid_split, valid_split
from ..operators.unique import duplicated_row_count
from ..sources.tables import write_frame
from .shared import delete_path, materialize, require_batch, scratch_path, scratch_scope


@dataclass
class ValidationResult:
    checks: list[Check]
    summary: DataFrame
    valid_count: int
    invalid_count: int
    valid_path: str
    invalid_path: str

    @property
    def total(self) -> int:
        return self.valid_count + self.invalid_count


class RulesRefused(ValueError):
    """Every rule of a run was refused; ``checks`` has the reasons."""

    def __init__(self, checks: list[Check]):
        self.checks = checks
        reasons = "; ".join(f"{c.column_name}, {c.rule!r}: {c.error}" for c in checks if c.error)
        super().__init__(f"none of the given rules can be checked: {reasons}")


def _compiled(rules, prepared: DataFrame, translator, references) -> list[Check]:
    checks = compile_rules(rules, prepared, translator=translator, references=references)
    given = [c for c in checks if c.kind != "type"]
    if given and not active(given):
        raise RulesRefused(checks)
    return checks


def checked_frame(df: DataFrame, rules, translator: Translator | None = None, strip: bool = True,
                  trim: bool = True, references: dict[str, DataFrame] | None = None, **unique_options) -> tuple[DataFrame, list[Check]]:
    """C1 -> C2 -> E1 -> E2..E9: the prepared frame plus its check columns."""
    prepared = prepare(df, strip=strip, trim=trim)
    checks = compile_rules(rules, prepared, translator=translator, references=references)
    return apply_checks(prepared, checks, **unique_options), checks


def validation_summary(df: DataFrame, rules, translator: Translator | None = None, strip: bool = True,
                       trim: bool = True, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """F4 without writing anything and without joining rows back for
    uniqueness: row-level checks are counted in one aggregation pass, and a
    uniqueness check's failures are the rows of its duplicated keys, counted
    by one partially aggregated pass over the key column; so are those of an
    existence check. No shuffle of rows, however many duplicates there are. Runs its jobs now; the result is a
    small local table (one row per failing check)."""
    require_batch(df, "validation_summary")
    prepared = prepare(df, strip=strip, trim=trim)
    checks = compile_rules(rules, prepared, translator=translator, references=references)
    usable = active(checks)
    rows = [c for c in usable if c.kind not in ("unique", "exists")]
    by_key: dict = {}
    with scratch_scope(df.sparkSession):
        counts = failure_counts(apply_checks(prepared, rows), rows).first()
        for c in usable:
            key = c.column_name if c.kind == "unique" else c.references[0] if c.kind == "exists" else None
            if key is not None and key not in by_key:
                by_key[key] = duplicated_row_count(prepared, key) if c.kind == "unique" else missing_row_count(prepared, key)
    failed = [by_key[c.column_name] if c.kind == "unique" else by_key[c.references[0]] if c.kind == "exists" else int(counts[c.name])
              for c in usable]
    return summary_from_totals(df.sparkSession, usable, int(counts["total_records"]), failed)


@contextlib.contextmanager
def _open_writers(spark):
    """Two open files per task instead of a sort of all rows by ``split``."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    if int(before or 0) >= 2:
        yield
        return
    spark.conf.set(key, "4")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_PLAIN_NODES = {"Project", "Filter", "SubqueryAlias", "View", "LocalRelation", "Range"}


def reads_alike(df: DataFrame) -> bool:
    """True when two jobs over ``df`` provably see the same rows: deterministic
    projections and filters over files listed once, literals or a range."""
    def stable(node) -> bool:
        name, expressions = node.nodeName(), node.expressions()
        if name == "LogicalRelation":
            return node.relation().getClass().getSimpleName() == "HadoopFsRelation"
        if name not in _PLAIN_NODES or not all(expressions.apply(i).deterministic() for i in range(expressions.size())):
            return False
        children = node.children()
        return all(stable(children.apply(i)) for i in range(children.size()))
    try:
        return stable(df._jdf.queryExecution().analyzed())
    except Exception:  # Spark Connect: no plan on the client
        return False


def _run_single_pass(df: DataFrame, rules, output_path: str, fmt: str = "parquet",
                     translator: Translator | None = None, strip: bool = True, trim: bool = True,
                     split_column: str = "split", references: dict[str, DataFrame] | None = None, **unique_options) -> ValidationResult:
    """F9 in one scan and one write job: every row is written once under
    ``output_path/split=valid`` or ``output_path/split=invalid`` (original
    columns plus all check columns; on valid rows the checks are true or
    NULL and compress to almost nothing). Counts and per-check failures are
    observed during that write."""
    prepared = prepare(df, strip=strip, trim=trim)
    checks = _compiled(rules, prepared, translator, references)
    usable = active(checks)
    spark = df.sparkSession
    if split_column in prepared.columns:
        raise ValueError(f"the source already has a column {split_column!r}; pass another split_column")
    checked = apply_checks(prepared, usable, **unique_options)
    split = F.when(is_invalid(usable), F.lit("invalid")).otherwise(F.lit("valid")).alias(split_column)
    obs = Observation("rowgate_split")
    part = F.col(quote_ident(split_column))
    out = checked.select("*", split).observe(
        obs, F.count_if(part == "valid").alias("valid"), F.count_if(part == "invalid").alias("invalid"),
        *[F.expr(f"count_if({quote_ident(c.name)} = false)").alias(f"f{i}") for i, c in enumerate(usable)])
    with _open_writers(spark):
        write_frame(out, output_path, fmt, partition_by=split_column)
    m = obs.get
    valid_n, invalid_n = int(m["valid"]), int(m["invalid"])
    failed = [int(m[f"f{i}"]) for i in range(len(usable))]
    return ValidationResult(checks, summary_from_totals(spark, usable, valid_n + invalid_n, failed), valid_n,
                            invalid_n, f"{output_path}/{split_column}=valid", f"{output_path}/{split_column}=invalid")


def _run_two_outputs(df: DataFrame, rules, valid_path: str, invalid_path: str, fmt: str = "parquet",
                     translator: Translator | None = None, strip: bool = True, trim: bool = True,
                     rebalance_invalid: bool = True, references: dict[str, DataFrame] | None = None, **unique_options) -> ValidationResult:
    """prepare, check, summarise, split and write; each row goes to exactly
    one output (see the module's first lines).

    Valid rows are written with the original (stripped) columns; invalid rows
    with the original columns plus every check column. Both outputs are
    always overwritten, also when empty. With no usable check every row is
    valid and the invalid output is written empty (A8).

    Invalid rows are usually a small fraction spread over every input split;
    ``rebalance_invalid`` shuffles just those rows (AQE sizes the partitions)
    so the invalid output is a few well-sized files, not one per split.
    """
    prepared = prepare(df, strip=strip, trim=trim)
    checks = _compiled(rules, prepared, translator, references)
    usable = active(checks)
    orig = [F.col(quote_ident(c)) for c in prepared.columns]
    spark = df.sparkSession

    if not usable:
        obs = Observation("rowgate_valid")
        write_frame(prepared.observe(obs, F.count(F.lit(1)).alias("rows")), valid_path, fmt)
        write_frame(prepared.limit(0), invalid_path, fmt)
        summary = spark.createDataFrame([], SUMMARY_SCHEMA)
        return ValidationResult(checks, summary, int(obs.get["rows"]), 0, valid_path, invalid_path)

    if not reads_alike(prepared) or any(c.clock for c in usable):
        return _run_staged(prepared, checks, valid_path, invalid_path, fmt, rebalance_invalid, **unique_options)
    checked = apply_checks(prepared, usable, **unique_options)
    obs_valid = Observation("rowgate_valid")
    obs_invalid = Observation("rowgate_invalid")
    valid = valid_split(checked, usable).select(*orig).observe(obs_valid, F.count(F.lit(1)).alias("rows"))
    invalid = invalid_split(checked, usable).select(*orig, *[c.column for c in usable])
    if rebalance_invalid:
        invalid = invalid.hint("rebalance")
    invalid = (invalid
               .observe(obs_invalid, F.count(F.lit(1)).alias("rows"),
                        *[F.expr(f"count_if({quote_ident(c.name)} = false)").alias(f"f{i}")
                          for i, c in enumerate(usable)]))
    write_frame(valid, valid_path, fmt)
    write_frame(invalid, invalid_path, fmt)
    v, inv = obs_valid.get, obs_invalid.get
    total = int(v["rows"]) + int(inv["rows"])
    failed = [int(inv[f"f{i}"]) for i in range(len(usable))]
    return ValidationResult(checks, summary_from_totals(spark, usable, total, failed), int(v["rows"]),
                            int(inv["rows"]), valid_path, invalid_path)


def _run_staged(prepared: DataFrame, checks: list[Check], valid_path: str, invalid_path: str, fmt: str,
                rebalance_invalid: bool, **unique_options) -> ValidationResult:
    """F9 over a source that may give other rows when read again: rows are
    checked and split in one job, into a staging table in the shared folder."""
    usable, spark = active(checks), prepared.sparkSession
    base, _ = materialize(prepared, "source") if any(c.whole_table for c in usable) else (prepared, {})
    checked = apply_checks(base, usable, **unique_options)
    names = [f"c{i}" for i in range(len(checked.columns))]
    obs, path = Observation("rowgate_staged"), scratch_path(spark, "staged")
    staged = (checked.toDF(*names).withColumn("split", F.when(
        F.coalesce(F.expr(" OR ".join(f"c{len(prepared.columns) + i} = false" for i in range(len(usable)))), F.lit(False)),
        F.lit("invalid")).otherwise(F.lit("valid")))
        .observe(obs, F.count_if(F.col("split") == "valid").alias("valid"),
                 F.count_if(F.col("split") == "invalid").alias("invalid"),
                 *[F.expr(f"count_if(c{len(prepared.columns) + i} = false)").alias(f"f{i}") for i in range(len(usable))]))
    with _open_writers(spark):
        staged.write.partitionBy("split").parquet(path)
    read = spark.read.schema(staged.schema).parquet(path)
    back = [F.col(n).alias(c) for n, c in zip(names, checked.columns)]
    write_frame(read.where("split = 'valid'").select(*back[:len(prepared.columns)]), valid_path, fmt)
    invalid = read.where("split = 'invalid'").select(*back)
    write_frame(invalid.hint("rebalance") if rebalance_invalid else invalid, invalid_path, fmt)
    delete_path(spark, path)
    m = obs.get
    valid_n, invalid_n = int(m["valid"]), int(m["invalid"])
    summary = summary_from_totals(spark, usable, valid_n + invalid_n, [int(m[f"f{i}"]) for i in range(len(usable))])
    return ValidationResult(checks, summary, valid_n, invalid_n, valid_path, invalid_path)


def run_validation_single_pass(df: DataFrame, rules, output_path: str, fmt: str = "parquet",
                               translator: Translator | None = None, strip: bool = True, trim: bool = True,
                               split_column: str = "split", references: dict[str, DataFrame] | None = None,
                               **unique_options) -> ValidationResult:
    require_batch(df, "run_validation_single_pass")
    with scratch_scope(df.sparkSession):
        return _run_single_pass(df, rules, output_path, fmt, translator, strip, trim, split_column, references,
                                **unique_options)


def run_validation(df: DataFrame, rules, valid_path: str, invalid_path: str, fmt: str = "parquet",
                   translator: Translator | None = None, strip: bool = True, trim: bool = True,
                   rebalance_invalid: bool = True, references: dict[str, DataFrame] | None = None, **unique_options) -> ValidationResult:
    require_batch(df, "run_validation")
    with scratch_scope(df.sparkSession):
        return _run_two_outputs(df, rules, valid_path, invalid_path, fmt, translator, strip, trim,
                                rebalance_invalid, references, **unique_options)


run_validation_single_pass.__doc__ = _run_single_pass.__doc__
run_validation.__doc__ = _run_two_outputs.__doc__
