"""One object for the usual calls, so code written against a validator
object (``validate(df, rules_path)``, generate-then-run) maps one to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.checks import Translator, compile_rules, compiled_rules, expression_cache
from .operators.prepare import prepare
from .operators.profile import suggest_rules
from .operators.review import review_sources
from .operators.split import invalid_rows
from .operators.synth import sample_rows
from .plans.publish import Published, publish_validation
from .plans.runner import ValidationResult, run_validation, run_validation_single_pass, validation_summary
from .sources.expressions import ExpressionCache


class Validator:
    """``translator`` handles rule texts the grammar does not know; a saved
    compiled-rules table can serve as one (``expression_table``), and
    ``cache_path`` keeps its answers in a table, so it is asked once per rule.
    ``references`` names frames for "must exist in <name>.<column>"; other
    names are looked up in the catalog."""

    def __init__(self, spark: SparkSession, translator: Translator | None = None,
                 expression_table: DataFrame | None = None, cache_path: str | None = None,
                 references: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.references = references
        self.translator = translator or (expression_cache(expression_table) if expression_table is not None else None)
        if cache_path is not None:
            self.translator = ExpressionCache(spark, cache_path, self.translator)

    def validate(self, df: DataFrame, rules) -> DataFrame:
        """Invalid rows with ``validation_errors`` (rules: table, list or CSV path)."""
        return invalid_rows(df, rules, translator=self.translator, references=self.references)

    def run(self, df: DataFrame, rules, valid_path: str, invalid_path: str, fmt: str = "parquet") -> ValidationResult:
        """Clean, check, summarise, split and write both outputs."""
        return run_validation(df, rules, valid_path, invalid_path, fmt=fmt, translator=self.translator, references=self.references)

    def publish(self, df: DataFrame, rules, base: str, run_id: str, fmt: str = "parquet") -> Published:
        """``run`` whose two outputs become visible together, once per run id."""
        return publish_validation(df, rules, base, run_id, fmt=fmt, translator=self.translator, references=self.references)

    def run_single_pass(self, df: DataFrame, rules, output_path: str, fmt: str = "parquet") -> ValidationResult:
        return run_validation_single_pass(df, rules, output_path, fmt=fmt, translator=self.translator, references=self.references)

    def summary(self, df: DataFrame, rules) -> DataFrame:
        """Failure summary only: nothing written, no rows shuffled."""
        return validation_summary(df, rules, translator=self.translator, references=self.references)

    def summaries(self, df: DataFrame, rules) -> dict[str, DataFrame]:
        """``type_checks`` and ``business_rules`` tables with the expression
        (or error) generated for each, as shown before a run."""
        table = compiled_rules(self.spark, compile_rules(rules, prepare(df), translator=self.translator,
                                                               references=self.references))
        return {"type_checks": table.where(F.col("kind") == "type"),
                "business_rules": table.where(F.col("kind") != "type")}

    def suggest(self, df: DataFrame, fraction: float | None = None) -> DataFrame:
        return suggest_rules(df, fraction=fraction)

    def sample(self, rules, n: int = 4) -> DataFrame:
        return sample_rows(self.spark, rules, n=n)


def review_notebook(spark: SparkSession, code: str, path: str = "notebook.py") -> DataFrame:
    """Review one notebook's source text (for many files use ``review_sources``
    over a table of files)."""
    return review_sources(spark.createDataFrame([(path, code)], "path string, text string"))
