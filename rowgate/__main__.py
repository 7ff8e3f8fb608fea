"""Command line: ``python -m rowgate <command> ...`` (or ``spark-submit``).

    validate --rules rules.csv --source TABLE_OR_PATH --valid PATH --invalid PATH
    validate --rules rules.csv --source TABLE_OR_PATH --output PATH      (one scan, split=valid|invalid)
    validate --rules rules.csv --source TABLE_OR_PATH                    (failure summary only)
    suggest  --source TABLE_OR_PATH --out rules_dir [--fraction 0.1]
    sample   --rules rules.csv --n 4 --out PATH
    review   --source DIR [--pattern '*.py'] [--out PATH]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    return SparkSession.builder.appName("rowgate").getOrCreate()


def _print_all(df) -> None:
    """All rows, whole cells: a summary, a rule table or a report has few."""
    print(" | ".join(df.columns))
    for r in df.toLocalIterator():
        print(" | ".join("" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None) -> int:
    from .operators.profile import suggest_rules
    from .operators.review import review_sources
    from .operators.synth import sample_rows
    from .plans.runner import run_validation, run_validation_single_pass, validation_summary
    from .sources.rules_io import export_rules, load_rules
    from .sources.tables import load_source_files, load_table, write_frame

    p = argparse.ArgumentParser(prog="rowgate")
    sub = p.add_subparsers(dest="cmd", required=True)
    v = sub.add_parser("validate")
    v.add_argument("--rules", required=True)
    v.add_argument("--source", required=True)
    v.add_argument("--format", default=None)
    v.add_argument("--valid")
    v.add_argument("--invalid")
    v.add_argument("--output")
    v.add_argument("--out-format", default="parquet")
    s = sub.add_parser("suggest")
    s.add_argument("--source", required=True)
    s.add_argument("--format", default=None)
    s.add_argument("--out", required=True)
    s.add_argument("--fraction", type=float, default=None)
    g = sub.add_parser("sample")
    g.add_argument("--rules", required=True)
    g.add_argument("--n", type=int, default=4)
    g.add_argument("--out", required=True)
    r = sub.add_parser("review")
    r.add_argument("--source", required=True)
    r.add_argument("--pattern", default="*.py")
    r.add_argument("--out")
    a = p.parse_args(argv)

    spark = _session()
    if a.cmd == "validate":
        df = load_table(spark, a.source, a.format)
        rules = load_rules(spark, a.rules)
        if a.output:
            res = run_validation_single_pass(df, rules, a.output, fmt=a.out_format)
        elif a.valid and a.invalid:
            res = run_validation(df, rules, a.valid, a.invalid, fmt=a.out_format)
        elif not (a.valid or a.invalid):
            _print_all(validation_summary(df, rules))  # nothing written
            return 0
        else:
            p.error("give both --valid and --invalid, or --output, or neither for a summary only")
        print(f"valid={res.valid_count} invalid={res.invalid_count}")
        _print_all(res.summary)
        for c in res.checks:
            if c.error:
                print(f"skipped {c.name}: {c.error}", file=sys.stderr)
    elif a.cmd == "suggest":
        rules = suggest_rules(load_table(spark, a.source, a.format), fraction=a.fraction)
        export_rules(rules, a.out)
        _print_all(rules)
    elif a.cmd == "sample":
        write_frame(sample_rows(spark, load_rules(spark, a.rules), n=a.n), a.out)
    elif a.cmd == "review":
        report = review_sources(load_source_files(spark, a.source, a.pattern))
        if a.out:
            write_frame(report, a.out)
        else:
            _print_all(report.orderBy("path", "standard"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
