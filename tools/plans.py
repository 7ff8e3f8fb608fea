"""Write PLANS.md: formatted physical plans of the headline operators.

    python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from bench import LINEITEM_RULES  # noqa: E402
from rowgate import checked_frame, failure_summary, review_sources, unique_flag  # noqa: E402
from rowgate.operators.split import invalid_split, valid_split  # noqa: E402
from rowgate.plans.shared import ensure_checkpoint_dir, scratch_scope  # noqa: E402

NOTES = {
    "failure summary (F3/F4)": "One scan reading only the checked columns, all checks evaluated in one "
                               "codegen stage, partial aggregation, a one-row final aggregate exploded with "
                               "`inline` (no sort).",
    "invalid split (F5)": "Scan, trim, checks and filter fused in one whole-stage-codegen stage; no shuffle.",
    "valid split (F6)": "Same stage shape; the filter is the null-safe complement of F5.",
    "uniqueness, broadcast path (E8)": "The duplicate-key table (written once, exact size observed) is "
                                       "broadcast into the scan stage: no shuffle of the rows.",
    "uniqueness, salted path (E8)": "Hot keys (bounded list, broadcast) are salted on the data side and "
                                    "replicated per salt on the duplicate side; sort-merge join on (key, salt). "
                                    "Forced here with `broadcast_max_keys=0` and Spark's auto-broadcast off.",
    "uniqueness of whole texts, hash-first (E8)": "Pass 2 of the hash-first duplicate search: only rows whose "
                                                  "64-bit text hash repeats (the suspect hashes, written once "
                                                  "and broadcast after a size check) are grouped by the full "
                                                  "text; pass 1 shuffled hashes only.",
    "source review (G2-G7)": "Map-only: each file's lines are flagged and reduced inside its row with "
                             "higher-order functions (literal prefilters before regexes); no explode, sort "
                             "or shuffle. (A line-level explode with `groupBy(path)` would need a sort-based "
                             "aggregate, because the first offending line is a string.)",
}


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue().strip()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, "/tmp/rowgate-checkpoints")
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = ["# Physical plans of the headline operators", "",
           f"Generated by `python tools/plans.py` on `{os.path.basename(sf)}` (local[8], AQE on: the plans "
           "below are the initial adaptive plans).", ""]
    with scratch_scope(spark):
        checked, checks = checked_frame(li, LINEITEM_RULES[:4])
        keys = li.select("l_orderkey", "l_linenumber")
        frames = {
            "failure summary (F3/F4)": failure_summary(checked, checks),
            "invalid split (F5)": invalid_split(checked, checks),
            "valid split (F6)": valid_split(checked, checks),
            "uniqueness, broadcast path (E8)": unique_flag(keys, "l_orderkey", "ok").where(~F.col("ok")),
        }
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frames["uniqueness, salted path (E8)"] = unique_flag(keys, "l_orderkey", "ok", broadcast_max_keys=0,
                                                            rows_per_hot=3).where(~F.col("ok"))
        from rowgate.operators.unique import _hashed_candidates
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
        cand = _hashed_candidates(docs, "text", 2_000_000)
        frames["uniqueness of whole texts, hash-first (E8)"] = (
            cand.groupBy("__rg_k").agg(F.count(F.lit(1)).alias("__rg_n")).where(F.col("__rg_n") > 1))
        frames["source review (G2-G7)"] = review_sources(spark.read.parquet(f"{sf}/documents.parquet"),
                                                          path="doc_id")
        for title, df in frames.items():
            out += [f"## {title}", "", NOTES[title], "", "```", plan(df), "```", ""]
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
