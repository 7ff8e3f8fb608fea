"""Publishing both outputs of a run as one pair.

Layout of a published table at ``base``::

    runs/<run id>-<attempt>/{valid,invalid}   data of one attempt, written once
    commits/<number>/                         one row each, written last

A run writes its data under a name of its own and then its commit record. The
pair of the highest commit is the published one, so readers see the former
pair until both outputs of the next are complete, whatever happens in
between. A run id that is committed already writes nothing and gives back
what it published. A record becomes visible as one file by the rename that
ends its write.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .runner import run_validation
from .shared import delete_path, path_exists

RECORD = ("number bigint, run_id string, format string, valid_path string, invalid_path string, valid_count bigint, invalid_count bigint, "
          "committed_at timestamp, summary array<struct<check_name: string, failed_records: bigint, failure_rate_pct: double>>, "
          "refused array<struct<check_name: string, error: string>>")


@dataclass(frozen=True)
class Published:
    number: int
    run_id: str
    format: str
    valid_path: str
    invalid_path: str
    valid_count: int
    invalid_count: int
    summary: list
    refused: list

    def valid(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.format).load(self.valid_path)

    def invalid(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.format).load(self.invalid_path)


class NothingPublished(LookupError):
    """No run was committed at this place yet."""


def commit_log(spark: SparkSession, base: str) -> DataFrame:
    """All commit records (empty without any)."""
    path = f"{base.rstrip('/')}/commits"
    try:
        if path_exists(spark, path):
            return spark.read.schema(RECORD).option("recursiveFileLookup", True).json(path)
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], RECORD)


def _last(log: DataFrame) -> Published | None:
    r = log.orderBy(F.desc("number"), F.desc("committed_at"), F.desc("run_id")).first()
    return r and Published(r.number, r.run_id, r.format, r.valid_path, r.invalid_path, r.valid_count, r.invalid_count,
                           [tuple(x) for x in r.summary or []], [tuple(x) for x in r.refused or []])


def published(spark: SparkSession, base: str, run_id: str | None = None) -> Published:
    """The published pair (or that of one run id)."""
    log = commit_log(spark, base)
    found = _last(log if run_id is None else log.where(F.col("run_id") == run_id))
    if found is None:
        raise NothingPublished(f"nothing is published at {base}" + (f" by run {run_id!r}" if run_id else ""))
    return found


def publish_validation(df: DataFrame, rules, base: str, run_id: str, fmt: str = "parquet", **options) -> Published:
    """``run_validation`` whose outputs replace the published pair at ``base``
    together. ``options`` are those of ``run_validation``."""
    spark, base = df.sparkSession, base.rstrip("/")
    if not run_id:
        raise ValueError("a run needs an id; the same id never publishes twice")
    done = _last(commit_log(spark, base).where(F.col("run_id") == run_id))
    if done is not None:
        return done
    name = re.sub(r"[^A-Za-z0-9._-]", "_", run_id)[:80]
    place = f"{base}/runs/{name}-{uuid.uuid4().hex[:12]}"
    res = run_validation(df, rules, f"{place}/valid", f"{place}/invalid", fmt=fmt, **options)
    return _commit(spark, base, {
        "run_id": run_id, "format": fmt, "valid_path": res.valid_path, "invalid_path": res.invalid_path,
        "valid_count": res.valid_count, "invalid_count": res.invalid_count,
        "summary": [tuple(r) for r in res.summary.collect()],  # one row per failing check
        "refused": [(c.name, c.error) for c in res.checks if c.error]})


def _commit(spark: SparkSession, base: str, record: dict) -> Published:
    """Write the record under the next number; when another run took it, under the one after."""
    columns = [c.split(" ")[0] for c in ("number", "run_id", "format", "valid_path", "invalid_path", "valid_count", "invalid_count",
                                         "committed_at", "summary", "refused")]
    while True:
        last = _last(commit_log(spark, base))
        number = last.number + 1 if last else 1
        row = {**record, "number": number, "committed_at": datetime.now(timezone.utc)}
        try:
            (spark.createDataFrame([tuple(row[c] for c in columns)], RECORD).coalesce(1)
             .write.mode("errorifexists").json(f"{base}/commits/{number:012d}"))
        except PySparkException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS" or published(spark, base).number < number:
                raise
            continue
        return published(spark, base, record["run_id"])


def drop_former(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Delete the data of all but the ``keep`` last committed runs and return
    how many went; their records stay. Attempts that never committed are not
    touched: one of them may be running."""
    log = commit_log(spark, base)
    recent = {r.valid_path for r in log.orderBy(F.desc("number")).limit(max(int(keep), 1)).select("valid_path").collect()}
    gone = 0
    for r in log.select("valid_path").distinct().toLocalIterator():
        if r.valid_path not in recent:
            gone += delete_path(spark, r.valid_path.rsplit("/", 1)[0])
    return gone
