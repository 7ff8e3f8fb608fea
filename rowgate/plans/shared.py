"""Shared-storage helpers: lineage cuts go to the cluster's checkpoint dir."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SCOPE: contextvars.ContextVar[list | None] = contextvars.ContextVar("rowgate_scratch", default=None)


def _context_dir(spark: SparkSession) -> str | None:
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # no SparkContext on the client (Spark Connect)
        return None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or the context's
    checkpoint dir). Raises when neither is set: a machine-local temp folder
    would not survive the loss of an executor."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS/...)")
    return path.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """For tests and local runs only: use ``fallback`` when nothing is set."""
    current = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if current:
        return current
    try:
        spark.sparkContext.setCheckpointDir(fallback)
    except Exception:  # Spark Connect: no context on the client
        spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir."""
    return f"{shared_dir(spark)}/rowgate-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: the lineage is cut, a lost executor recomputes nothing
    upstream, and ``metrics`` (aggregate columns) are observed during that
    single write, so sizes are known without another pass."""
    path = scratch_path(df.sparkSession, name)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    obs = Observation(f"rowgate_{name}_{uuid.uuid4().hex[:8]}")
    target = df.observe(obs, *metrics) if metrics else df
    target.write.mode("overwrite").parquet(path)
    values = obs.get if metrics else {}
    return df.sparkSession.read.schema(df.schema).parquet(path), values


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursively delete ``path`` through the Hadoop FileSystem of the
    session (works for HDFS, S3A, ABFS, local). False when not possible."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        return bool(hpath.getFileSystem(conf).delete(hpath, True))
    except Exception:  # e.g. Spark Connect: no JVM on the client
        return False


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, by the Hadoop FileSystem of the
    session; true where that cannot be told (Spark Connect), so that a read
    finds out."""
    try:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # no JVM on the client
        return True
    return bool(hpath.getFileSystem(conf).exists(hpath))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is one file, by the Hadoop FileSystem of the session."""
    try:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.getFileStatus(hpath).isFile())
    except Exception:  # no such path, or Spark Connect: no JVM on the client
        return False


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Tables materialized inside the block are deleted when it ends (use it
    around work that is fully finished by then, e.g. writes)."""
    created: list[str] = []
    token = _SCOPE.set(created)
    try:
        yield created
    finally:
        _SCOPE.reset(token)
        for path in created:
            delete_path(spark, path)


def require_batch(df: DataFrame, what: str) -> None:
    """Batch-only operators fail early and clearly on a streaming frame."""
    if df.isStreaming:
        raise ValueError(f"{what} needs a batch DataFrame; for streams use rowgate.streaming.stream "
                         "(validate_stream, stream_failure_summary)")
