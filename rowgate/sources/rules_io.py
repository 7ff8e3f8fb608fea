"""Rule tables: read (A1/A2), build, export (A5), and data samples (A3)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

RULE_COLUMNS = ("column_name", "data_type", "rule")
RULES_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RULE_COLUMNS])


def require_rule_columns(columns: Iterable[str]) -> None:
    """A2: the three rule columns must be present; extra columns are allowed."""
    missing = [c for c in RULE_COLUMNS if c not in set(columns)]
    if missing:
        raise ValueError(
            "rules table must contain the columns column_name, data_type, rule; missing: " + ", ".join(missing)
        )


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """A1: rules CSV with a header. Every value is read as text (no type
    inference) and columns are bound by header name, so extra or reordered
    columns are fine. ``escape='"'`` reads doubled quotes the way CSV
    writers (and ``export_rules``) produce them."""
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)
    require_rule_columns(raw.columns)
    return raw.select(*[F.col(c).cast("string").alias(c) for c in RULE_COLUMNS])


def rules_frame(spark: SparkSession, rows) -> DataFrame:
    """Rules table from ``(column_name, data_type, rule)`` tuples or dicts."""
    norm = []
    for r in rows:
        if isinstance(r, Mapping):
            norm.append(tuple(None if r.get(c) is None else str(r.get(c)) for c in RULE_COLUMNS))
        else:
            norm.append(tuple(None if v is None else str(v) for v in r))
    return spark.createDataFrame(norm, RULES_SCHEMA)


def collect_rules(rules) -> list[dict]:
    """Rule rows as dicts, in table order. Rule tables hold tens of rows;
    collecting them once to build the plan is the only driver round trip."""
    if isinstance(rules, DataFrame):
        require_rule_columns(rules.columns)
        return [r.asDict() for r in rules.select(*RULE_COLUMNS).collect()]
    if isinstance(rules, str):  # a rules CSV path
        spark = SparkSession.getActiveSession()
        return collect_rules(load_rules(spark, rules))
    if hasattr(rules, "to_dict") and hasattr(rules, "columns"):  # pandas
        require_rule_columns(rules.columns)
        return [{c: rec.get(c) for c in RULE_COLUMNS} for rec in rules.to_dict("records")]
    out = []
    for r in rules:
        if isinstance(r, Mapping):
            require_rule_columns(r.keys())
            out.append({c: r.get(c) for c in RULE_COLUMNS})
        else:
            out.append(dict(zip(RULE_COLUMNS, r)))
    return out


def export_rules(rules: DataFrame, path: str, mode: str = "overwrite", single_file: bool | None = None) -> None:
    """A5: rules as CSV with a header; quotes inside values are doubled.

    A rules table has tens of rows, so it is written by one task. With a
    target ending in ``.csv`` (or ``single_file=True``) the result is that one
    file instead of a folder: the part file is renamed through the Hadoop
    FileSystem of the session."""
    require_rule_columns(rules.columns)
    single = path.lower().endswith(".csv") if single_file is None else single_file
    target = f"{path}.parts" if single else path
    (rules.select(*RULE_COLUMNS).coalesce(1).write.mode(mode)
     .csv(target, header=True, escape='"', quote='"'))
    if single:
        _promote_single_part(rules.sparkSession, target, path)


def _promote_single_part(spark: SparkSession, folder: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src_dir = jvm.org.apache.hadoop.fs.Path(folder)
    fs = src_dir.getFileSystem(conf)
    parts = [st.getPath() for st in fs.listStatus(src_dir) if st.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise RuntimeError(f"expected one part file in {folder}, found {len(parts)}")
    dst = jvm.org.apache.hadoop.fs.Path(path)
    if fs.exists(dst):
        fs.delete(dst, True)
    if not fs.rename(parts[0], dst):
        raise RuntimeError(f"could not move {parts[0]} to {path}")
    fs.delete(src_dir, True)


def rule_stats(rules: DataFrame) -> DataFrame:
    """Rule count per data type, most frequent first, plus the total as
    ``data_type = NULL`` via ``rollup``."""
    require_rule_columns(rules.columns)
    return (rules.rollup("data_type").agg(F.count(F.lit(1)).alias("rule_count"))
            .orderBy(F.col("data_type").isNull().desc(), F.desc("rule_count"), "data_type"))


def read_sample(spark: SparkSession, path: str, fmt: str = "csv", fraction: float | None = None,
                seed: int = 42, null_tokens: Iterable[str] | None = None, **options) -> DataFrame:
    """A3: a data sample to profile. CSV is read with a header and inferred
    types; ``null_tokens`` (e.g. ``["NA", "null", ""]``) turn those strings
    into NULL the way spreadsheet readers do; ``fraction`` samples rows."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path)
    if null_tokens:
        tokens = list(null_tokens)
        df = df.select(*[
            (F.when(F.col(f"`{f.name}`").isin(tokens), F.lit(None)).otherwise(F.col(f"`{f.name}`")).alias(f.name)
             if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`"))
            for f in df.schema.fields])
    if fraction is not None:
        df = df.sample(fraction=fraction, seed=seed)
    return df
