"""A profile that grows with its table (D2-D7): per part of the data a state
is stored, and states merge without the data being read again.

State of a part, at ``path``:

* ``columns/part=<id>``: one row per column with its counts, email matches,
  integral minimum and maximum, an HLL sketch of a string column, and its
  values with counts while there are at most ``IN_LIST_MAX_DISTINCT``;
* ``hashes/part=<id>``: ``(position, h1, h2)``, 128 bits per value, of the
  columns whose values are all different within the part. A column that
  repeats a value stores none.

A part is read twice: one wide aggregation, then one grouping of (column,
value or hash) pairs. It is stored under its id, hashes first, and replaces
what that id held before, so a repeated load changes nothing. A part that lacks
its ``columns`` row set (its load died) is no part.

Merged, sums and extremes add up, sketches unite, value lists unite, and a
column is unique when it is unique in every part and no hash occurs in two.
Equality of values across parts is decided by two 64-bit hashes of the typed
value (the only step that does not look at the values themselves).
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.fixed import EMAIL_REGEX, IN_LIST_MAX_DISTINCT, IN_LIST_MIN_DISTINCT
from ..functions.sql import quote_str
from ..functions.types import type_label
from ..plans.shared import path_exists, require_batch
from ..sources.rules_io import RULES_SCHEMA
from .prepare import prepare
from .profile import _INTEGRAL, _SIMPLE, LOWCARD_SKETCH_LIMIT, PROFILE_SCHEMA, _present, _surely_repeated, suggestions_from_stats

STATE = T.StructType([
    T.StructField("position", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("data_type", T.StringType()),
    T.StructField("spark_type", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("non_null", T.LongType()),
    T.StructField("emails", T.LongType()), T.StructField("low", T.DecimalType(38, 0)), T.StructField("high", T.DecimalType(38, 0)),
    T.StructField("sketch", T.BinaryType()), T.StructField("unique", T.BooleanType()),
    T.StructField("values", T.ArrayType(T.StructType([T.StructField("v", T.StringType()), T.StructField("n", T.LongType())]))),
])
HASHES = "position int, h1 bigint, h2 bigint"
MOST = IN_LIST_MAX_DISTINCT


def add_part(df: DataFrame, path: str, part: str) -> None:
    """Profile ``df`` as the part ``part`` of the table whose state is at ``path``."""
    require_batch(df, "add_part")
    if not re.fullmatch(r"[A-Za-z0-9._-]+", part or ""):
        raise ValueError(f"a part's id is a file name: {part!r}")
    df = prepare(df)
    spark, path = df.sparkSession, path.rstrip("/")
    fields = df.schema.fields
    aggs = ["count(1) AS n"]
    for i, f in enumerate(fields):
        c = _present(f)
        aggs.append(f"count({c}) AS nn{i}")
        if isinstance(f.dataType, T.StringType):
            aggs.append(f"hll_sketch_agg({c}) AS sk{i}")
            aggs.append(f"count_if(contains({c}, '@') AND {c} RLIKE {quote_str(EMAIL_REGEX)}) AS em{i}")
        if isinstance(f.dataType, _INTEGRAL):
            aggs += [f"CAST(min({c}) AS DECIMAL(38,0)) AS mn{i}", f"CAST(max({c}) AS DECIMAL(38,0)) AS mx{i}"]
    wide = df.selectExpr(*aggs)
    wide = wide.selectExpr("*", *[f"hll_sketch_estimate(sk{i}) AS ad{i}" for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]).first()

    stats = []
    for i, f in enumerate(fields):
        text, nn = isinstance(f.dataType, T.StringType), int(wide[f"nn{i}"])
        s = {"position": i, "name": f.name, "sql": _present(f), "data_type": type_label(f.dataType), "spark_type": f.dataType.simpleString(),
             "rows": int(wide["n"]), "non_null": nn, "emails": int(wide[f"em{i}"]) if text else None, "low": None, "high": None,
             "sketch": wide[f"sk{i}"] if text else None, "unique": isinstance(f.dataType, _SIMPLE), "values": None,
             "listed": text and int(wide[f"ad{i}"]) <= LOWCARD_SKETCH_LIMIT}
        if isinstance(f.dataType, _INTEGRAL) and nn:
            s["low"], s["high"] = wide[f"mn{i}"], wide[f"mx{i}"]
            s["unique"] = nn <= int(s["high"]) - int(s["low"]) + 1
        stats.append(s)
    open_ = [s for s in stats if s["unique"] and s["non_null"] > 1]
    repeated = _surely_repeated(df, open_) if open_ else set()
    for s in stats:
        s["unique"] = s["unique"] and s["position"] not in repeated

    hashed = [s for s in stats if s["unique"] and s["non_null"]]
    listed = [s for s in stats if s["listed"] and s["non_null"]]
    hash_dir = f"{path}/hashes/part={part}"
    if hashed or listed:
        rows = [f"named_struct('position', {s['position']}, 'v', CAST({s['sql']} AS STRING), 'h1', CAST(NULL AS BIGINT), 'h2', CAST(NULL AS BIGINT), "
                f"'there', {s['sql']} IS NOT NULL)" for s in listed]
        rows += [f"named_struct('position', {s['position']}, 'v', CAST(NULL AS STRING), 'h1', xxhash64({s['sql']}), 'h2', xxhash64(1, {s['sql']}), "
                 f"'there', {s['sql']} IS NOT NULL)" for s in hashed]
        counted = (df.selectExpr(f"inline(array({', '.join(rows)}))").where("there").groupBy("position", "v", "h1", "h2")
                   .agg(F.count(F.lit(1)).alias("n")))
        pairs_dir = f"{path}/pairs/part={part}"
        counted.write.mode("overwrite").parquet(pairs_dir)
        counted = spark.read.schema("position int, v string, h1 bigint, h2 bigint, n bigint").parquet(pairs_dir)
        again = {r.position for r in counted.where("v IS NULL AND n > 1").select("position").distinct().collect()}
        for s in hashed:
            s["unique"] = s["position"] not in again
        keep = [s["position"] for s in hashed if s["unique"]]
        # at most MOST + 1 values of a column come back: the list, or the proof that there are more
        few = (counted.where("v IS NOT NULL").groupBy("position").agg(F.count(F.lit(1)).alias("d"), F.slice(
            F.array_sort(F.collect_list(F.struct("v", "n"))), 1, MOST + 1).alias("values")))
        for r in few.where(F.col("d") <= MOST).collect():
            stats[r.position]["values"] = [(x.v, x.n) for x in r["values"]]
        counted.where(F.col("position").isin(keep) & F.col("v").isNull()).select("position", "h1", "h2").write.mode("overwrite").parquet(hash_dir)
    else:
        spark.createDataFrame([], HASHES).write.mode("overwrite").parquet(hash_dir)
    for s in stats:
        if s["listed"] and not s["non_null"]:
            s["values"] = []
    rows = [tuple(s[f.name] for f in STATE.fields) for s in stats]
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns/part={part}")


def _states(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*STATE.fields, T.StructField("part", T.StringType())])
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/columns")


def _merged(spark: SparkSession, path: str) -> list[dict]:
    """Column statistics of all parts together, as the profiler has them."""
    states = _states(spark, path)
    text = F.col("spark_type").startswith("string")
    rows = (states.groupBy("position").agg(
        F.min("name").alias("name"), F.min("data_type").alias("data_type"), F.min("spark_type").alias("spark_type"),
        F.count_distinct("name", "spark_type").alias("kinds"), F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
        F.sum("emails").alias("emails"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("unique").alias("unique"),
        F.bool_and(F.col("values").isNotNull()).alias("listed"), F.hll_union_agg(F.when(text, F.col("sketch"))).alias("sketch"))
        .withColumn("approx_distinct", F.when(F.col("sketch").isNotNull(), F.hll_sketch_estimate("sketch"))).drop("sketch")
        .orderBy("position").collect())
    odd = [r.name for r in rows if r.kinds != 1]
    if odd:
        raise ValueError(f"the parts do not agree on the columns from {odd[0]!r} on")
    lists = {r.position: r for r in states.select("position", F.explode("values").alias("x")).groupBy("position", "x.v").agg(F.sum("x.n").alias("n"))
             .groupBy("position").agg(F.count(F.lit(1)).alias("d"), F.max("n").alias("most"), F.slice(F.array_sort(F.collect_list("v")), 1, MOST).alias("vs"))
             .collect()}
    open_ = [r.position for r in rows if r.unique and r.non_null > 1 and (r.low is None or r.non_null <= int(r.high) - int(r.low) + 1)]
    again = set(open_)
    if open_:
        parts = [r.part for r in states.select("part").distinct().collect()]  # one value per part
        hashes = (spark.read.schema(HASHES + ", part string").parquet(f"{path.rstrip('/')}/hashes")
                  .where(F.col("part").isin(parts) & F.col("position").isin(open_)))
        again = {r.position for r in hashes.groupBy("position", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                 .select("position").distinct().collect()}
    out = []
    for r in rows:
        is_text, few = r.spark_type.startswith("string"), lists.get(r.position)
        d = few.d if few else 0
        s = {"position": r.position, "name": r.name, "type": r.data_type, "rows": r.rows, "nulls": r.rows - r.non_null, "non_null": r.non_null,
             "unique": r.position in open_ and r.position not in again, "distinct": None, "values": None, "approx_distinct": r.approx_distinct,
             "email_share": r.emails / r.non_null if is_text and r.non_null else None}
        if r.non_null == 1:
            s["unique"] = r.unique
        if is_text and r.listed and d <= MOST:
            s["distinct"] = d
            s["unique"] = d > 0 and few.most == 1
            s["values"] = sorted(few.vs) if d >= IN_LIST_MIN_DISTINCT else None
        out.append(s)
    return out


def merged_profile(spark: SparkSession, path: str) -> DataFrame:
    """What ``profile_columns`` gives for all parts together, from their states."""
    rows = [(s["position"], s["name"], s["type"], s["rows"], s["nulls"], s["unique"], s["distinct"], s["email_share"], s["values"])
            for s in _merged(spark, path)]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def merged_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """What ``suggest_rules`` gives for all parts together."""
    return spark.createDataFrame(suggestions_from_stats(_merged(spark, path)), RULES_SCHEMA)


def parts(spark: SparkSession, path: str) -> list[str]:
    """Ids of the parts whose state is complete."""
    if not path_exists(spark, f"{path.rstrip('/')}/columns"):
        return []
    try:
        return sorted(r.part for r in _states(spark, path).select("part").distinct().collect())
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
