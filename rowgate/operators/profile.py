"""Profiling and rule suggestion.

Column-pruned passes, each a plain aggregation with map-side combine:

1. one wide ``agg``: row count, non-missing counts, email matches, integral
   min/max, and ``approx_count_distinct`` of string columns (an HLL sketch
   never reports more distinct values than there are occupied registers, so
   every column with at most 10 values survives the ``<= 20`` cut);
2. proofs that a column is not unique: more values than ``max - min + 1``, or
   a value that repeats within a bounded number of rows;
3. low-cardinality columns: one pass of (column, value) counts, which leaves a
   handful of rows per task;
4. columns that may still be unique: one pass of (column, 64-bit hash) counts,
   16 bytes a value however long the values are. No repeated hash proves a
   column unique; for repeated ones the real values with those hashes decide.

A NaN is a missing value, like NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.fixed import (
    EMAIL_REGEX,
    EMAIL_SHARE_THRESHOLD,
    IN_LIST_MAX_DISTINCT,
    IN_LIST_MIN_DISTINCT,
    RULE_EMAIL,
    RULE_NOT_NULL,
    RULE_ONE_OF,
    RULE_UNIQUE,
)
from ..functions.grammar import format_value_list
from ..functions.sql import quote_ident, quote_str
from ..functions.types import type_label
from ..plans.shared import materialize, scratch_scope
from ..sources.rules_io import RULES_SCHEMA
from .prepare import prepare

RSD = 0.05
LOWCARD_SKETCH_LIMIT = 2 * IN_LIST_MAX_DISTINCT
PROOF_ROWS = 20_000  # rows in which a repeated value is looked for before whole columns are
PROOF_HASHES = 100  # repeated hashes whose real values are looked at first
BATCH_COLUMNS = 48

_SIMPLE = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

PROFILE_SCHEMA = T.StructType([
    T.StructField("column_position", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("row_count", T.LongType(), False),
    T.StructField("null_count", T.LongType(), False),
    T.StructField("is_unique", T.BooleanType(), False),
    T.StructField("small_distinct", T.IntegerType(), True),
    T.StructField("email_share", T.DoubleType(), True),
    T.StructField("values", T.ArrayType(T.StringType()), True),
])


def _present(f: T.StructField) -> str:
    """The column with NaN as NULL."""
    c = quote_ident(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return f"nullif({c}, CAST('NaN' AS {f.dataType.simpleString().upper()}))"
    return c


def _pairs(df: DataFrame, cols: list[dict], value: str) -> DataFrame:
    """``(pos, v)`` of all non-missing values of the columns, one scan."""
    parts = ", ".join(f"named_struct('pos', {s['position']}, 'v', {value.format(c=s['sql'])}, 'nn', {s['sql']} IS NOT NULL)"
                      for s in cols)
    return df.selectExpr(f"inline(array({parts}))").where("nn").select("pos", "v")


def _surely_repeated(df: DataFrame, cols: list[dict], rows: int = PROOF_ROWS) -> set[int]:
    """Columns in which a value repeats within some ``rows`` rows, by 128 bits
    of the typed value (two timestamps may share one text at a clock change)."""
    sample = df.selectExpr(*[f"CASE WHEN {s['sql']} IS NOT NULL THEN concat(CAST(xxhash64({s['sql']}) AS STRING), ':', "
                             f"CAST(xxhash64(1, {s['sql']}) AS STRING)) END AS c{s['position']}"
                             for s in cols]).limit(rows)
    lists = [f"collect_list(c{s['position']})" for s in cols]
    row = sample.selectExpr(*[f"size({x}) > size(array_distinct({x})) AS r{s['position']}" for x, s in zip(lists, cols)]).first()
    return {s["position"] for s in cols if row[f"r{s['position']}"]}


def _unique_columns(df: DataFrame, cols: list[dict]) -> set[int]:
    """Positions of the columns without a repeated value, exactly."""
    with scratch_scope(df.sparkSession):
        hashes = _pairs(df, cols, "xxhash64({c})").groupBy("pos", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        twice, _ = materialize(hashes.select("pos", "v"), "profile-hashes")
        found = {r["pos"]: r["n"] for r in twice.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()}
        out = {s["position"] for s in cols} - set(found)
        for s in cols:
            if s["position"] not in found:
                continue
            own = twice.where(F.col("pos") == s["position"]).select("v")
            rows = df.selectExpr(f"{s['sql']} AS k", f"xxhash64({s['sql']}) AS v").where("k IS NOT NULL")
            few = [r["v"] for r in own.limit(PROOF_HASHES).collect()]
            steps = [rows.where(F.col("v").isin(few))]
            if found[s["position"]] > PROOF_HASHES:
                steps.append(rows.join(own, "v", "left_semi"))
            if not any(x.groupBy("k").count().where("count > 1").limit(1).count() for x in steps):
                out.add(s["position"])  # all were collisions of the hash
    return out


def _profile(df: DataFrame, rsd: float = RSD, batch_columns: int = BATCH_COLUMNS) -> list[dict]:
    """Column statistics. Wide tables are profiled ``batch_columns`` columns
    at a time: with a columnar source each batch reads only its own columns,
    so every column is still read once, and each aggregation stays small
    enough for whole-stage code generation."""
    fields = df.schema.fields
    if len(fields) > batch_columns:
        out = []
        for start in range(0, len(fields), batch_columns):
            names = [quote_ident(f.name) for f in fields[start:start + batch_columns]]
            for st in _profile(df.select(*names), rsd, batch_columns):
                st["position"] += start
                out.append(st)
        return out
    # SQL text, handed over in one call (same plan as Column objects)
    aggs = ["count(1) AS __rows"]
    for i, f in enumerate(fields):
        c = _present(f)
        aggs.append(f"count({c}) AS nn{i}")
        if isinstance(f.dataType, T.StringType):
            aggs.append(f"approx_count_distinct({c}, {rsd}) AS ad{i}")
            # the pattern needs an "@": a cheap contains() spares most rows the regex
            aggs.append(f"count_if(contains({c}, '@') AND {c} RLIKE {quote_str(EMAIL_REGEX)}) AS em{i}")
        if isinstance(f.dataType, _INTEGRAL):
            aggs += [f"CAST(min({c}) AS DECIMAL(38,0)) AS mn{i}", f"CAST(max({c}) AS DECIMAL(38,0)) AS mx{i}"]
    wide = df.selectExpr(*aggs).first()
    rows = int(wide["__rows"])

    stats = []
    for i, f in enumerate(fields):
        nn = int(wide[f"nn{i}"])
        st = {"position": i, "name": f.name, "sql": _present(f), "type": type_label(f.dataType), "dtype": f.dataType,
              "rows": rows, "nulls": rows - nn, "non_null": nn, "unique": nn == 1 and isinstance(f.dataType, _SIMPLE),
              "distinct": None, "email_share": None, "values": None}
        st["unique_cand"] = isinstance(f.dataType, _SIMPLE) and nn > 1
        if isinstance(f.dataType, _INTEGRAL) and nn > 1:
            st["unique_cand"] = nn <= int(wide[f"mx{i}"]) - int(wide[f"mn{i}"]) + 1
        elif isinstance(f.dataType, T.BooleanType):
            st["unique_cand"] = nn == 2
        st["low_cand"] = False
        if isinstance(f.dataType, T.StringType):
            st["email_share"] = (int(wide[f"em{i}"]) / nn) if nn > 0 else None
            st["low_cand"] = nn >= IN_LIST_MIN_DISTINCT and int(wide[f"ad{i}"]) <= LOWCARD_SKETCH_LIMIT
            st["distinct"] = nn if nn <= 1 else None
        stats.append(st)

    low = [s for s in stats if s["low_cand"]]
    if low:
        counted = _pairs(df, low, "{c}").groupBy("pos", "v").agg(F.count(F.lit(1)).alias("n"))
        # at most 11 values a column reach the driver: 10, or proof that there are more
        few = counted.groupBy("pos").agg(F.count(F.lit(1)).alias("d"), F.max("n").alias("most"),
                                         F.slice(F.array_sort(F.collect_list("v")), 1, IN_LIST_MAX_DISTINCT + 1).alias("vs"))
        for r in few.collect():
            s = next(x for x in low if x["position"] == r["pos"])
            s["unique"], s["unique_cand"] = r["most"] == 1, False
            if r["d"] <= IN_LIST_MAX_DISTINCT:
                s["distinct"] = r["d"]
                if r["d"] >= IN_LIST_MIN_DISTINCT:
                    s["values"] = sorted(r["vs"])
    cand = [s for s in stats if s["unique_cand"]]
    if cand:
        repeated = _surely_repeated(df, cand)
        cand = [s for s in cand if s["position"] not in repeated]
    if cand:
        unique = _unique_columns(df, cand)
        for s in cand:
            s["unique"] = s["position"] in unique
            if s["unique"] and isinstance(s["dtype"], T.StringType) and s["non_null"] <= IN_LIST_MAX_DISTINCT:
                s["distinct"] = s["non_null"]
    return stats


def profile_columns(df: DataFrame, rsd: float = RSD, prepared: bool = False,
                    batch_columns: int = BATCH_COLUMNS) -> DataFrame:
    """D2-D5 per column: nulls, exact uniqueness, exact distinct count of
    string columns with at most 10 values, share of email-shaped values."""
    if not prepared:
        df = prepare(df)
    stats = _profile(df, rsd, batch_columns)
    rows = [(s["position"], s["name"], s["type"], s["rows"], s["nulls"], s["unique"], s["distinct"],
             s["email_share"], s["values"]) for s in stats]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def suggestions_from_stats(stats: list[dict]) -> list[tuple[str, str, str]]:
    out: list[tuple[str, str, str]] = []
    for s in stats:
        name, label = s["name"].strip(), s["type"]
        if s["nulls"] == 0:
            out.append((name, label, RULE_NOT_NULL))
        if s["non_null"] > 0 and s["unique"]:
            out.append((name, label, RULE_UNIQUE))
        if label == "string":
            if s["values"] is not None:
                out.append((name, label, RULE_ONE_OF.format(values=format_value_list(s["values"]))))
            share = s["email_share"]
            if share is not None and share > EMAIL_SHARE_THRESHOLD:
                out.append((name, label, RULE_EMAIL))
    return out  # D6: names that collide are refused before, so no suggestion arises twice


def suggest_rules(df: DataFrame, fraction: float | None = None, seed: int = 42, rsd: float = RSD,
                  batch_columns: int = BATCH_COLUMNS) -> DataFrame:
    """Rules proposed from a table (or a ``fraction`` sample of it), in
    column order; per column: not null, unique, in-list, email.

    Names are stripped and strings trimmed first, the way the checks see
    the data, so re-applying the rules to the same data finds no failures.
    """
    if df.isStreaming:
        raise ValueError("suggest_rules needs a batch DataFrame (profile a sample of the stream's table)")
    if fraction is not None:
        df = df.sample(fraction=fraction, seed=seed)
    stats = _profile(prepare(df), rsd, batch_columns)
    return df.sparkSession.createDataFrame(suggestions_from_stats(stats), RULES_SCHEMA)
