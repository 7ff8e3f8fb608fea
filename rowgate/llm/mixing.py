"""Mixing sources to target weights (operator 6): hierarchical budgeting,
DataFrame and SQL functions only.

The levels (for instance domain, language, source) form a tree whose leaves
hold documents. Weights are propagated from the root: at every node the
budget is split over the children by weight, a child that cannot fill its
share (its leaves hold too few tokens, even over ``max_epochs`` epochs) gets
all it can, and what is left goes to its siblings by weight, again and again.
Only when all siblings are full does the node itself come out full, which its
own parent has already handled: shortages reach siblings before ancestors.
This is water-filling and has a closed form: sorted by capacity per weight,
the children that are full come first, so one window over siblings decides
it, in integer arithmetic.

A leaf's budget is then cut from its seeded epochs: whole epochs first, of
the last one the prefix of the token stream in the order of a seeded hash.
The prefix needs no sort of a leaf: token totals of hash buckets tell which
buckets lie wholly inside the prefix, and only the rows of the one bucket at
its end are ordered. So a source with a third of all rows is aggregated and
filtered like any other and never gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col, freeing_shuffles, materialize

BUCKET_ROWS = 1000  # expected rows of a hash bucket
BROADCAST_LEAVES = 100_000  # most leaves whose plan (a few numbers each) is sent to every executor


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(level: str, weights: Mapping) -> Column:
    out = F.lit(int(weights.get("*", 1)))
    for value, w in weights.items():
        if value != "*":
            out = F.when(F.col(level).eqNullSafe(F.lit(value)), F.lit(int(w))).otherwise(out)
    return out.cast("decimal(12,0)")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping], budget: int,
                 max_epochs: int) -> DataFrame:
    """``leaves`` (the levels, ``tokens``) with ``budget``: the tokens of every leaf.

    ``weights[level][value]`` are whole numbers, ``"*"`` is for values not
    named (1 if absent); a weight of 0 leaves everything below it out. Shares
    are rounded down. A null value is a child like any other.
    """
    names = [f"_level_{i}" for i in range(len(levels))]
    all_weights = [_weight(n, weights.get(level, {})) for n, level in zip(names, levels)]
    open_ = reduce(lambda a, b: a & b, [w > 0 for w in all_weights])
    base = (leaves.select(*[col(level).alias(n) for n, level in zip(names, levels)], "tokens")
            .withColumn("cap", F.when(open_, F.col("tokens") * max_epochs).otherwise(0).cast("decimal(20,0)")))
    plan, zero = None, F.lit(0).cast("decimal(30,0)")
    for i, level in enumerate(names):
        nodes = base.groupBy(*names[:i + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", all_weights[i])
        if plan is None:
            nodes = nodes.withColumn("b", F.least(F.lit(budget).cast("decimal(30,0)"),
                                                  F.sum("cap").over(Window.partitionBy(F.lit(0)))))
        else:
            up = plan.select(*[F.col(n).alias(f"up{n}") for n in names[:i]], F.col("budget").alias("b"))
            nodes = nodes.join(up, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"up{n}")) for n in names[:i]]))
        siblings = Window.partitionBy(*(names[:i] or [F.lit(0)]))
        ratio = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(F.lit(0.0))
        before = siblings.orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, -1)
        full = lambda c: F.sum(F.when(F.col("is_full"), F.col(c)).otherwise(zero)).over(siblings)
        nodes = (nodes.withColumn("ratio", ratio)
                 .withColumn("all_w", F.sum("w").over(siblings))
                 .withColumn("w_before", F.coalesce(F.sum("w").over(before), zero))
                 .withColumn("c_before", F.coalesce(F.sum("cap").over(before), zero))
                 .withColumn("is_full", (F.col("cap") == 0) | (F.col("cap") * (F.col("all_w") - F.col("w_before"))
                                                               <= F.col("w") * (F.col("b") - F.col("c_before"))))
                 .withColumn("w_left", F.col("all_w") - full("w")).withColumn("b_left", F.col("b") - full("cap")))
        share = F.when(F.col("is_full"), F.col("cap").cast("long")).otherwise(F.expr("(b_left * w) div w_left"))
        plan = nodes.select(*names[:i + 1], share.alias("budget"))
    on = reduce(lambda a, b: a & b, [leaves[level].eqNullSafe(plan[n]) for n, level in zip(names, levels)])
    return leaves.join(plan, on).select(leaves["*"], plan["budget"])


def mix(df: DataFrame, levels: Mapping[str, Column] | Sequence[str], weights: Mapping[str, Mapping], share: tuple[int, int],
        max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", tokens: Column | None = None, text_col: str = "text",
        carry: Sequence[str] = ()) -> DataFrame:
    """One row per selected row and epoch: ``doc_id``, the levels, ``epoch``
    (from 1), ``n_tokens``, ``take_tokens`` (less than ``n_tokens`` only for the
    row at the end of a leaf's prefix), ``leaf_tokens``, ``leaf_budget`` and, in
    the struct ``row``, the ``carry`` columns.

    The budget is the fraction ``share`` of all tokens. ``tokens`` counts the
    tokens of a row (words by default; null or negative counts as 0). A row
    without tokens goes with the prefix it falls in. Rows that repeat an id
    fall on the same place of the order, one after another. A null level value
    is a node of its own, a null id ranks like an id. An empty table, or one
    without tokens, selects nothing. Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    named = dict(levels) if isinstance(levels, Mapping) else {n: col(n) for n in levels}
    ids = [f"leaf_{i}" for i in range(len(named))]  # the levels, under names of our own
    count = word_count(col(text_col)) if tokens is None else tokens
    row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(None).cast("boolean")
    picked = df.select(col(id_col).alias("doc_id"), *[c.alias(i) for i, c in zip(ids, named.values())],
                       F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"), row.alias("row"))

    def u(epoch: Column) -> Column:  # a place in the seeded order of an epoch: 60 bits of a hash of the id
        text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")

    with freeing_shuffles(spark):
        rows, m = materialize(picked.withColumn("rid", F.monotonically_increasing_id()), "mix-rows",
                              F.sum("n_tokens").alias("tokens"))
        leaves, k = materialize(rows.groupBy(*ids).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")),
                                "mix-leaves", F.count(F.lit(1)).alias("leaves"))
        small = (lambda d: F.broadcast(d)) if k["leaves"] <= BROADCAST_LEAVES else (lambda d: d)
        budget = (m["tokens"] or 0) * share[0] // share[1]
        plan = leaf_budgets(leaves, ids, {i: weights.get(n, {}) for i, n in zip(ids, named)}, budget, max_epochs).where("budget > 0")
        plan = (plan.withColumn("whole", F.expr("budget div tokens"))
                .withColumn("rest", F.expr("budget - whole * tokens"))
                .withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(BUCKET_ROWS)))).cast("int")))
        plan, _ = materialize(plan.withColumnsRenamed({i: f"p_{i}" for i in ids}), "mix-plan")
        on = reduce(lambda a, b: a & b, [F.col(i).eqNullSafe(F.col(f"p_{i}")) for i in ids])
        placed = rows.drop("row").join(small(plan), on).withColumn("u", u(F.col("whole") + 1))
        bucket = F.when(F.col("bits") == 0, F.lit(0)).otherwise(F.expr("shiftright(u, 60 - bits)")).cast("long")
        sums = (placed.where("rest > 0").withColumn("bucket", bucket).groupBy(*ids, "rest", "bucket")
                .agg(F.sum("n_tokens").alias("t")))
        upto = Window.partitionBy(*ids).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        edge = (sums.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))
                .where("before < rest AND before + t >= rest")
                .select(*[F.col(i).alias(f"e_{i}") for i in ids], F.col("bucket").alias("edge"), "before"))
        on_edge = reduce(lambda a, b: a & b, [F.col(f"p_{i}").eqNullSafe(F.col(f"e_{i}")) for i in ids])
        plan, _ = materialize(plan.join(edge, on_edge, "left").select(*plan.columns, "edge", "before"), "mix-edges")
    placed = rows.join(small(plan), on).withColumn("u", u(F.col("whole") + 1)).withColumn("bucket", bucket)
    epochs = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(1).cast("long"), F.col("whole"))).otherwise(
        F.array().cast("array<bigint>")), F.when(F.col("bucket") < F.col("edge"), F.array(F.col("whole") + 1)).otherwise(
        F.array().cast("array<bigint>")))
    keep = ["doc_id", *[F.col(i).alias(n) for i, n in zip(ids, named)], "epoch", "n_tokens", "take_tokens", F.col("tokens").alias("leaf_tokens"),
            F.col("budget").alias("leaf_budget"), *(["row"] if carry else [])]
    inside = placed.withColumn("epoch", F.explode(epochs)).withColumn("take_tokens", F.col("n_tokens")).select(*keep)
    at_end = Window.partitionBy(*ids).orderBy("u", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    last = (placed.where(F.col("bucket") == F.col("edge"))
            .withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(at_end), F.lit(0)))
            .where("start < rest").withColumn("epoch", F.col("whole") + 1)
            .withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("start"))).select(*keep))
    out = inside.unionByName(last)
    return out.withColumn("epoch", F.col("epoch").cast("int"))


def mixed_documents(df: DataFrame, levels, weights, share, max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Whole rows of ``df`` as ``mix`` selects them, once per epoch; the row at
    the end of a leaf's prefix is kept whole."""
    out = mix(df, levels, weights, share, max_epochs, seed, id_col, None, text_col, carry=df.columns)
    return out.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
