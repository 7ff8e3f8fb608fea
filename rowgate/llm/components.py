"""Connected components of a link table, fully distributed.

Every round each node moves to the neighbour (or itself) of smallest random
rank, and links are rewritten to the nodes' new places; nodes that move away
vanish, so the expected number of nodes falls by a constant factor a round,
also on long chains. When no link is left, the moves are replayed backwards.
Per node only aggregates are shuffled (with map-side combine); the joins are
between written tables, so AQE splits a hub over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import freeing_shuffles, materialize


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, root``: every node that occurs in a link and one node standing
    for its component. Null ends and self links are ignored; repeated links
    count once; no link gives an empty table."""
    spark = links.sparkSession
    with freeing_shuffles(spark):
        def clean(df):
            return (df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())

        edges, m = materialize(clean(links.select(F.col(left).alias("a"), F.col(right).alias("b"))), "cc-links",
                               F.count(F.lit(1)).alias("n"))
        kind = edges.schema["a"].dataType
        moves = []
        while m["n"]:
            turn = F.lit(len(moves))
            rank = lambda c: F.struct(F.xxhash64(F.col(c), turn).alias("h"), F.col(c).alias("id"))
            ends = edges.select(F.col("a").alias("node"), rank("b").alias("r")).unionByName(
                edges.select(F.col("b").alias("node"), rank("a").alias("r")))
            to, _ = materialize(ends.groupBy("node").agg(F.min("r").alias("r"))
                                .select("node", F.least("r", rank("node"))["id"].alias("to")), "cc-moves")
            moves.append(to)
            nxt = (edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
                   .join(to.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
                   .select(F.col("a2").alias("a"), F.col("b2").alias("b")))
            edges, m = materialize(clean(nxt), "cc-links", F.count(F.lit(1)).alias("n"))
        if not moves:
            return spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
        roots = moves.pop().select("node", F.col("to").alias("root"))
        while moves:
            step = moves.pop()
            joined = step.join(roots.select(F.col("node").alias("to"), "root"), "to", "left")
            roots, _ = materialize(joined.select("node", F.coalesce("root", "to").alias("root")), "cc-roots")
    return roots
