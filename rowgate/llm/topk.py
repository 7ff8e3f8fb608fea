"""Exact top-k inner products by Fagin's threshold algorithm (operator 1).

Candidates are dealt into blocks of bounded size; a block holds its vectors
and, for every dimension, the list of its rows sorted by that component.
Queries are dealt into blocks too, and every pair of a query block and a
candidate block is one cell, joined by key and worked on by one task: the
stated query set against all rows, in blocks.

In a cell all queries walk the lists together. A round reads the next ranks
of every list, from the top where the query's component is positive and from
the bottom where it is negative; rows seen for the first time are scored in
full by one matrix product. The threshold is the score of a vector made of
the components read last; a query stops when its threshold is below its kth
score (at equality an unseen row could still win a tie by its smaller id).
Cells send on k rows a query, which one window per query merges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import col, default_partitions, freeing_shuffles, materialize

BLOCK_ROWS = (1024, 65536)  # smallest and largest candidate block
QUERY_ROWS = 1024
FIRST_DEPTH = 16
DEPTH_GROWTH = 4


def _reach(x: np.ndarray) -> int:
    """Largest absolute value, exactly."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def threshold_topk(x: np.ndarray, order: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """Top k rows of ``x`` for every query: (rows, scores), each of shape
    (queries, k), with row -1 where there are fewer. ``order[:, j]`` has the
    rows by ascending component j, ``own`` the range of rows (low, high) that
    a query must leave out; among equal scores the smaller row wins. Scores
    beyond a long count as its ends, whatever the number of rows."""
    n, m = len(x), len(queries)
    d = x.shape[1]
    most = _reach(x) * _reach(queries) * max(d, 1)
    kind = np.float64 if most < 2 ** 53 else np.int64 if most < 2 ** 63 else object
    xs, qs = x.astype(kind), queries.astype(kind)
    up, down = np.maximum(qs, 0), np.minimum(qs, 0)
    # score * n + (n - 1 - row): larger is better, ties by row; in numbers without bound where 64 bits do not hold it
    packed = np.int64 if most * max(n, 1) < 2 ** 62 else object
    low = -2 ** 63 * (1 if packed is np.int64 else 2 * n)
    best = np.full((m, k), low, packed)
    seen = np.zeros(n, bool)
    alive = np.arange(m)
    depth, step = 0, FIRST_DEPTH
    while len(alive) and depth < n:
        to = min(n, depth + step)
        # rows that some live query reads between the two depths; each is scored once for all live queries
        new = np.zeros(n, bool)
        rising, falling = (up[alive] > 0).any(axis=0), (down[alive] < 0).any(axis=0)
        new[order[n - to:n - depth][:, rising]] = True
        new[order[depth:to][:, falling]] = True
        zero = ~(rising | falling)
        if zero.all():  # only zero queries: every score is 0, the first rows win
            new[:] = True
        new &= ~seen
        seen |= new
        rows = np.nonzero(new)[0]
        for lo in range(0, len(rows), 4096):
            part = rows[lo:lo + 4096]
            score = qs[alive] @ xs[part].T
            score = np.clip(score, -2 ** 63, 2 ** 63 - 1) if kind is object else score.astype(np.int64)
            key = score.astype(packed) * n + (n - 1 - part)
            key[(part >= own[alive, :1]) & (part < own[alive, 1:])] = low
            both = np.concatenate((best[alive], key), axis=1)
            best[alive] = (np.partition(both, both.shape[1] - k, axis=1) if packed is np.int64 else np.sort(both, axis=1))[:, -k:]
        if seen.all():
            break
        at = np.arange(d)
        bound = up[alive] @ xs[order[n - to], at] + down[alive] @ xs[order[to - 1], at]
        kth = np.where(best[alive].min(axis=1) == low, -np.inf, best[alive].min(axis=1) // n)
        alive = alive[~(bound < kth).astype(bool)]
        depth, step = to, step * DEPTH_GROWTH
    best = -np.sort(-best, axis=1)
    rows = np.where(best == low, -1, n - 1 - best % n)
    return rows.astype(np.int64), np.where(best == low, 0, best // n).astype(np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    for kind in ("<i2", "<i4"):
        if len(x) == 0 or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x.astype("<i8")


def _pack(batches):
    """Rows (block, dim, id, row, vector) of whole blocks -> one row per block."""
    import pyarrow as pa

    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    block, dim, ids, row = (t.column(i).to_numpy() for i in range(4))
    vectors = t.column(4).combine_chunks()
    off, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
    order = np.lexsort((row, ids, dim, block))
    cuts = np.nonzero(np.concatenate(([True], (np.diff(block[order]) != 0) | (np.diff(dim[order]) != 0))))[0]
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        which = order[lo:hi]
        d = int(dim[which[0]])
        x = _small(flat[(off[which][:, None] + np.arange(d)).ravel()])
        yield pa.RecordBatch.from_pydict(schema=pa.schema([
            ("block", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()),
            *[(c, pa.binary()) for c in ("ids", "rows", "x", "lists")]]), mapping={
            "block": [int(block[which[0]])], "dim": [d], "kind": [x.dtype.str], "ids": [ids[which].astype("<i8").tobytes()],
            "rows": [row[which].astype("<i8").tobytes()], "x": [x.tobytes()],
            "lists": [np.argsort(x.reshape(len(which), d), axis=0, kind="stable").astype("<i4").tobytes()]})


PACKED = "block long, dim int, kind string, ids binary, rows binary, x binary, lists binary"


def _cells(k: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                d = r["dim"]
                c_ids = np.frombuffer(r["c_ids"], "<i8")
                x = np.frombuffer(r["c_x"], r["c_kind"]).reshape(len(c_ids), d)
                order = np.frombuffer(r["c_lists"], "<i4").reshape(len(c_ids), d)
                q_ids, q_rows = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_rows"], "<i8")
                q = np.frombuffer(r["q_x"], r["q_kind"]).reshape(len(q_ids), d)
                own = np.stack([np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")], axis=1)
                top, score = threshold_topk(x, order, q, own, k)
                at, rank = np.nonzero(top >= 0)
                yield pa.RecordBatch.from_pydict({"q_row": q_rows[at], "query_id": q_ids[at], "vec_id": c_ids[top[at, rank]],
                                                  "score": score[at, rank]})
    return run


def _numbers(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def exact_topk(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
               scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row with ``is_query`` (a
    condition on ``df``) the k best of all other rows by the inner product of
    floor(scale * component), ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id; vectors are compared with those of equal
    length. A query leaves out every row of its own id. Repeated rows count
    as rows: each is a candidate, and each that is a query gets its results.
    Components beyond a long count as its ends, and so do scores.
    Fewer than k candidates give fewer rows, an empty table gives none.
    """
    spark = df.sparkSession
    vector = F.transform(col(vector_col), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    finite = F.forall(col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = df.where(col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.coalesce(is_query, F.lit(False)).alias("q"), F.size(col(vector_col)).alias("dim"),
        col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), vector.alias("v"))
    with freeing_shuffles(spark):
        rows, m = materialize(rows, "topk-rows", F.count(F.lit(1)).alias("n"), F.count_if("q").alias("queries"))
        size = min(max(m["n"] // 64, BLOCK_ROWS[0]), BLOCK_ROWS[1])

        def packed(part, count, most, side):
            blocks = max(1, -(-count // most))
            dealt = part.select(F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).alias("block"), "dim", "id", "row", "v")
            out, _ = materialize(dealt.repartition(max(blocks, default_partitions(spark)), "block").mapInArrow(_pack, PACKED),
                                 "topk-blocks")
            other = "q_block" if side == "c" else "c_block"
            return out.select("dim", *[F.col(c).alias(f"{side}_{c}") for c in out.columns if c != "dim"]), blocks, other

        cands, n_c, _ = packed(rows, m["n"], size, "c")
        queries, n_q, _ = packed(rows.where("q"), m["queries"], QUERY_ROWS, "q")
        cells = (cands.withColumn("q_block", _numbers(n_q)).hint("merge")
                 .join(queries.drop("q_lists").withColumn(
                     "c_block", _numbers(n_c)),
                       ["dim", "q_block", "c_block"]))
        tops, _ = materialize(cells.repartition(max(n_q * n_c, default_partitions(spark)), "q_block", "c_block").mapInArrow(
            _cells(k), "q_row long, query_id long, vec_id long, score long"), "topk-cells")
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return (tops.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
