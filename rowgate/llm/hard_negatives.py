"""Hard-negative mining by Fagin's threshold algorithm (operator 12).

Candidates are dealt into blocks of bounded size. A block holds its vectors,
labels and, for every dimension, its rows sorted by that component. Anchors
are dealt into blocks too; a cell is one anchor block against one candidate
block, joined by key.

One search serves both steps. Every anchor has windows ``low <= score <=
high`` over the rows of its own label (step one, the positives: one open
window) or of other labels (step two: a window per positive). In a cell the
lists are walked from the end that the sign of the anchor's component asks
for; each row met for the first time is looked up and scored in full, in
integers. The threshold is the score of a vector made of the components read
last. A window is done once the threshold is strictly below its kth score, or
below its lower end while it has fewer than k rows; at equality an unseen row
could still win a tie by its smaller id.

Cells do not start from nothing: a first wave searches one candidate block,
and the kth scores found there are the lower ends of the windows in all others.
"""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import col, default_partitions, freeing_shuffles, materialize

BLOCK_ROWS = (8192, 65536)  # smallest and largest candidate block
ANCHOR_ROWS = 1024  # anchors of a block
GROUP_ROWS = 256  # anchors that walk the lists together
FIRST_DEPTH = 16
DEPTH_GROWTH = 4
CHUNK_ROWS = 2048  # rows scored at a time

LOW, HIGH = -2 ** 63, 2 ** 63 - 1


def _kind(x: np.ndarray, q: np.ndarray):
    """Number type in which inner products of rows of ``x`` and ``q`` are exact."""
    def reach(v):
        return max(abs(int(v.min())), abs(int(v.max()))) if v.size else 0
    most = reach(x) * reach(q) * max(x.shape[1], 1)
    return np.float64 if most < 2 ** 53 else np.int64 if most < 2 ** 63 else object


def _clipped(score: np.ndarray) -> np.ndarray:
    """Scores as longs; exact ones beyond the range become its ends."""
    if score.dtype == object:
        return np.clip(score, LOW, HIGH).astype(np.int64)
    return score.astype(np.int64)


def search_windows(x, order, labels, ids, q, q_labels, q_ids, pair_of, low, high, k: int, same: bool):
    """Best ``k`` rows of every window: arrays (window, row, score), best first.

    ``order[:, j]`` has the rows by ascending component j; rows ascend by id.
    Window w belongs to anchor ``pair_of[w]`` and takes rows with
    ``low[w] <= score <= high[w]`` whose label is the anchor's (``same``) or
    another one, and whose id is not the anchor's."""
    n, d = x.shape
    kind = _kind(x, q)
    xs, qs = x.astype(kind), q.astype(kind)
    up, down = np.maximum(qs, 0), np.minimum(qs, 0)
    floor = low.copy()  # what a row must reach now: the lower end, then the kth score
    alive = high >= floor  # windows
    seen = np.zeros(n, bool)
    pool = (np.zeros(0, np.int64),) * 3  # window, row, score
    depth, step = 0, FIRST_DEPTH
    while alive.any() and not seen.all():
        to = min(n, depth + step)
        anchors = np.unique(pair_of[alive])
        new = np.zeros(n, bool)
        rising, falling = (up[anchors] > 0).any(axis=0), (down[anchors] < 0).any(axis=0)
        new[order[n - to:n - depth][:, rising]] = True
        new[order[depth:to][:, falling]] = True
        if not (rising | falling).any():  # zero anchors: every score is 0
            new[:] = True
        new &= ~seen
        seen |= new
        rows = np.nonzero(new)[0]
        windows = np.nonzero(alive)[0]
        of = np.searchsorted(anchors, pair_of[windows])
        for lo in range(0, len(rows), CHUNK_ROWS):
            part = rows[lo:lo + CHUNK_ROWS]
            score = _clipped(qs[anchors] @ xs[part].T)
            allowed = (labels[part] == q_labels[anchors, None]) == same
            allowed &= ids[part] != q_ids[anchors, None]
            found = []
            for group in range(0, len(windows), GROUP_ROWS):
                w = windows[group:group + GROUP_ROWS]
                mine = score[of[group:group + GROUP_ROWS]]
                at, c = np.nonzero(allowed[of[group:group + GROUP_ROWS]] & (mine <= high[w, None]) & (mine >= floor[w, None]))
                found.append((w[at], part[c], mine[at, c]))
            pool = tuple(np.concatenate(p) for p in zip(pool, *found))
            if not len(pool[0]):
                continue
            best = np.lexsort((pool[1], ~pool[2], pool[0]))  # ~: descending without overflow
            pool = tuple(p[best] for p in pool)
            first = np.concatenate(([True], pool[0][1:] != pool[0][:-1]))
            rank = np.arange(len(first)) - np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            full = rank == k - 1
            floor[pool[0][full]] = np.maximum(floor[pool[0][full]], pool[2][full])
            pool = tuple(p[rank < k] for p in pool)
        at = np.arange(d)
        bound = _clipped(up[anchors] @ xs[order[n - to], at] + down[anchors] @ xs[order[to - 1], at]) if d else np.zeros(len(anchors))
        alive[windows] = ~(bound[of] < floor[windows])
        depth, step = to, step * DEPTH_GROWTH
    return pool


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    for kind in ("<i2", "<i4"):
        if len(x) == 0 or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x.astype("<i8")


def _grouped(batches):
    """Rows of whole blocks -> (block, dim, arrays of the block's rows), rows ascending by id."""
    import pyarrow as pa

    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    cols = {n: t.column(n).to_numpy() for n in ("block", "dim", "id", "row", "label")}
    vectors = t.column("v").combine_chunks()
    off, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
    order = np.lexsort((cols["row"], cols["id"], cols["dim"], cols["block"]))
    new = (np.diff(cols["block"][order]) != 0) | (np.diff(cols["dim"][order]) != 0)
    cuts = np.nonzero(np.concatenate(([True], new)))[0]
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        which = order[lo:hi]
        d = int(cols["dim"][which[0]])
        yield int(cols["block"][which[0]]), d, which, cols, _small(flat[(off[which][:, None] + np.arange(d)).ravel()]), t


def _pack_candidates(batches):
    import pyarrow as pa

    for block, d, which, cols, x, _ in _grouped(batches):
        lists = np.argsort(x.reshape(len(which), d), axis=0, kind="stable").astype("<u2" if len(which) <= 65536 else "<i4")
        yield pa.RecordBatch.from_pydict({
            "c_block": pa.array([block], pa.int64()), "dim": pa.array([d], pa.int32()), "c_kind": [x.dtype.str],
            "c_ids": [cols["id"][which].astype("<i8").tobytes()], "c_labels": [cols["label"][which].astype("<i8").tobytes()],
            "c_x": [x.tobytes()], "c_order": [lists.tobytes()]})


CANDIDATES = "c_block long, dim int, c_kind string, c_ids binary, c_labels binary, c_x binary, c_order binary"


def _pack_anchors(batches):
    """Anchor rows with their windows -> one row per block and dimension."""
    import pyarrow as pa

    for block, d, which, cols, x, t in _grouped(batches):
        windows = t.column("windows").take(pa.array(which)).combine_chunks()
        flat = windows.flatten()  # sliced to the taken rows
        per = np.diff(windows.offsets.to_numpy())
        parts = {f"w_{c}": flat.field(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in ("no", "pid", "pscore", "low", "high")}
        yield pa.RecordBatch.from_pydict({
            "a_block": pa.array([block], pa.int64()), "dim": pa.array([d], pa.int32()), "a_kind": [x.dtype.str],
            "a_ids": [cols["id"][which].astype("<i8").tobytes()], "a_rows": [cols["row"][which].astype("<i8").tobytes()],
            "a_labels": [cols["label"][which].astype("<i8").tobytes()], "a_x": [x.tobytes()],
            "w_of": [np.repeat(np.arange(len(which)), per).astype("<i8").tobytes()], **{c: [v] for c, v in parts.items()}})


ANCHORS = ("a_block long, dim int, a_kind string, a_ids binary, a_rows binary, a_labels binary, a_x binary, w_of binary, "
           "w_no binary, w_pid binary, w_pscore binary, w_low binary, w_high binary")
FOUND = "row long, id long, label long, no long, pid long, pscore long, other long, score long"


def _cells(k: int, same: bool):
    def run(batches):
        import pyarrow as pa

        def longs(x):
            return np.frombuffer(x, "<i8")
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in b.schema.names}
                d, ids = r["dim"], longs(r["c_ids"])
                x = np.frombuffer(r["c_x"], r["c_kind"]).reshape(len(ids), d)
                order = np.frombuffer(r["c_order"], "<u2" if len(ids) <= 65536 else "<i4").reshape(len(ids), d)
                a_ids, a_rows, a_labels = longs(r["a_ids"]), longs(r["a_rows"]), longs(r["a_labels"])
                q = np.frombuffer(r["a_x"], r["a_kind"]).reshape(len(a_ids), d)
                w = {c: longs(r[f"w_{c}"]) for c in ("of", "no", "pid", "pscore", "low", "high")}
                for lo in range(0, len(a_ids), GROUP_ROWS):
                    hi = min(lo + GROUP_ROWS, len(a_ids))
                    own = np.nonzero((w["of"] >= lo) & (w["of"] < hi))[0]
                    at, row, score = search_windows(x, order, longs(r["c_labels"]), ids, q[lo:hi], a_labels[lo:hi], a_ids[lo:hi],
                                                    w["of"][own] - lo, w["low"][own], w["high"][own], k, same)
                    at = own[at]
                    of = w["of"][at]
                    yield pa.RecordBatch.from_pydict({
                        "row": a_rows[of], "id": a_ids[of], "label": a_labels[of], "no": w["no"][at], "pid": w["pid"][at],
                        "pscore": w["pscore"][at], "other": ids[row], "score": score})
    return run


@contextlib.contextmanager
def _one_row_batches(spark):
    """Rows that hold whole blocks go to Python one by one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _numbers(lo: int, hi: int):
    return F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every window over all cells, with their rank."""
    w = Window.partitionBy("row", "no").orderBy(F.desc("score"), F.asc("other"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(anchors: DataFrame, n_anchors: int, blocks: DataFrame, n_blocks: int, k: int, same: bool) -> DataFrame:
    """Windows of ``anchors`` (id, row, label, dim, v, windows) against all
    candidate blocks: rows ``FOUND`` with rank, k at most per window."""
    spark = anchors.sparkSession
    n_a = max(1, -(-n_anchors // ANCHOR_ROWS))

    def wave(rows, lo, hi, name):
        packed, _ = materialize(
            rows.withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(n_a))).select("block", "dim", "id", "row", "label", "v", "windows")
            .repartition(n_a, "block").mapInArrow(_pack_anchors, ANCHORS), "negatives-anchors")
        cells = n_a * (hi - lo)
        tasks, key = max(cells, default_partitions(spark)), ["dim", "a_block", "c_block"]
        # both sides are dealt by the join's own keys, so each is moved once
        left = blocks.where(F.col("c_block").between(lo, hi - 1)).withColumn("a_block", _numbers(0, n_a)).repartition(tasks, *key)
        right = packed.withColumn("c_block", _numbers(lo, hi)).repartition(tasks, *key)
        with _one_row_batches(spark):
            out, _ = materialize(left.hint("merge").join(right, key).mapInArrow(_cells(k, same), FOUND), name)
        return out

    found = wave(anchors, 0, 1, "negatives-first")
    if n_blocks > 1:
        kth = _best(found, k).where(F.col("rank") == k).select("row", "no", F.col("score").alias("kth"))
        raised = (anchors.select("*", F.explode("windows").alias("w")).drop("windows").withColumn("no", F.col("w.no"))
                  .hint("merge").join(kth, ["row", "no"], "left")
                  .withColumn("w", F.struct("w.no", "w.pid", "w.pscore", F.greatest("w.low", F.coalesce("kth", F.col("w.low"))).alias("low"), "w.high"))
                  .groupBy("row").agg(*[F.any_value(c).alias(c) for c in ("id", "label", "dim", "v")], F.collect_list("w").alias("windows")))
        found = found.unionByName(wave(raised, 1, n_blocks, "negatives-cells"))
    return _best(found, k)


def mine_hard_negatives(df: DataFrame, is_anchor, label=None, positives: int = 5, negatives: int = 10,
                        low_percent: int = 30, high_percent: int = 90, id_col: str = "vec_id",
                        vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for every row with ``is_anchor`` (a condition on ``df``)
    and each of its best ``positives`` rows of the same label, the best
    ``negatives`` rows of another label whose score is at least
    ``low_percent`` and at most ``high_percent`` percent of the positive's.

    The score is the inner product of floor(scale * component); higher comes
    first, ties by smaller id. ``label`` is an expression for the integral
    label (the column, if not given). Rows with a null id, label, vector or
    component or a non-finite one take no part; vectors are compared with
    those of equal length. An anchor leaves out every row of its own id;
    repeated rows count as rows. A negative positive score has an empty window.
    Fewer rows than asked for give fewer, an empty table gives none.
    Components beyond a long count as its ends, and so do scores, which are
    exact up to there whatever the size of a block.
    """
    spark = df.sparkSession
    vector = F.transform(col(vector_col), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    finite = F.forall(col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    label = col(label_col) if label is None else label
    rows = df.where(col(id_col).isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.size(col(vector_col)).alias("dim"), col(id_col).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"), label.cast("long").alias("label"), vector.alias("v"))
    with freeing_shuffles(spark):
        rows, m = materialize(rows, "negatives-rows", F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"))
        size = min(max(m["n"] // 64, BLOCK_ROWS[0]), BLOCK_ROWS[1])
        n_blocks = max(1, -(-m["n"] // size))
        dealt = rows.select(F.pmod(F.xxhash64("id", "row"), F.lit(n_blocks)).alias("block"), "dim", "id", "row", "label", "v")
        blocks, _ = materialize(dealt.repartition(max(n_blocks, default_partitions(spark)), "block")
                                .mapInArrow(_pack_candidates, CANDIDATES), "negatives-blocks")
        open_window = F.array(F.struct(F.lit(0).cast("long").alias("no"), F.lit(0).cast("long").alias("pid"), F.lit(0).cast("long").alias("pscore"),
                                       F.lit(LOW).cast("long").alias("low"), F.lit(HIGH).cast("long").alias("high")))
        anchors = rows.where("anchor").drop("anchor").withColumn("windows", open_window)
        best = _search(anchors, m["anchors"], blocks, n_blocks, positives, same=True)

        low, high = (F.expr(f"CAST(least(greatest({end}(CAST(score AS DECIMAL(20,0)) * CAST({int(p)} AS DECIMAL(10,0)) / 100), {LOW}), {HIGH}) AS BIGINT)")
                     for end, p in (("ceil", low_percent), ("floor", high_percent)))
        windows = (best.withColumn("low", low).withColumn("high", high).where("low <= high")
                   .select("row", F.struct(F.col("rank").cast("long").alias("no"), F.col("other").alias("pid"), F.col("score").alias("pscore"),
                                           "low", "high").alias("w"))
                   .groupBy("row").agg(F.collect_list("w").alias("windows")))  # ``positives`` entries at most
        withw, w = materialize(rows.where("anchor").drop("anchor").hint("merge").join(windows, "row"), "negatives-windows",
                               F.count(F.lit(1)).alias("n"))
        out = _search(withw, w["n"], blocks, n_blocks, negatives, same=False)
    return out.select(F.col("id").alias("anchor_id"), F.col("pid").alias("positive_id"), "rank",
                      F.col("other").alias("negative_id"), F.col("pscore").alias("positive_score"),
                      F.col("score").alias("negative_score"))
