import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgate.llm.topk import exact_topk, threshold_topk

SCHEMA = "vec_id long, embedding array<float>, label int, block long, v string, q string"


def brute(rows, k=5, every=5):
    ok = [(i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in ok:
        if qi % every:
            continue
        best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qi and len(v) == len(q))[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y") for i, v in rows], SCHEMA).repartition(4)


def test_matches_brute_force_with_nulls_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(150)]
    rows += [(i, rows[5][1]) for i in range(200, 240)]  # a very common vector
    rows += [(300, None), (305, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (310, [float("nan")] * 6), (315, [float("inf")] * 6),
             (None, rows[1][1]), (320, [0.0] * 6), (325, []), (330, [1.0, 2.0]), (335, [0.5, 0.25])]
    got = exact_topk(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])]
    got = sorted(map(tuple, exact_topk(frame(spark, rows), F.col("vec_id") == 0, k=2).collect()))
    assert got == sorted([(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 1, 1, 32768), (0, 2, 1, 32768)])
    assert exact_topk(frame(spark, []), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("skew", [0.0, 3.0])
def test_threshold_algorithm_is_exact_and_stops_early(skew):
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 0.2, (3000, 8)) * np.exp(skew * rng.normal(0, 1, (3000, 1)))).astype(np.int64)
    q = x[:40]
    read = []

    class Order(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append((key.stop or len(self)) - (key.start or 0))
            return np.asarray(self).__getitem__(key)
    order = np.argsort(x, axis=0, kind="stable").view(Order)
    own = np.stack([np.arange(40), np.arange(1, 41)], axis=1)
    rows, scores = threshold_topk(x, order, q, own, 5)
    all_scores = q @ x.T
    for i in range(40):
        all_scores[i, i] = -2 ** 60
        want = np.lexsort((np.arange(3000), -all_scores[i]))[:5]
        assert rows[i].tolist() == want.tolist() and scores[i].tolist() == all_scores[i, want].tolist()
    if skew:
        assert sum(read) // 2 < 1500  # ranks read of 3000: lists with few large components end early


@pytest.mark.parametrize("n", [1024, 65536])
@pytest.mark.parametrize("size", [4096, 2 ** 28, 2 ** 40])
def test_large_components_in_small_and_large_blocks(n, size):
    """The number of rows in a block decides nothing; scores beyond a long are its ends."""
    rng = np.random.default_rng(1)
    x = np.floor(256.0 * size * rng.normal(0, 0.4, (n, 8))).astype(np.int64)
    q = x[:3]
    own = np.stack([np.arange(3), np.arange(1, 4)], axis=1)
    rows, scores = threshold_topk(x, np.argsort(x, axis=0, kind="stable"), q, own, 5)
    for i in range(3):
        exact = [max(min(sum(int(a) * int(b) for a, b in zip(q[i], v)), 2 ** 63 - 1), -2 ** 63) for v in x]
        want = sorted((r for r in range(n) if r != i), key=lambda r: (-exact[r], r))[:5]
        assert rows[i].tolist() == want and scores[i].tolist() == [exact[r] for r in want]


def test_one_large_vector_stops_no_query(spark):
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(0, 0.2, 4)]) for i in range(40)] + [(50, [4096.0] * 4)]
    got = exact_topk(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)
