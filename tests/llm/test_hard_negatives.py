import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgate.llm import hard_negatives
from rowgate.llm.hard_negatives import mine_hard_negatives, search_windows

SCHEMA = "vec_id long, embedding array<float>, label int, block long, row string, v string"
LONG = 2 ** 63


def brute(rows, every=5, p=3, k=4, low=30, high=90):
    ok = [(i, l, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v, l in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, l, [max(min(c, LONG - 1), -LONG) for c in v]) for i, l, v in ok]
    out = []
    for ai, al, a in ok:
        if ai % every:
            continue
        scored = sorted((-max(min(sum(x * y for x, y in zip(a, v)), LONG - 1), -LONG), i, l) for i, l, v in ok if i != ai and len(v) == len(a))
        for s, pi, _ in [x for x in scored if x[2] == al][:p]:
            inside = [(n, i) for n, i, l in scored if l != al and low * -s <= 100 * -n <= high * -s][:k]
            out += [(ai, pi, r + 1, i, -s, -n) for r, (n, i) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "x", "y") for i, v, l in rows], SCHEMA).repartition(4)


def mined(df, p=3, k=4):
    return sorted(tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % 5 == 0, positives=p, negatives=k).collect())


def vectors(n, d, seed, labels=4, skew=0.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (labels, d))
    return [(i, [float(np.float32(x)) for x in (centre[i % labels] + rng.normal(0, 0.3, d)) * np.exp(skew * rng.normal())], i % labels)
            for i in range(n)]


def test_matches_brute_force_with_nulls_ties_and_odd_rows(spark):
    rows = vectors(150, 6, 3)
    rows += [(i, rows[5][1], 1 + i % 2) for i in range(200, 240)]  # a very common vector, equal scores
    rows += [(300, None, 1), (305, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (310, [float("nan")] * 6, 1), (315, [float("inf")] * 6, 1),
             (None, rows[1][1], 1), (320, [0.0] * 6, 1), (325, [], 1), (326, [], 2), (330, [1.0, 2.0], 0), (331, [1.0, 1.0], 0),
             (332, [0.5, 0.25], 1), (340, rows[7][1], None), (345, rows[7][1], 77)]
    got = mined(frame(spark, rows))
    assert got == brute(rows) and len(got) > 50


@pytest.mark.parametrize("skew", [0.0, 2.0])
def test_several_blocks_and_two_waves(spark, monkeypatch, skew):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", (64, 64))
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 16)
    rows = vectors(400, 5, 8, skew=skew)
    assert mined(frame(spark, rows)) == brute(rows)


def test_scores_beyond_doubles_and_longs(spark):
    """Components of 4096, of 2^45 and of 2^70: exact up to the ends of a long, in small and in large blocks."""
    for size in (4096.0, 2.0 ** 20, 2.0 ** 45, 2.0 ** 70):
        rows = [(i, [float(np.float32(x * size)) for x in v], l) for i, v, l in vectors(60, 4, 9)]
        assert mined(frame(spark, rows)) == brute(rows)


def test_repeated_rows_one_label_and_empty_table(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.5, 0.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2)]
    assert mined(frame(spark, rows)) == brute(rows)
    assert mined(frame(spark, [(i, [1.0], 1) for i in range(10)])) == []
    assert mined(frame(spark, [])) == []


def test_the_threshold_ends_the_search_early():
    rng = np.random.default_rng(0)
    n, d = 4000, 8
    x = np.floor(256 * rng.normal(0, 0.2, (n, d)) * np.exp(2.5 * rng.normal(0, 1, (n, 1)))).astype(np.int64)
    q = x[np.argsort(-np.abs(x).sum(axis=1))[:20]]
    labels, ids = rng.integers(0, 3, n), np.arange(n)
    read = []

    class Order(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop - (key.start or 0))
            return np.asarray(self).__getitem__(key)
    order = np.argsort(x, axis=0, kind="stable").view(Order)
    low, high = np.full(20, -2 ** 63), np.full(20, 2 ** 63 - 1)
    w, row, score = search_windows(x, order, labels, ids, q, labels[:20], np.full(20, -1), np.arange(20), low, high, 5, True)
    for i in range(20):
        s = np.where(labels == labels[i], x @ q[i], -2 ** 62)
        want = np.lexsort((ids, -s))[:5]
        assert row[w == i].tolist() == want.tolist() and score[w == i].tolist() == s[want].tolist()
    assert sum(read) < n  # of 2 n ranks
