import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from rowgate.llm import simhash
from rowgate.llm.components import components
from rowgate.llm.simhash import blocks_for, close_pairs, drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, close):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a in nodes:
        for b in nodes:
            if a != b and close(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_match_brute_force(docs, tricky_texts):
    rows = list(enumerate(tricky_texts))
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert all(fingerprint((t or "").encode()) == fps[i] for i, t in rows)
    want = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs(rows, clashes=True)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_one_row_of_each_component_stays(docs, tricky_texts):
    rows = list(enumerate(tricky_texts)) + [(None, "one two"), (0, None), (5, tricky_texts[5]), (900, "quite different words")]
    left = drop_near_duplicates(docs(rows, clashes=True))
    assert left.columns == docs(rows, clashes=True).columns
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = set(brute_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 3).values())
    assert left.count() == len(groups)
    got = Counter(plain_fingerprint(r.text) for r in left.collect())
    assert max(got.values()) == 1
    assert near_duplicates(docs([])).count() == 0 and drop_near_duplicates(docs([])).count() == 0


def fingerprints_with_clusters(rng, n):
    centres = rng.integers(0, 2 ** 63, 20, dtype=np.uint64)
    noise = np.zeros(n, np.uint64)
    for _ in range(4):
        noise ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(np.concatenate((centres[rng.integers(0, 20, n)] ^ noise, rng.integers(0, 2 ** 63, n, dtype=np.uint64))))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_bit_sliced_pairs_are_all_close_pairs(radius):
    rng = np.random.default_rng(radius)
    fps = fingerprints_with_clusters(rng, 400)
    group = np.sort(rng.integers(0, 3, len(fps)))
    got = set()
    for i, j in close_pairs(fps, group, radius, chunk=100):
        got |= set(zip(i.tolist(), j.tolist()))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j and group[i] == group[j]}
    assert got == want


def test_pairs_of_near_copies_come_in_bounded_runs():
    """All pairs of a group of near copies are links; a task holds some of them at a time."""
    fps = np.arange(1500, dtype=np.uint64) << np.uint64(1)
    sizes = [len(i) for i, _ in close_pairs(fps, np.zeros(1500, np.int64), 11)]
    assert sum(sizes) == 1500 * 1499 // 2 and max(sizes) <= 64 * simhash.HIT_BLOCKS <= 1 << 18


@pytest.mark.parametrize("bucket, blocks", [(1024, None), (8, None), (1024, 6)])
def test_buckets_and_tiles_lose_no_link(spark, bucket, blocks):
    """Small buckets force tiles, more blocks force wider keys."""
    fps = fingerprints_with_clusters(np.random.default_rng(1), 300)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = fingerprint_links(df, len(fps), 3, bucket, blocks)
    roots = {r.node: r.root for r in components(links).collect()}
    signed = [int(f) for f in fps.view(np.int64)]
    mask = (1 << 64) - 1
    want = brute_components(signed, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    assert {frozenset(n for n in signed if roots.get(n, n) == r) for r in {roots.get(n, n) for n in signed}} == \
        {frozenset(n for n in signed if want[n] == r) for r in set(want.values())}


def test_dense_bucket_is_not_sent_once_a_tile(spark, monkeypatch):
    """Fingerprints that share 16 bits: rows sent to the tasks stay in proportion to them."""
    rng = np.random.default_rng(3)
    n = 4000
    fps = [int(f) for f in np.unique(rng.integers(0, 2 ** 47, n) << 16)]

    def counting(radius):
        def run(batches):
            import pyarrow as pa

            rows = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([rows])], names=["u", "v"])
        return run
    monkeypatch.setattr(simhash, "_forest_of_buckets", counting)
    sent = sum(r.u for r in fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), n, 3, 16).collect())
    assert sent <= 100 * n


def test_task_compares_some_buckets_at_a_time():
    import pyarrow as pa

    fps = np.arange(64, dtype=np.int64)
    taken = []

    def batches():
        for k in range(50):  # two batches a bucket
            taken.append(k)
            keys = [pa.array(np.full(32, v)) for v in (0, k // 2, 0, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(fps[k % 2 * 32:][:32] + 1024 * (k // 2)), *keys],
                                             names=["fp", "choice", "bits", "x", "y"])
    first, got = None, []
    for out in simhash._forest_of_buckets(1, 200)(batches()):
        first = first or len(taken)
        got += list(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    assert first <= 10
    assert len(got) == 25 * 63 and all(u // 1024 == v // 1024 for u, v in got)


def test_blocks_follow_the_input():
    assert blocks_for(1000, 3) == 4 and blocks_for(10 ** 10, 3) > 4


def test_components_of_chain_star_and_cycle(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1050)] + [(5000, 5001), (5001, 5002), (5002, 5000)]
    df = spark.createDataFrame(links + [(None, 3), (7000, 7000), (1, 0)], "u long, v long")
    got = {}
    for r in components(df).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(201)), list(range(1000, 1050)), [5000, 5001, 5002]]
    assert all(root in nodes for root, nodes in got.items())
    assert components(df.limit(0)).count() == 0
