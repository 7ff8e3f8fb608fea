import hashlib
import random

import numpy as np
import pytest

from rowgate.llm.repeats import HEAD, LENGTH, _cut, _name, anchors, remove_repeats, rolling

from .conftest import prose


def brute(rows, length=LENGTH):
    """What must be removed, string by string (a null id is larger than all)."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, float("inf")), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone, end = np.zeros(len(b), bool), 0
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < key(i):
                gone[max(p, end):p + length] = True
                end = p + length
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def planted(n=60):
    """Passages around the limit of 50 bytes, shared by many documents at different places."""
    rng = random.Random(12)
    shared = [prose(rng, 40, 2000)[:k] for k in (49, 50, 51, 75, 130, 200)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(1, 30), 2000) for _ in range(4)]
        for s in rng.sample(shared, 3):
            parts.insert(rng.randint(0, len(parts)), s)
        rows.append((rng.randint(0, 10 ** 6) if i % 7 else i, rng.choice(["", " ", "|"]).join(parts)))
    return rows


@pytest.mark.parametrize("batches, shards", [(1, 1), (4, 2), (5, 1)])
def test_planted_passages(docs, batches, shards):
    rows = planted()
    got = remove_repeats(docs(rows), batches=batches, shards=shards).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_odd_rows(docs, tricky_texts):
    rows = [(i, t[:5000] if t else t) for i, t in enumerate(tricky_texts)]
    rows += [(5, rows[12][1]), (5, rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), (-3, "ab" * 200), (70, "ab" * 100)]
    got = remove_repeats(docs(rows, clashes=True)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_hot_passage_and_kept_bytes(docs):
    rng = random.Random(0)
    hot = prose(rng, 40, 500)
    rows = [(i, prose(rng, 10, 3000) + hot + prose(rng, 10, 3000) if i % 3 else prose(rng, 20, 3000)) for i in range(200)]
    got = remove_repeats(docs(rows, parts=6), with_text=True)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(rows)
    kept = {r.doc_id: bytes(r.kept) for r in got.collect()}
    assert hot.encode() in kept[1] and hot.encode() not in kept[2]


def test_long_run_of_one_byte_in_two_documents(docs):
    n = 3 << 20
    rows = [(0, "-" * n), (1, "one" + "-" * n + "two"), (2, "-" * 40)]
    got = {r.doc_id: r for r in remove_repeats(docs(rows), with_text=True).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(3)] == [(0, 0), (n, 1), (0, 0)]
    assert bytes(got[1].kept) == b"onetwo"


@pytest.mark.parametrize("mask", [-1, (1 << 27) - 1])
def test_memory_of_the_cut_in_a_long_run(mask):
    import tracemalloc

    import pyarrow as pa

    text = b"-" * (1 << 20)
    _, _, _, head, context = anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    names = np.unique(_name(head, context))
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text]), pa.array([names.tolist()]),
                                    pa.array([[mask] * len(names)])], names=["doc_id", "id", "text", "names", "masks"])
    tracemalloc.start()
    out = list(_cut(LENGTH, False)(iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak", peak)
    assert out[0].column(2).to_pylist() == [len(text)] and peak < 300 << 20


def test_empty_table_and_length_bounds(docs):
    assert remove_repeats(docs([])).count() == 0
    assert [tuple(r)[1:4] for r in remove_repeats(docs([None, "", "x"])).orderBy("doc_id").collect()] == [(0, 0, 0), (0, 0, 0),
                                                                                                       (1, 0, 0)]
    with pytest.raises(ValueError):
        remove_repeats(docs(["x"]), length=HEAD)


@pytest.mark.parametrize("length", [25, 32, 50, 80])
def test_other_lengths(docs, length):
    rows = planted(20)
    got = remove_repeats(docs(rows), length=length, batches=2, shards=1).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, length)


def test_every_string_has_an_anchor_and_equal_strings_have_equal_ones():
    rng = random.Random(3)
    same = prose(rng, 60, 100).encode()
    data = np.frombuffer(b"q" * 70 + same + b"w" * 51 + same + b"short", np.uint8)
    offsets = np.array([0, 70 + len(same), len(data) - 5, len(data)])
    text, first, last, head, context = anchors(data, offsets)
    covered = np.zeros(len(data), bool)
    for f, z in zip(first, last):
        covered[f:z + 1] = True
    inside = np.concatenate([np.arange(s, e - LENGTH + 1) for s, e in zip(offsets, offsets[1:]) if e - s >= LENGTH])
    assert covered.sum() == len(inside) and covered[inside].all()
    middle = [{(f - o, h, c) for f, z, h, c in zip(first, last, head, context) if f >= o + 1 and z + LENGTH <= o + len(same) - 1}
              for o in (70, 70 + len(same) + 51)]
    assert middle[0] == middle[1] and middle[0]


def test_rolling_hashes_depend_on_bytes_only():
    data = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabc", np.uint8)
    for size, h in zip((1, 5, 24), rolling(data, (1, 5, 24), np.uint64(0x9E3779B97F4A7C15))):
        assert len(h) == len(data) - size + 1
        assert (h[3:] == h[:-3]).all() and len(set(h.tolist())) == min(3, len(h))


def hot_head(n, rng, phrase="all rights reserved by the com"):
    """One phrase of 30 bytes in every text, between words that differ."""
    pool = prose(rng, 4000, 4000).split()

    def words():
        return " ".join(rng.choices(pool, k=6))
    return [(i, f"{words()} {phrase} {words()}") for i in range(n)]


@pytest.mark.parametrize("hot", [0, 3, 512])
def test_hot_head_with_other_neighbours(docs, monkeypatch, hot):
    from rowgate.llm import repeats
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    rng = random.Random(8)
    rows = hot_head(120, rng)
    passage = rows[3][1]  # a whole text with the phrase in it, again in later documents
    rows += [(200 + i, prose(rng, 5, 900) + passage[i % 9:] + prose(rng, 5, 900)) for i in range(12)] + [(500, rows[7][1]), (2, rows[9][1])]
    rng.shuffle(rows)
    got = remove_repeats(docs(rows, parts=5), batches=3, shards=1).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_a_hot_head_sends_few_contexts(monkeypatch):
    import pyarrow as pa

    from rowgate.llm import repeats
    from rowgate.llm.repeats import ALONE, HIT, INDEX, MARKS, _records
    most = 16
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", most)
    rows = hot_head(20_000, random.Random(9))
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows[lo:lo + 5000]]), pa.array([t for _, t in rows[lo:lo + 5000]])],
                                          names=["id", "text"]) for lo in range(0, len(rows), 5000)]
    sent, alone = {}, 0
    for out in _records(1, LENGTH, 7, ())(iter(batches)):
        for kind, data in zip(out.column(1).to_pylist(), out.column(2).to_pylist()):
            x = np.frombuffer(data, np.int64).reshape(3 if kind == INDEX else 2, -1)
            for h, c in x[:2].T.tolist() if kind == INDEX else []:
                if c == ALONE:
                    alone += 1
                else:
                    sent.setdefault(h, []).append(c)
    assert kind in (HIT, INDEX) and alone > 5000  # contexts that would have met in one task
    assert max(map(len, sent.values())) <= len(batches) * most
    marked = [c for c in sent.values() if set(c) & set(MARKS)]
    assert len(marked) >= 3  # the heads inside the phrase


def test_a_kept_index_takes_a_later_batch(spark, docs):
    from pyspark.sql import functions as F

    from rowgate.llm.repeats import HIT, SuffixIndexFamily, context_blocks
    rng = random.Random(10)
    passage = prose(rng, 60, 900)
    texts = [[f"{prose(rng, 30, 900)} {passage if n in (0, 3) else ''} {prose(rng, 30, 900)}" for _ in range(4)] for n in range(5)]
    family, sizes = SuffixIndexFamily(4), []
    for n, batch in enumerate(texts):
        df = docs([(10 * n + i, t) for i, t in enumerate(batch)]).select(F.col("doc_id").alias("id"), "text")
        hits = {r.id for r in family.add(context_blocks(df, 4)).where(f"kind = {HIT}").select("id").distinct().collect()}
        sizes.append([s for s, _, _ in family.levels])
        assert hits == ({1, 2, 3} if n == 0 else {30, 31, 32, 33} if n == 3 else set())
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    family.close(spark)
