"""Removal of repeated passages with a logarithmic family of sparse suffix
arrays (operator 7).

Wanted: every byte covered by a string of ``length`` bytes that also starts
in a document with a smaller id.

Sampled suffixes. Of the heads (``HEAD`` bytes) inside any string of
``length`` bytes the one with the smallest hash is its anchor, so equal
strings have equal anchors at equal places, and one suffix in fourteen is
enough to find every match. An anchor stands for a run of strings; the bytes
they cover are its context. Equal contexts are equal in all their strings.

Index family. Documents come in batches of ascending id. A batch gets its
suffix array: its distinct contexts as (head hash, context hash, smallest
id), sorted, in hash partitions. It is merge-scanned against the arrays of
the earlier batches: an equal context there (or of a smaller id in the batch)
settles all strings of the anchor; an equal head with another context means
that only some strings may match. Levels of equal size are merged in the same
pass, so n batches leave O(log n) levels and an entry is rewritten O(log n)
times. The index is built for one shard of the head hashes after the other,
which bounds scratch space.

Partial matches. Contexts that share a head with another one are few; their
strings are compared one by one: grouped by a 128-bit hash, the smallest id
of each string settles it.

Hot passages: a task sends a context, or string, once, with the smallest id
it has seen; the other rows of it in the task are settled there. So a passage
that a third of all documents hold is one row a task, however many documents.

Hot heads: a phrase of 24 to 49 bytes with other neighbours everywhere has a
context per document. A batch of rows that sees more than ``HOT_CONTEXTS`` of
them, in several documents, knows already that they have to be compared string
by string. It sends each under a key of its own, where only equal contexts
meet, and for the head two markers (smallest and largest id), which tell
whoever else has the head that it has several contexts.

Anchors of all texts are found in one pass. Their contexts travel, and are
indexed, as one binary block per batch of rows and partition, not as rows.
Equal contexts are told by a 64-bit hash of the head and one of
the whole context, equal strings by two 64-bit hashes with different bases.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, col, default_partitions, delete_path, freeing_shuffles, materialize, ragged, scratch_path, \
    text_buffer

LENGTH = 50
HEAD = 24
BATCHES = 4
SHARDS = 2  # shards of head hashes that are indexed one after another
WINDOW_SHARDS = 2
SLICE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20  # texts whose contexts are sorted together
CUT_CONTEXTS = 1 << 14  # partly repeated contexts whose strings are laid out at once
TASK_ROWS = 1_000_000
NO_ID = (1 << 63) - 1  # a null id: larger than all others
HOT_CONTEXTS = 512  # contexts of one head, in one batch of rows and ids, beyond which the head is hot
MARKS = (1, 2)  # context hashes of markers
ALONE = 3  # context hash of a hot head's context, whose name is in the head's place
HIT, PARTIAL, INDEX = 0, 1, 2
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(data: np.ndarray, sizes: tuple[int, ...], base: np.uint64) -> list[np.ndarray]:
    """Polynomial hashes of all runs of each size, by doubling."""
    n, out = len(data), {s: (None, 0) for s in sizes}
    cur, span = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1
    power = np.array([base], np.uint64)  # base ** span
    while True:
        for s in sizes:
            if s & span and n >= s:
                acc, width = out[s]
                if acc is None:
                    out[s] = (cur, span)
                else:
                    m = n - width - span + 1
                    out[s] = (acc[:m] * power + cur[width:width + m], width + span)
        if span * 2 > max(sizes) or span * 2 > n:
            break
        cur = cur[:-span] * power + cur[span:]
        power = power * power
        span *= 2
    return [out[s][0] if out[s][0] is not None and n >= s else np.zeros(0, np.uint64) for s in sizes]


def _slide(v: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every run of ``width`` values."""
    n, span = len(v), 1
    cur = v
    while span * 2 <= width:
        cur = pick(cur[:-span], cur[span:])
        span *= 2
    m = n - width + 1
    return cur[:m] if span == width else pick(cur[:m], cur[width - span:width - span + m])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Anchors of texts laid end to end: (text, first string, last string,
    head hash, context hash). Strings are places of their first byte."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    head, full = rolling(data, (HEAD, length), BASES[0])
    width = length - HEAD + 1
    v = np.maximum(((head ^ (head >> np.uint64(29))) * BASES[1] >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    least = _slide(v, width, np.minimum)  # least[p]: of the string at p
    left = np.repeat(offsets[1:], np.diff(offsets))[:len(least)] - np.arange(len(least))
    least[left < length] = 0  # strings that cross the end of a text
    padded = np.concatenate((np.zeros(width - 1, np.uint32), least, np.zeros(len(v) - len(least), np.uint32)))
    at = np.nonzero(_slide(padded, width, np.maximum) == v)[0]
    # The strings of an anchor lie in one run of equal minima; look back from the run at the anchor.
    begin = np.nonzero(np.concatenate(([True], least[1:] != least[:-1])))[0]
    end = np.append(begin[1:], len(least)) - 1
    run = np.searchsorted(begin, np.minimum(at, len(least) - 1), side="right") - 1
    value, wrong = v[at], np.arange(len(at))
    while len(wrong):
        wrong = wrong[least[begin[run[wrong]]] != value[wrong]]
        run[wrong] -= 1
    first, last = np.maximum(begin[run], at - (width - 1)), np.minimum(end[run], at)
    text = np.searchsorted(offsets, at, side="right") - 1
    shape = ((last - first) * length + (at - first)).astype(np.uint64)
    context = _mix(_mix(full[first] + BASES[1]) + full[last] * np.uint64(3) + shape * BASES[1])
    return text, first, last, _mix(head[at]), context


def _name(head: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One number for a context, unique inside a document."""
    return (_mix(head * np.uint64(5)) ^ context).view(np.int64)


def _ids(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _first_of(*keys):
    """(order, start of its run per sorted row, whether a run starts) for rows
    sorted by all keys, runs by all but the last. Most first keys are alone, so
    one plain sort and a full one of the rest is enough."""
    order = np.argsort(keys[0])
    n = len(order)
    s = keys[0][order]
    tied = np.zeros(n, bool)
    tied[1:] = s[1:] == s[:-1]
    tied[:-1] |= tied[1:]
    rest = order[tied]
    order[tied] = rest[np.lexsort([k[rest] for k in keys[::-1]])]
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys[:-1]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else order, new


def _split_of(h: np.ndarray, shards: int, parts: int) -> np.ndarray:
    """Shard and partition of a 64-bit hash as one number, in the smallest type (which sorts fastest)."""
    u = h.view(np.uint64)
    at = (u >> np.uint64(40)) % np.uint64(shards) * np.uint64(parts) + (u >> np.uint64(3)) % np.uint64(parts)
    return at.astype(np.uint16 if shards * parts <= 65536 else np.int64)


def _blocks(pa, batch: int, shards: int, parts: int, kind: int, *columns: np.ndarray):
    """Rows of int64 ``columns``, dealt by the first, as one binary block per shard and partition."""
    at = _split_of(columns[0], shards, parts)
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at, minlength=shards * parts))
    stacked = np.stack([c[order] for c in columns])
    some = np.nonzero(np.diff(ends, prepend=0))[0]
    return pa.RecordBatch.from_pydict({
        "part": pa.array((some % parts).astype(np.int32)), "kind": pa.array(np.full(len(some), kind, np.int32)),
        "data": pa.array([np.ascontiguousarray(stacked[:, (ends[p - 1] if p else 0):ends[p]]).tobytes() for p in some], pa.binary()),
        "shard": pa.array((some // parts).astype(np.int32)), "batch": pa.array(np.full(len(some), batch, np.int32))})


def _records(shards: int, length: int, partitions: int, bounds):
    """Task function: (id, text) -> blocks by shard and batch of ids (batch i
    reaches up to ``bounds[i]``): contexts (head, context, id), once a batch of
    rows with the smallest id, and hits (name, id): other ids that hold one."""
    edges = np.array(list(bounds), np.int64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = _ids(b.column(0))
            data, off = text_buffer(b.column(1))
            for begin_row, end_row in byte_slices(off, BATCH_BYTES):
                yield from work(pa, ids[begin_row:end_row], data, off[begin_row:end_row + 1])

    def work(pa, ids, data, off):
        parts = []
        for lo, hi in byte_slices(off, SLICE_BYTES):
            part = off[lo:hi + 1]
            text, _, _, head, context = anchors(data[part[0]:part[-1]], part - part[0], length)
            parts.append(np.stack([head.view(np.int64), context.view(np.int64), ids[lo:hi][text]]))
        if not parts:
            return
        every = np.concatenate(parts, axis=1)
        which = np.searchsorted(edges, every[2], side="left")
        for i in range(len(edges) + 1):
            h, c, d = every[:, which == i] if len(edges) else every
            if not len(h):
                continue
            order, start, new = _first_of(h, c, d)
            h, c, d = h[order], c[order], d[order]
            hit = d > d[start]
            hit[1:] &= (d[1:] != d[:-1]) | new[1:]
            name = _name(h.view(np.uint64), c.view(np.uint64))
            yield _blocks(pa, i, shards, partitions, HIT, name[hit], d[hit])
            # heads that have many contexts here: their rows of the sort lie side by side
            begin = np.nonzero(np.concatenate(([True], h[1:] != h[:-1])))[0]
            low, high = np.minimum.reduceat(d, begin), np.maximum.reduceat(d, begin)
            hot = (np.add.reduceat(new, begin, dtype=np.int64) > HOT_CONTEXTS) & (low != high)
            in_hot = np.repeat(hot, np.diff(np.append(begin, len(h))))
            alone, sent, marks = new & in_hot, new & ~in_hot, h[begin[hot]]
            yield _blocks(pa, i, shards, partitions, INDEX, np.concatenate((h[sent], marks, marks, name[alone])), np.concatenate((
                c[sent], np.full(len(marks), MARKS[0]), np.full(len(marks), MARKS[1]), np.full(alone.sum(), ALONE))),
                np.concatenate((d[sent], low[hot], high[hot], d[alone])))
    return run


BLOCKS = "part int, kind int, data binary, shard int, batch int"


def _merge_scan(keep_levels: frozenset, insert: bool):
    """Task function over whole partitions of blocks (part, kind, data, level):
    level -1 is the new batch, others are index levels; ``keep_levels`` are
    merged with the batch into the new level. Hits and partial contexts come
    out as rows, the new level as one sorted block."""
    special = [*MARKS, ALONE]

    def run(batches):
        import pyarrow as pa

        got: dict = {HIT: [], INDEX: []}
        levels, place = [], 0
        for batch in batches:
            for part, kind, data, level in zip(*(batch.column(i).to_pylist() for i in range(4))):
                place = part
                x = np.frombuffer(data, np.int64).reshape(3 if kind == INDEX else 2, -1)
                got[kind].append(x)
                if kind == INDEX:
                    levels.append(np.full(x.shape[1], level))
        out = [(np.full(x.shape[1], HIT), x[0], x[1]) for x in got[HIT]]  # kind, name, id
        put = None
        if levels:
            h, c, d = np.concatenate(got.pop(INDEX), axis=1)
            level = np.concatenate(levels)
            order, start, new = _first_of(h, c, d)
            h, c, d, level = h[order], c[order], d[order], level[order]
            real, alone = ~np.isin(c, special), c == ALONE
            name = np.where(alone, h, _name(h.view(np.uint64), c.view(np.uint64)))
            hit = (level < 0) & (d > d[start]) & (real | alone)
            out.append((np.full(hit.sum(), HIT), name[hit], d[hit]))
            # whether a head has several contexts, of several ids, one of them new
            fh, fd, fl = h[new], d[new], level[new]
            begin = np.nonzero(np.concatenate(([True], fh[1:] != fh[:-1])))[0]
            several = np.minimum.reduceat(fd, begin) != np.maximum.reduceat(fd, begin)
            touched = np.logical_or.reduceat(fl < 0, begin)
            some = np.zeros(len(h), bool)
            some[new] = np.repeat(several & touched, np.diff(np.append(begin, len(fh))))
            some &= real
            some |= alone & new & (level < 0)  # one that an index level holds was told then
            out.append((np.full(some.sum(), PARTIAL), name[some], d[some]))
            if insert:
                # of equal contexts the smallest id stays; of the largest id's markers the largest would do, any other tells the same
                stays = new & ((level < 0) | np.isin(level, list(keep_levels)))
                put = np.ascontiguousarray(np.stack([h[stays], c[stays], d[stays]])).tobytes()
        n = sum(len(x[0]) for x in out)
        if n:
            kind, name, d = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(name), pa.array(d), pa.nulls(n, pa.int32()),
                                              pa.nulls(n, pa.binary())], names=["kind", "a", "id", "part", "data"])
        if put:
            yield pa.RecordBatch.from_arrays([pa.array([INDEX], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                              pa.array([place], pa.int32()), pa.array([put], pa.binary())],
                                             names=["kind", "a", "id", "part", "data"])
    return run


SCANNED = "kind int, a long, id long, part int, data binary"


def context_blocks(source: DataFrame, partitions: int, shards: int = 1, length: int = LENGTH, bounds=()) -> DataFrame:
    """Blocks of the contexts of ``source`` (id, text), by shard and batch of ids."""
    return source.select("id", "text").mapInArrow(_records(shards, length, partitions, bounds), BLOCKS)


class SuffixIndexFamily:
    """Levels of one shard; ``add`` scans a batch against all of them and makes
    it a level, merging levels of equal size."""

    def __init__(self, partitions: int):
        self.partitions = partitions
        self.levels: list[tuple[int, DataFrame, str]] = []  # (size in batches, table, path), larger first

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """``kind, a, id``: hits (context name a in document id) and contexts
        to compare string by string, for the blocks ``batch`` of documents
        with larger ids than all before. With ``last`` they are not indexed."""
        spark = batch.sparkSession
        rows = batch.select("part", "kind", "data", F.lit(-1).alias("level"))
        merged, size = [], 1
        while not last and len(merged) < len(self.levels) and self.levels[-1 - len(merged)][0] == size:
            merged.append(len(self.levels) - 1 - len(merged))
            size *= 2
        for i, (_, t, _) in enumerate(self.levels):
            rows = rows.unionByName(t.select("part", "kind", "data", F.lit(i).alias("level")))
        path = scratch_path(spark, "suffix-level")
        (rows.repartitionById(self.partitions, F.col("part")).mapInArrow(_merge_scan(frozenset(merged), not last), SCANNED)
         .write.option("compression", "zstd").partitionBy("kind").parquet(path))
        read = spark.read.schema("a long, id long, part int, data binary, kind int").parquet(path)
        if not last:
            gone = [self.levels[i] for i in merged]
            self.levels = [x for i, x in enumerate(self.levels) if i not in merged]
            self.levels.append((size, read.where(F.col("kind") == INDEX), path))
            for _, _, old in gone:  # entries of a merged level are in the new one; its findings stay
                delete_path(spark, f"{old}/kind={INDEX}")
        return read.where(F.col("kind") != INDEX).select("kind", "a", "id")

    def close(self, spark) -> None:
        for _, _, path in self.levels:
            delete_path(spark, f"{path}/kind={INDEX}")


def _contexts(length: int):
    """Task function: (id, text, names) -> (id, name, bytes) of the named contexts."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = _ids(b.column(0))
            data, off = text_buffer(b.column(1))
            wanted_flat, wanted_off = b.column(2).flatten().to_numpy(), b.column(2).offsets.to_numpy()
            wanted_off = wanted_off - wanted_off[0]
            for lo, hi in byte_slices(off, SLICE_BYTES):
                part = off[lo:hi + 1]
                raw = data[part[0]:part[-1]]
                text, first, last, head, context = anchors(raw, part - part[0], length)
                name = _name(head, context)
                want = wanted_flat[wanted_off[lo]:wanted_off[hi]]
                found = _member(np.repeat(np.arange(hi - lo), np.diff(wanted_off[lo:hi + 1])), want, text, name)[0] >= 0
                text, first, last, name = text[found], first[found], last[found], name[found]
                order, _, _ = _first_of(ids[lo:hi][text], name, first)
                key = np.stack([ids[lo:hi][text], name])[:, order]
                one = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, bool)
                pick = order[one]
                size = last[pick] - first[pick] + length
                flat = raw[ragged(first[pick], size)]
                cut = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[0, one]), pa.array(key[1, one]),
                     pa.BinaryArray.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(cut),
                                                                          pa.py_buffer(np.ascontiguousarray(flat))])],
                    names=["id", "name", "context"])
    return run


def _member(rows_a: np.ndarray, names_a: np.ndarray, rows_b: np.ndarray, names_b: np.ndarray):
    """For each (row, name) of b the place of an equal pair in a, or -1."""
    if not len(names_a):
        return np.full(len(names_b), -1), None
    order = np.lexsort((names_a, rows_a))
    # rows are few per slice: fold them into the name so that one search finds the pair
    ka = _mix(names_a[order].view(np.uint64) + rows_a[order].astype(np.uint64) * BASES[0])
    kb = _mix(names_b.view(np.uint64) + rows_b.astype(np.uint64) * BASES[0])
    by = np.argsort(ka)
    at = np.minimum(np.searchsorted(ka[by], kb), len(ka) - 1)
    place = order[by[at]]
    return np.where((names_a[place] == names_b) & (rows_a[place] == rows_b), place, -1), order


def _strings(shard: int, shards: int, length: int):
    """Task function: (id, name, context) -> rows (pk, w, id, name, mask): the
    strings of one shard, once a batch of rows with the smallest id (mask:
    place in the context); rows settled here have w null."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, names = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, off = text_buffer(b.column(2))
            if len(data) < length:
                continue
            w1, = rolling(data, (length,), BASES[0])
            w2, = rolling(data, (length,), BASES[1])
            count = np.maximum(np.diff(off) - length + 1, 0)
            at = ragged(off[:-1], count)
            row = np.repeat(np.arange(len(ids)), count)
            place = at - off[:-1][row]
            w1, w2 = _mix(w1[at]), _mix(w2[at])
            own = (w1 >> np.uint64(40)) % np.uint64(shards) == np.uint64(shard)
            w1, w2, row, place = w1[own].view(np.int64), w2[own].view(np.int64), row[own], place[own]
            d = ids[row]
            order, start, new = _first_of(w1, w2, d)
            hit = d[order] > d[order][start]
            mask = np.left_shift(np.int64(1), place)
            sent, done = order[~hit], order[hit]
            yield _string_rows(w1[sent], w1[sent], w2[sent], d[sent], names[row[sent]], mask[sent])
            yield _string_rows(names[row[done]] ^ d[done], None, None, d[done], names[row[done]], mask[done])
    return run


def _string_rows(pk, w1, w2, d, name, mask):
    import pyarrow as pa

    n = len(pk)
    w = [pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (w1, w2)]
    return pa.RecordBatch.from_arrays([pa.array(pk), *w, pa.array(d), pa.array(name), pa.array(mask)],
                                      names=["pk", "w1", "w2", "id", "name", "mask"])


def _settle_strings(batches):
    """Task function over whole hash partitions of string rows -> (id, name, mask) of hits."""
    import pyarrow as pa

    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    done = t.filter(t.column("w1").is_null())
    live = t.filter(t.column("w1").is_valid())
    w1, w2, d, name, mask = (live.column(c).to_numpy() for c in ("w1", "w2", "id", "name", "mask"))
    order, start, _ = _first_of(w1, w2, d)
    hit = order[d[order] > d[order][start]] if len(order) else order
    d = np.concatenate((done.column("id").to_numpy(), d[hit]))
    name = np.concatenate((done.column("name").to_numpy(), name[hit]))
    mask = np.concatenate((done.column("mask").to_numpy(), mask[hit]))
    if not len(d):
        return
    order, _, _ = _first_of(d, name, mask)
    d, name, mask = d[order], name[order], mask[order]
    begin = np.nonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (name[1:] != name[:-1]))))[0]
    yield pa.RecordBatch.from_arrays([pa.array(d[begin]), pa.array(name[begin]),
                                      pa.array(np.bitwise_or.reduceat(mask, begin))], names=["id", "name", "mask"])


def _cut(length: int, with_text: bool):
    """Task function: (kept columns..., id, text, names, masks) -> what is removed and what stays."""
    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            k = b.num_columns - 4
            data, off = text_buffer(b.column(k + 1))
            f_off = b.column(k + 2).offsets.to_numpy()
            names, masks = b.column(k + 2).flatten().to_numpy(), b.column(k + 3).flatten().to_numpy()
            f_off = f_off - f_off[0]
            for lo, hi in byte_slices(off, SLICE_BYTES):
                part = off[lo:hi + 1]
                raw, cuts = data[part[0]:part[-1]], part - part[0]
                gone = np.zeros(len(raw), bool)
                if f_off[hi] > f_off[lo]:
                    text, first, last, head, context = anchors(raw, cuts, length)
                    rows = np.repeat(np.arange(hi - lo), np.diff(f_off[lo:hi + 1]))
                    at, _ = _member(rows, names[f_off[lo]:f_off[hi]], text, _name(head, context))
                    found = at >= 0
                    first, last = first[found], last[found]
                    mask = masks[f_off[lo]:f_off[hi]][at[found]]
                    edge = np.zeros(len(raw) + 1, np.int64)
                    whole = mask == -1  # all strings of a context: one run of bytes
                    np.add.at(edge, first[whole], 1)
                    np.add.at(edge, last[whole] + length, -1)
                    first, last, mask = first[~whole], last[~whole], mask[~whole]
                    for at in range(0, len(first), CUT_CONTEXTS):
                        f, m = first[at:at + CUT_CONTEXTS], mask[at:at + CUT_CONTEXTS]
                        count = last[at:at + CUT_CONTEXTS] - f + 1
                        string = ragged(f, count)
                        string = string[(np.repeat(m, count) >> (string - np.repeat(f, count))) & 1 == 1]
                        np.add.at(edge, string, 1)
                        np.add.at(edge, string + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(gone)))[cuts]
                head_of_run = gone.copy()
                head_of_run[1:] &= ~gone[:-1]
                starts = cuts[:-1][np.diff(cuts) > 0]
                head_of_run[starts] = gone[starts]
                spans = np.concatenate(([0], np.cumsum(head_of_run)))[cuts]
                kept = raw[~gone].tobytes()
                stay = (cuts - total).tolist()
                texts = [kept[s:e] for s, e in zip(stay, stay[1:])]
                cols = [*[c.slice(lo, hi - lo) for c in b.columns[:k]], pa.array(np.diff(cuts)), pa.array(np.diff(total)),
                        pa.array(np.diff(spans)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names_out = [*b.schema.names[:k], "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(texts, pa.binary()))
                    names_out.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names_out)
    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   batches: int = BATCHES, shards: int = SHARDS, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the
    bytes that stay) for every row.

    Texts are UTF-8 bytes (null: empty); matches never cross documents. A byte
    goes if some string of ``length`` bytes over it also starts in a document
    with a smaller id; strings are those of the input. Rows that repeat an id
    are parts of one document: they do not remove each other. A null id counts
    as larger than all others. Texts shorter than ``length`` stay whole. An
    empty table gives an empty result. Only the two named columns are read.
    """
    if not HEAD < length <= HEAD + 62:
        raise ValueError(f"length must be between {HEAD + 1} and {HEAD + 62}")
    spark = df.sparkSession
    source = df.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), col(text_col).alias("text"))
    with freeing_shuffles(spark):
        size = source.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx(
            "id", [i / batches for i in range(1, batches)], 1000).alias("cuts")).first() if batches > 1 else \
            source.agg(F.sum(F.octet_length("text")).alias("bytes"), F.lit(None).alias("cuts")).first()
        bounds = sorted(set(size["cuts"] or []))
        rows_of = (size["bytes"] or 0) // 14 // shards
        found = []
        parts = max(default_partitions(spark), -(-rows_of // TASK_ROWS))
        path = scratch_path(spark, "suffix-contexts")
        context_blocks(source, parts, shards, length, bounds).write.partitionBy("shard", "batch").parquet(path)
        blocks = spark.read.schema(BLOCKS).parquet(path)
        for shard in range(shards):
            family = SuffixIndexFamily(parts)
            for i in range(len(bounds) + 1):
                found.append(family.add(blocks.where((F.col("shard") == shard) & (F.col("batch") == i)), last=i == len(bounds)))
                delete_path(spark, f"{path}/shard={shard}/batch={i}")  # in the index now, and its findings are written
            family.close(spark)
        delete_path(spark, path)
        findings = found[0]
        for f in found[1:]:
            findings = findings.unionByName(f)
        partial = (findings.where(F.col("kind") == PARTIAL).groupBy("id").agg(F.collect_set("a").alias("names")))
        contexts, m = materialize(source.join(partial, "id").select("id", "text", "names")
                                  .mapInArrow(_contexts(length), "id long, name long, context binary"), "suffix-contexts",
                                  F.count(F.lit(1)).alias("n"))
        masks = findings.where(F.col("kind") == HIT).select("id", F.col("a").alias("name"), F.lit(-1).cast("long").alias("mask"))
        for shard in range(WINDOW_SHARDS):
            parts = max(default_partitions(spark), -(-m["n"] * 15 // WINDOW_SHARDS // TASK_ROWS))
            settled, _ = materialize(
                contexts.mapInArrow(_strings(shard, WINDOW_SHARDS, length),
                                    "pk long, w1 long, w2 long, id long, name long, mask long")
                .repartition(parts, "pk").mapInArrow(_settle_strings, "id long, name long, mask long"), "suffix-strings")
            masks = masks.unionByName(settled)
        lists, _ = materialize(masks.groupBy("id", "name").agg(F.bit_or("mask").alias("mask")).groupBy("id").agg(
            F.collect_list(F.struct("name", "mask")).alias("f")).select(
            "id", F.col("f.name").alias("names"), F.col("f.mask").alias("masks")), "suffix-masks")
    none = F.array().cast("array<bigint>")
    rows = (df.select(col(id_col).alias("doc_id"), F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                      col(text_col).alias("text")).join(lists, "id", "left")
            .select("doc_id", "id", "text", F.coalesce("names", none).alias("names"), F.coalesce("masks", none).alias("masks")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(_cut(length, with_text), schema + (", kept binary" if with_text else ""))
