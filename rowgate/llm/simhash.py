"""SimHash near-dedup with bit-sliced comparison (operator 9).

1. Fingerprints: one pass over whole texts in Arrow batches.
2. Candidates: fingerprints at ``radius`` or fewer differing bits agree on at
   least ``blocks - radius`` of ``blocks`` bit blocks, so equal values of a
   choice of blocks bring every link together, whatever the data. ``blocks``
   follows from the number of distinct fingerprints, so that evenly spread
   fingerprints fill a bucket with about ``BUCKET`` rows at any size. The
   fingerprints of buckets that are still larger (a dense cluster) are keyed
   again with more blocks; a bucket that is too large with the most blocks is
   cut into tiles by hash and every pair of tiles is compared. No link is
   lost; partitions follow from the rows after tiling, and a task compares
   some buckets at a time.
3. Bit-sliced comparison: 64 fingerprints of a bucket form a block that is
   stored as 64 vertical bit planes, one word a plane. One pass over the
   planes updates the 64 distances of a block by carry-save counters; a block
   is abandoned once all its distances exceed the radius.
4. A task sends on a spanning forest of the links it found (at most one row
   per fingerprint); components are joined in ``components``.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import col, default_partitions, freeing_shuffles, materialize, text_buffer
from .components import components

BITS = 64
BUCKET = 1024  # distinct fingerprints of a bucket that are compared in one task
TASK_ROWS = 200_000
CHUNK_ROWS = 1 << 16  # rows that a task compares at a time
HIT_BLOCKS = 1 << 11  # blocks of 64 lanes whose pairs are laid out at a time
BROADCAST_ROWS = 1_000_000  # large buckets whose list is broadcast


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space,
    XXH64 (seed 42) of each run of ``shingle`` words joined by a space."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash64(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [hash64(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str, keep: list[Column], shingle: int = 3) -> DataFrame:
    """``keep`` (aliased by the caller) plus ``fp``, the fingerprint as a signed long."""
    plain = df.select(*keep, col(text_col).alias("_fp_text"))
    kept = plain.drop("_fp_text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, off = text_buffer(b.column(b.num_columns - 1))
            raw, o = data.tobytes(), off.tolist()
            fp = np.array([fingerprint(raw[s:e], shingle) for s, e in zip(o, o[1:])], dtype=np.uint64)
            names = [*b.schema.names[:-1], "fp"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=names)

    return plain.mapInArrow(run, kept.schema.add("fp", "long"))


def blocks_for(distinct: int, radius: int, bucket: int = BUCKET) -> int:
    """Smallest number of bit blocks whose buckets hold about ``bucket`` of
    evenly spread fingerprints."""
    for blocks in range(radius + 1, radius + 6):
        if distinct / 2.0 ** (BITS * (blocks - radius) // blocks) <= bucket:
            return blocks
    return radius + 5


def bucket_keys(fp: str, blocks: int, radius: int) -> Column:
    """Array of bucket keys of a fingerprint: for each choice of blocks, its
    number and the bits of those blocks."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).alias("choice"), F.col(fp).bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int, chunk: int = 1 << 16):
    """Yield index arrays (i, j), i < j, of fingerprints of the same group at
    ``radius`` or fewer differing bits. ``group`` is sorted."""
    n = len(fps)
    if n < 2:
        return
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    blocks = (n + 63) // 64
    padded = np.zeros(blocks * 64, np.uint64)
    padded[:n] = fps
    lanes = np.arange(64, dtype=np.uint64)
    planes = np.empty((BITS, blocks), np.uint64)  # planes[b, k]: bit b of the 64 fingerprints of block k
    for b in range(BITS):
        bit = (padded >> np.uint64(b)) & one
        planes[b] = np.bitwise_or.reduce(bit.reshape(blocks, 64) << lanes, axis=1)
    end = np.searchsorted(group, group, side="right")  # rows i+1 .. end-1 are compared with row i
    rows = np.nonzero(end > np.arange(n) + 1)[0]
    if not len(rows):
        return
    first, last = (rows + 1) // 64, (end[rows] - 1) // 64
    for lo, hi in _slices(last - first + 1, chunk):
        span = (last - first + 1)[lo:hi]
        q = np.repeat(rows[lo:hi], span)
        k = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(first[lo:hi], span)
        a = np.maximum(q + 1 - k * 64, 0)
        z = np.minimum(end[q] - k * 64, 64)
        valid = (full << a.astype(np.uint64)) & (full >> (64 - z).astype(np.uint64))
        over = ~valid  # lanes out of the race
        counters = [np.zeros(len(q), np.uint64) for _ in range(int(radius).bit_length())]
        bits = fps[q]
        for b in range(BITS):
            diff = planes[b, k] ^ (np.uint64(0) - ((bits >> np.uint64(b)) & one))
            for c in counters:  # carry-save addition of one bit to 64 counters
                carry = c & diff
                c ^= diff
                diff = carry
            over |= diff
            if radius + 1 < 1 << len(counters) and b >= radius:
                over |= _exceeds(counters, radius)
            if b % 8 == 7:  # abandon blocks in which no distance can stay within the radius
                alive = np.nonzero(over != full)[0]
                if len(alive) < 0.7 * len(q):
                    q, k, over, bits = q[alive], k[alive], over[alive], bits[alive]
                    counters = [c[alive] for c in counters]
                    if not len(q):
                        break
        hit = ~over
        found = np.nonzero(hit)[0]
        for at in range(0, len(found), HIT_BLOCKS):  # among near copies every lane of every block is a pair
            some = found[at:at + HIT_BLOCKS]
            lane = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, t = np.nonzero(lane)
            yield q[some[r]], k[some[r]] * 64 + t


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over ``radius`` (below the counters' range)."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above = above | (equal & counters[i])
            equal = equal & ~counters[i]
    return above


def _slices(sizes: np.ndarray, chunk: int):
    """Runs of rows whose sizes sum to about ``chunk``."""
    cum, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + chunk, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


class Forest:
    """Union-find over 0..n-1 by vectorised hooking of larger roots to smaller ones."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _forest_of_buckets(radius: int, rows: int = CHUNK_ROWS):
    """Task function: rows (fp, choice, bits, x, y), sorted by all but fp ->
    links (u, v). Whole buckets (tiles) of about ``rows`` rows together are
    compared at a time, so a task never holds its partition."""
    def links(t):
        import pyarrow as pa

        fp, choice, bits, x, y = (t.column(i).to_numpy() for i in range(5))
        new = np.ones(len(fp), bool)
        new[1:] = False
        for k in (choice, bits, x, y):
            new[1:] |= k[1:] != k[:-1]
        values, place = np.unique(fp, return_inverse=True)
        forest = Forest(len(values))
        for i, j in close_pairs(fp.view(np.uint64), np.cumsum(new), radius):
            forest.join(place[i], place[j])
        linked = np.nonzero(forest.root != np.arange(len(values)))[0]
        return pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[forest.root[linked]])],
                                          names=["u", "v"])

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < rows:
                continue
            t = pa.Table.from_batches(held)
            same = np.ones(n, bool)  # rows of the last bucket, which may go on in the next batch
            for i in range(1, 5):
                c = t.column(i).to_numpy()
                same &= c == c[-1]
            done = n - int(same.sum())
            if done:
                yield links(t.slice(0, done))
            held, n = t.slice(done).to_batches(), n - done
        if n:
            yield links(pa.Table.from_batches(held))
    return run


def fingerprint_links(fps: DataFrame, distinct: int, radius: int = 3, bucket: int = BUCKET,
                      blocks: int | None = None) -> DataFrame:
    """Spanning links (u, v) of the distinct fingerprints in column ``fp``
    that differ in ``radius`` or fewer bits."""
    spark = fps.sparkSession
    blocks = blocks or blocks_for(distinct, radius, bucket)
    keyed = fps.select("fp", F.explode(bucket_keys("fp", blocks, radius)).alias("k")).select("fp", "k.choice", "k.bits")
    tiles = F.ceil(F.col("n") * 2 / F.lit(bucket))
    sizes, m = materialize(keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(f"n > {bucket}"),
                           "simhash-large", F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows"),
                           F.sum(F.col("n") * tiles).alias("tiled"))
    x = y = F.lit(0)
    sent, finer = distinct * comb(blocks, radius), None
    if m["n"]:
        sent -= m["rows"]
        sizes = F.broadcast(sizes) if m["n"] <= BROADCAST_ROWS else sizes
        if blocks < radius + 5:
            # both ends of a link inside a large bucket are in such buckets: finer blocks find it among those alone
            dense, d = materialize(keyed.join(sizes, ["choice", "bits"], "left_semi").select("fp").distinct(),
                                   "simhash-dense", F.count(F.lit(1)).alias("n"))
            finer = fingerprint_links(dense, d["n"], radius, bucket, min(blocks + 2, radius + 5))
            keyed = keyed.join(sizes, ["choice", "bits"], "left_anti")
        else:
            sent += m["tiled"]
            keyed = keyed.join(sizes, ["choice", "bits"], "left")
            mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
            keyed = keyed.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn(
                "other", F.explode(F.sequence(F.lit(0), F.coalesce(tiles.cast("int"), F.lit(1)) - 1)))
            x, y = F.least("mine", "other"), F.greatest("mine", "other")
    parts = max(default_partitions(spark), -(-sent // TASK_ROWS))
    keyed = keyed.select("fp", "choice", "bits", x.alias("x"), y.alias("y")).repartition(parts, "choice", "bits", "x", "y")
    links = keyed.sortWithinPartitions("choice", "bits", "x", "y").mapInArrow(_forest_of_buckets(radius), "u long, v long")
    return links if finer is None else links.unionByName(finer)


def _prepared(df: DataFrame, text_col: str, keep: list[Column], shingle: int, radius: int):
    """Written rows with fingerprints, and the table (fp, root) of linked fingerprints."""
    with freeing_shuffles(df.sparkSession):
        rows, _ = materialize(with_fingerprint(df, text_col, keep, shingle)
                              .withColumn("rid", F.monotonically_increasing_id()), "simhash-rows")
        fps, m = materialize(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "rid")).alias("first"),
                                                    F.min("doc_id").alias("least")), "simhash-fps",
                             F.count(F.lit(1)).alias("n"))
        links, _ = materialize(fingerprint_links(fps, m["n"], radius), "simhash-links")
        roots = components(links).withColumnsRenamed({"node": "fp"})
        member = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        # first ranks a null id below all others, least ignores null ids
        tops = member.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
        tops, _ = materialize(tops, "simhash-tops")
        member, _ = materialize(member.select("fp", "root").join(tops, "root"), "simhash-members")
    return rows, member


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: the fingerprint as
    16 hex digits and the smallest id reachable over links of ``radius`` or
    fewer differing bits.

    A text without words (also null) has fingerprint zero and links like any
    other. Rows that repeat an id are rows of their own. A null id is never a
    component id unless the component has no other. An empty table gives an
    empty result; other columns are not read.
    """
    rows, member = _prepared(df, text_col, [col(id_col).alias("doc_id")], shingle, radius)
    out = rows.select("doc_id", "fp").join(member.select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         radius: int = 3) -> DataFrame:
    """``df`` with one row of each component left: the one with the smallest
    id (a null id counts as smallest; of rows that repeat it, exactly one)."""
    keep = [col(id_col).alias("doc_id"), *[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]]
    rows, member = _prepared(df, text_col, keep, shingle, radius)
    # Dropped rows are few beside the kept ones: an anti join on the row id.
    dropped = (rows.select("rid", "fp").join(member.select("fp", F.col("first.rid").alias("keep")), "fp")
               .where("rid <> keep").select("rid"))
    with freeing_shuffles(df.sparkSession):
        dropped, _ = materialize(dropped, "simhash-dropped")
    out = rows.join(dropped, "rid", "left_anti")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
