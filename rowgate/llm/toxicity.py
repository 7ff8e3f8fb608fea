"""Toxicity (operator 10): a convolutional text classifier over hashed word
embeddings, several filter widths and max pooling, trained by Spark on all
labelled rows, with thresholds calibrated by language.

A word (a run of letters and digits, A-Z lower-cased) has two hashes into two
embedding tables and is the sum of both rows, so two words rarely share a
vector. Filters of width 1, 2 and 3 slide over the words of a text; each
keeps its largest response, and a logistic layer makes the score.

Training reads every labelled row outside the held-out fold. Their words are
hashed once, joined with the labels and written in blocks of about
``BLOCK_ROWS`` rows, dealt by hash. Embeddings start from how unevenly a
word's bucket is spread over the two labels, counted over all training rows,
so that rare words start at zero. Then come ``ROUNDS`` rounds: every block
starts at the common weights and descends over its rows (Adam, gradients
through the pooled positions), and the changes of all blocks are averaged,
per embedding over the blocks that used it. Changes are added as whole
numbers, so the weights do not depend on how the blocks are dealt to tasks.
Four fifths of the rows fit the weights, all others (the fifth by hash) give
the scaling of the score and the threshold of each language. What reaches
the driver is bounded by the size of the model, and by the number of languages.

Scoring reads every whole text once, in Arrow batches, with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.shared import scratch_scope
from .common import byte_slices, col, freeing_shuffles, in_fold, materialize, ragged, text_buffer

ROUNDS = 10
BLOCK_ROWS = 1024  # labelled rows that are fitted together before weights are averaged
BLOCK_WORDS = 1 << 20  # a block ends beyond so many words
STEP_ROWS, STEP_WORDS = 16, 1 << 18  # rows of a descent step; it ends beyond so many words
HELD = 5  # one row in so many calibrates and fits no weights
FEW = 50  # with fewer rows, all do both
BINS = 256  # calibration counts raw scores in bins of 1 / BINS
MARKS = 1 << 24  # bits that mark the ids with a label
UNIT = 2.0 ** 32  # changes of weights are added as whole multiples of 1 / UNIT
BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PAD = BUCKETS  # the row of zeros between texts


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(first bucket, second bucket) of all words, words per text."""
    n = len(offsets) - 1
    table = np.zeros(256, np.uint8)
    for c in range(97, 123):
        table[c] = table[c - 32] = c
    for c in (*range(48, 58), *range(128, 256)):
        table[c] = c
    b = table[data]
    word = b != 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = word[heads]
    at = np.nonzero(start)[0]
    before = np.concatenate(([0], np.cumsum(start)))
    count = before[offsets[1:]] - before[offsets[:-1]]
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(n, np.int64)
    # A word's hash: the sum over its bytes of a mixed (byte, place in the word).
    index = np.nonzero(word)[0]
    own = before[index + 1] - 1
    place = (index - at[own]).astype(np.uint64)
    v = (b[index].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(32)
    h = np.add.reduceat(v, np.nonzero(start[index])[0])
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    bits = np.uint64(BUCKETS - 1)
    return ((h >> np.uint64(16)) & bits).astype(np.int64), ((h >> np.uint64(40)) & bits).astype(np.int64), count


@dataclass
class ToxicityModel:
    first: np.ndarray  # (BUCKETS + 1, DIM), last row zero
    second: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    shift: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, one: np.ndarray, two: np.ndarray, count: np.ndarray, want_at: bool = False):
        """Pooled filter responses of texts of ``count`` words, and the padded position of each."""
        texts = len(count)
        gap = max(WIDTHS) - 1
        begin = np.cumsum(count + gap) - count - gap
        total = int((count + gap).sum())
        own = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        a = np.full(total + gap, PAD)
        z = np.full(total + gap, PAD)
        a[own], z[own] = one, two
        e = self.first[a] + self.second[z]
        best = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        at = np.zeros(best.shape, np.int64) if want_at else None
        some = np.nonzero(count)[0]
        for i, w in enumerate(WIDTHS):
            if not len(some):
                break
            flt = self.filters[w]
            r = e[:total] @ flt[0]
            for j in range(1, w):
                r += e[j:total + j] @ flt[j]
            # windows start at a word of the text; the gap after it is padding
            outside = np.ones(total, bool)
            outside[own] = False
            r[outside] = -np.inf
            cut = slice(i * FILTERS, (i + 1) * FILTERS)
            best[some, cut] = np.maximum.reduceat(r, begin[some], axis=0)
            if want_at:
                text = np.repeat(np.arange(texts), count)
                word, k = np.nonzero(r[own] == best[text, cut])
                # the first of equal responses is written last
                at[text[word[::-1]], i * FILTERS + k[::-1]] = own[word[::-1]]
        return best, at, (a, z, e)

    def raw(self, one, two, count) -> np.ndarray:
        best, _, _ = self.pooled(one, two, count)
        return np.maximum(best + self.bias, 0) @ self.weight + self.shift

    def score(self, one, two, count) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(one, two, count) + self.offset)

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.thresholds.get("", 0.5))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Adam:
    def __init__(self, shape, rate):
        self.m, self.v, self.rate, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), rate, 0

    def step(self, w, g, rows=None):
        self.t += 1
        if rows is None:
            rows = slice(None)
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * g
        self.v[rows] = 0.999 * self.v[rows] + 0.001 * g * g
        a = self.m[rows] / (1 - 0.9 ** self.t)
        b = self.v[rows] / (1 - 0.999 ** self.t)
        w[rows] -= self.rate * a / (np.sqrt(b) + 1e-6)


def _spread(pos: np.ndarray, neg: np.ndarray, p: int, n: int) -> np.ndarray:
    """Per bucket, how far its share of texts differs between the labels, in
    standard errors beyond what chance gives (0 for buckets seen a few times)."""
    p, n = max(p, 1), max(n, 1)
    share = (pos + neg + 0.5) / (p + n + 1)
    z = (pos / p - neg / n) / np.sqrt(share * (1 - share) * (1 / p + 1 / n))
    # chance gives the largest of BUCKETS about 4.5 standard errors; rare buckets are no evidence
    sure = (pos + neg) >= _least(p + n)
    return (np.sign(z) * np.maximum(np.abs(z) - 3.5, 0) * sure / 4).clip(-2, 2).astype(np.float32)


def _least(rows: int) -> float:
    return max(3, 0.005 * rows)


def start_model(spread: list, share: float, seed: int) -> ToxicityModel:
    """The model before the first round; ``spread`` of both tables."""
    rng = np.random.default_rng(seed)
    tables = []
    for first in spread:
        t = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
        t[:BUCKETS, 0] = first
        t[PAD] = 0
        tables.append(t)
    model = ToxicityModel(tables[0], tables[1],
                          {w: rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
                          np.full(FILTERS * len(WIDTHS), -0.2, np.float32),
                          np.full(FILTERS * len(WIDTHS), 0.1, np.float32), 0.0)
    for w in WIDTHS:  # half of the filters start by looking at the first dimension
        model.filters[w][:, 0, :FILTERS // 2] = 1.0 / w
        model.weight[WIDTHS.index(w) * FILTERS:][:FILTERS // 2] = 0.5
    model.shift = float(np.log((share + 1e-3) / (1 - share + 1e-3)) - 1)
    return model


def _dense(model: ToxicityModel) -> np.ndarray:
    """All weights but the embeddings, in rows of DIM."""
    flat = np.concatenate([*[model.filters[w].ravel() for w in WIDTHS], model.bias, model.weight, [model.shift]]).astype(np.float64)
    return np.concatenate((flat, np.zeros(-len(flat) % DIM))).reshape(-1, DIM)


def _moved(model: ToxicityModel, change: np.ndarray) -> ToxicityModel:
    """The model after ``change`` (both tables, then the rows of ``_dense``)."""
    flat, at, filters = (_dense(model) + change[2 * (BUCKETS + 1):]).ravel(), 0, {}
    for w in WIDTHS:
        size = w * DIM * FILTERS
        filters[w] = flat[at:at + size].reshape(w, DIM, FILTERS).astype(np.float32)
        at += size
    k = FILTERS * len(WIDTHS)
    return ToxicityModel((model.first + change[:BUCKETS + 1]).astype(np.float32),
                         (model.second + change[BUCKETS + 1:2 * (BUCKETS + 1)]).astype(np.float32), filters,
                         flat[at:at + k].astype(np.float32), flat[at + k:at + 2 * k].astype(np.float32), float(flat[at + 2 * k]))


def descend(start: ToxicityModel, y: np.ndarray, weigh: np.ndarray, one: np.ndarray, two: np.ndarray, count: np.ndarray,
            rng: np.random.Generator, rate: float = 0.03) -> tuple[ToxicityModel, list]:
    """One pass over the rows of a block from the weights of ``start``, and
    the rows of both tables that it changed. ``weigh`` has a weight per label."""
    model = ToxicityModel(start.first.copy(), start.second.copy(), {w: f.copy() for w, f in start.filters.items()},
                          start.bias.copy(), start.weight.copy(), start.shift)
    opt = {"first": _Adam(model.first.shape, rate), "second": _Adam(model.second.shape, rate),
           "bias": _Adam(model.bias.shape, rate), "weight": _Adam(model.weight.shape, rate),
           **{w: _Adam(model.filters[w].shape, rate) for w in WIDTHS}}
    shift = np.array([model.shift], np.float32)
    opt_shift = _Adam(shift.shape, rate)
    begin = np.cumsum(count) - count
    order, changed = rng.permutation(len(y)), [np.zeros(BUCKETS + 1, bool), np.zeros(BUCKETS + 1, bool)]
    lo = 0
    while lo < len(order):
        most = np.searchsorted(np.cumsum(count[order[lo:lo + STEP_ROWS]]), STEP_WORDS, side="right")
        which = order[lo:lo + max(int(most), 1)]
        lo += len(which)
        words = ragged(begin[which], count[which])
        best, at, (a, z, e) = model.pooled(one[words], two[words], count[which], want_at=True)
        act = np.maximum(best + model.bias, 0)
        err = weigh[y[which]] * (_sigmoid(act @ model.weight + shift[0]) - y[which]) / len(which)
        back = np.outer(err, model.weight) * (act > 0) * (count[which] > 0)[:, None]
        rows_at, grads = [], []
        for i, w in enumerate(WIDTHS):
            cut = slice(i * FILTERS, (i + 1) * FILTERS)
            g, p = back[:, cut].astype(np.float32), at[:, cut]
            gf = np.zeros_like(model.filters[w])
            for j in range(w):
                gf[j] = np.einsum("tk,tkd->dk", g, e[p + j])
                rows_at.append((p + j).ravel())
                grads.append((g[:, :, None] * model.filters[w][j].T[None]).reshape(-1, DIM))
            opt[w].step(model.filters[w], gf + 1e-4 * model.filters[w])
        rows_at, grads = np.concatenate(rows_at), np.concatenate(grads)
        some = grads.any(axis=1)
        rows_at, grads = rows_at[some], grads[some]
        for name, table, ids, seen in (("first", model.first, a[rows_at], changed[0]), ("second", model.second, z[rows_at], changed[1])):
            used, inv = np.unique(ids, return_inverse=True)
            g = np.zeros((len(used), DIM), np.float32)
            np.add.at(g, inv, grads)
            real = used != PAD
            seen[used[real]] = True
            opt[name].step(table, g[real] + 1e-4 * table[used[real]], used[real])
        opt["weight"].step(model.weight, (act * err[:, None]).sum(0).astype(np.float32) + 1e-4 * model.weight)
        opt["bias"].step(model.bias, back.sum(0).astype(np.float32))
        opt_shift.step(shift, np.array([err.sum()], np.float32))
        model.shift = float(shift[0])
    return model, changed


BLOCK = "held boolean, n long, pos long, y binary, count binary, words binary, lang array<string>"


def _pack(batches):
    """Task function: rows (shard, held, y, lang, words), sorted by shard and held -> blocks."""
    import pyarrow as pa

    def block(held, rows):
        y = np.array([r[0] for r in rows], np.uint8)
        count = np.array([len(r[2]) // 4 for r in rows], "<i8")
        columns = [[held], [len(y)], [int(y.sum())], [y.tobytes()], [count.tobytes()], [b"".join(r[2] for r in rows)],
                   [[r[1] for r in rows]]]
        kinds = [pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=["held", "n", "pos", "y", "count", "words", "lang"])

    key, rows, words = None, [], 0
    for b in batches:
        for shard, held, *row in zip(*[c.to_pylist() for c in b.columns]):
            if rows and ((shard, held) != key or len(rows) >= BLOCK_ROWS or words >= BLOCK_WORDS):
                yield block(key[1], rows)
                rows, words = [], 0
            key = (shard, held)
            rows.append(row)
            words += len(row[2]) // 4
    if rows:
        yield block(key[1], rows)


def _unpacked(b):
    """(labels, words a text, first buckets, second buckets, languages) of each block of a batch."""
    at = {n: b.schema.get_field_index(n) for n in ("y", "count", "words", "lang")}
    for i in range(b.num_rows):
        raw = {n: b.column(k)[i].as_py() for n, k in at.items()}
        words = np.frombuffer(raw["words"], "<u4").astype(np.int64)  # both buckets of a word in 32 bits
        yield (np.frombuffer(raw["y"], np.uint8).astype(np.int64), np.frombuffer(raw["count"], "<i8").astype(np.int64),
               words & (BUCKETS - 1), words >> 16, raw["lang"])


def _labelled_blocks(docs, labels: DataFrame, shards: int, id_col: str, text_col: str, lang_col: str, seed: int) -> DataFrame:
    """Blocks of all rows of ``docs`` whose id has a label in ``labels`` (id, y)."""
    # Rows without a label need not be hashed and sent: most are told by bits of the labelled ids, the join tells all.
    slot = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    marked = (labels.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("at"))
              .agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS int))")).alias("bits")).toArrow())
    marks = np.zeros(MARKS // 64, np.int64)
    marks[marked.column("at").to_numpy()] = marked.column("bits").to_numpy()

    def words(batches):
        import pyarrow as pa

        for b in batches:
            s = b.column(3).to_numpy()
            b = b.filter(pa.array((marks[s >> 6] >> (s & 63) & 1) != 0))
            data, off = text_buffer(b.column(2))
            for lo, hi in byte_slices(off):
                part = off[lo:hi + 1]
                one, two, count = word_hashes(data[part[0]:part[-1]], part - part[0])
                cut, both = np.concatenate(([0], np.cumsum(count))), (one | two << 16).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                     pa.array([both[s:e].tobytes() for s, e in zip(cut, cut[1:])], pa.binary())], names=["id", "lang", "words"])

    rows = docs.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & ~in_fold(F.col("id")))
    kind = rows.schema["id"].dataType
    if kind != labels.schema["id"].dataType:  # ids of other types have other hashes: the join alone tells
        marks[:] = -1
    rows = rows.withColumn("s", slot)
    hashed = rows.mapInArrow(words, f"id {kind.simpleString()}, lang string, words binary")
    h = F.xxhash64("id", "words", F.lit(seed))
    found = (hashed.join(labels.hint("merge"), "id").withColumn("h", h)
             .select(F.pmod("h", F.lit(shards)).alias("shard"),
                     (F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(HELD)) == 0).alias("held"), "h", "y", "lang", "words"))
    return (found.repartition("shard").sortWithinPartitions("shard", "held", "h", "y", "lang")
            .select("shard", "held", "y", "lang", "words").mapInArrow(_pack, BLOCK))


def _start(blocks: DataFrame, p: int, n: int, seed: int) -> ToxicityModel:
    """The starting weights, from the texts of each label with each bucket."""
    def count(batches):
        import pyarrow as pa

        seen = np.zeros((2, 2 * BUCKETS), np.int64)
        for b in batches:
            for y, size, one, two, _ in _unpacked(b):
                end = np.cumsum(size)
                for v, lo, hi in zip(y.tolist(), (end - size).tolist(), end.tolist()):
                    seen[v, np.unique(one[lo:hi])] += 1
                    seen[v, np.unique(two[lo:hi]) + BUCKETS] += 1
        at = np.nonzero(seen.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], names=["slot", "pos", "neg"])

    rows = (blocks.select("y", "count", "words", "lang").mapInArrow(count, "slot long, pos long, neg long")
            .groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where(F.col("pos") + F.col("neg") >= F.lit(float(_least(p + n)))).toArrow())
    pos, neg = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    slot = rows.column("slot").to_numpy()
    pos[slot], neg[slot] = rows.column("pos").to_numpy(), rows.column("neg").to_numpy()
    return start_model(_spread(pos, neg, p, n).reshape(2, BUCKETS), p / max(p + n, 1), seed)


def _round(blocks: DataFrame, model: ToxicityModel, weigh: np.ndarray, seed: int) -> ToxicityModel:
    """The weights after one pass of every block from ``model``."""
    def change(batches):
        import pyarrow as pa

        total, used = None, None
        for b in batches:
            for y, size, one, two, _ in _unpacked(b):
                new, changed = descend(model, y, weigh, one, two, size, np.random.default_rng(seed))
                dense = _dense(new) - _dense(model)
                if total is None:
                    total = np.zeros((2 * (BUCKETS + 1) + len(dense), DIM), np.int64)
                    used = np.zeros(len(total), np.int64)
                for k, (after, before) in enumerate(((new.first, model.first), (new.second, model.second))):
                    at = np.nonzero(changed[k])[0]
                    total[at + k * (BUCKETS + 1)] += np.rint((after[at].astype(np.float64) - before[at]) * UNIT).astype(np.int64)
                    used[at + k * (BUCKETS + 1)] += 1
                total[-len(dense):] += np.rint(dense * UNIT).astype(np.int64) * len(y)  # blocks count by their rows
                used[-len(dense):] += len(y)
        if total is not None:
            at = np.nonzero(used)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(used[at]), *[pa.array(total[at, d]) for d in range(DIM)]],
                                             names=["slot", "used", *[f"d{d}" for d in range(DIM)]])

    names = [f"d{d}" for d in range(DIM)]
    # whole numbers beyond a long are added as decimals of 38 digits
    moved = (blocks.select("y", "count", "words", "lang")
             .mapInArrow(change, "slot long, used long, " + ", ".join(f"{n} long" for n in names)).groupBy("slot")
             .agg(*[(F.sum(F.col(n).cast("decimal(28,0)")).cast("double") / F.sum("used") / F.lit(UNIT)).alias(n) for n in names])
             .toArrow())
    total = np.zeros((2 * (BUCKETS + 1) + len(_dense(model)), DIM))
    total[moved.column("slot").to_numpy()] = np.stack([moved.column(n).to_numpy() for n in names], axis=1)
    return _moved(model, total)


def _calibrate(blocks: DataFrame, model: ToxicityModel, base_rate: float) -> None:
    """Scale the score to the base rate, then a threshold per language, from
    the labels of all raw scores, counted in bins."""
    def count(batches):
        import pyarrow as pa

        for b in batches:
            for y, size, one, two, lang in _unpacked(b):
                raw, end, lo = np.zeros(len(y)), np.cumsum(size), 0
                while lo < len(y):  # some words at a time
                    hi = max(int(np.searchsorted(end, end[lo] - size[lo] + STEP_WORDS, side="right")), lo + 1)
                    s, e = end[lo] - size[lo], end[hi - 1]
                    raw[lo:hi] = model.raw(one[s:e], two[s:e], size[lo:hi])
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.floor(raw.clip(-40, 40) * BINS).astype(np.int64)),
                                                  pa.array(y)], names=["lang", "bin", "y"])

    rows = blocks.select("y", "count", "words", "lang").mapInArrow(count, "lang string, bin long, y long")
    bins, _ = materialize(rows.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "bin")
                          .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "toxic-bins")
    every = bins.groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    got = every.orderBy("bin").toArrow()
    raw = (got.column("bin").to_numpy() + 0.5) / BINS
    pos, neg = got.column("pos").to_numpy(), got.column("neg").to_numpy()
    share = pos.sum() / (pos.sum() + neg.sum())
    if_toxic, if_not = float(base_rate / max(share, 1e-6)), float((1 - base_rate) / max(1 - share, 1e-6))
    best = None
    for slope in np.geomspace(0.3, 3, 13):  # a two-parameter logistic fit by grid: bounded and stable
        for offset in np.linspace(-6, 4, 41):
            p = _sigmoid(slope * raw + offset).clip(1e-3, 1 - 1e-3)
            loss = -(if_toxic * pos * np.log(p) + if_not * neg * np.log(1 - p)).sum()
            if best is None or loss < best[0]:
                best = (loss, slope, offset)
    model.slope, model.offset = float(best[1]), float(best[2])

    # F1 of every cut between bins; the score grows with the bin
    of_lang = Window.partitionBy("lang")
    above = of_lang.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    hit, miss = F.sum("pos").over(above) * F.lit(if_toxic), F.sum("neg").over(above) * F.lit(if_not)
    cuts = (bins.where("lang <> ''").unionByName(every.select(F.lit("").alias("lang"), "bin", "pos", "neg"))
            .withColumn("below", F.lag("bin").over(of_lang.orderBy("bin")))
            .withColumn("p", F.sum("pos").over(of_lang)).withColumn("n", F.sum("neg").over(of_lang))
            .withColumn("f1", 2 * hit / (hit + miss + F.col("p") * F.lit(if_toxic)))
            .where("p >= 5 AND n >= 5").withColumn("top", F.max("f1").over(of_lang))
            .where(F.col("f1") >= F.col("top") - 1e-12).groupBy("lang").agg(F.min(F.struct("bin", "below")).alias("x")))
    at = lambda b: float(_sigmoid(model.slope * (b + 0.5) / BINS + model.offset))
    for r in cuts.select("lang", "x.bin", "x.below").toLocalIterator():
        low = 0.0 if r["below"] is None else at(r["below"])
        model.thresholds[r["lang"]] = (low + at(r["bin"])) / 2  # halfway to the next score below


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", label_col: str = "toxic", sample: int | None = None,
                   seed: int = 11) -> ToxicityModel | None:
    """Fit on all labelled rows outside the held-out fold; None if no row has
    a label. An id with several labels counts with the highest. A caller may
    ask for ``sample`` ids only, half of each label if there are enough."""
    spark = docs.sparkSession
    lab = (labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y"))
           .where("id IS NOT NULL AND y IS NOT NULL").where(~in_fold(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
           .where("y IN (0, 1)"))
    sizes = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    if not sizes:
        return None
    if sample is not None:
        h = F.xxhash64("id", F.lit(seed))
        lab = lab.where("y = 0").orderBy(h, "id").limit(sample // 2).unionByName(
            lab.where("y = 1").orderBy(h, "id").limit(sample // 2))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with scratch_scope(spark), freeing_shuffles(spark):
        shards = -(-sum(sizes.values()) // BLOCK_ROWS)
        of = lambda c, held: F.sum(F.when(F.col("held") == F.lit(held), F.col(c)).otherwise(0)).alias(f"{c}_{held}")
        blocks, m = materialize(_labelled_blocks(docs, lab, shards, id_col, text_col, lang_col, seed), "toxic-blocks",
                                *[of(c, held) for c in ("n", "pos") for held in (False, True)])
        rows, held = (m["n_False"] or 0) + (m["n_True"] or 0), m["n_True"] or 0
        if not rows:
            return None
        try:
            spark.conf.set(key, 4)  # a block is a row of some MB
            train, check, n, p = blocks.where("NOT held"), blocks.where("held"), m["n_False"], m["pos_False"]
            if rows < FEW or held in (0, rows):
                train = check = blocks
                n, p = rows, m["pos_False"] + m["pos_True"]
            model = _start(train, p, n - p, seed)
            # both labels weigh the same, whatever their numbers
            weigh = np.array([n / 2 / max(n - p, 1), n / 2 / max(p, 1)]) if 0 < p < n else np.ones(2)
            for k in range(ROUNDS):
                model = _round(train, model, weigh, seed + k)
            _calibrate(check, model, sizes.get(1, 0) / sum(sizes.values()))
        finally:
            spark.conf.set(key, before)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", label_col: str = "toxic", cut: float = 0.3,
                   sample: int | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted, flagged`` for every row.

    ``score`` depends on the text alone; ``predicted`` is 1 if it reaches
    ``cut``; ``flagged`` compares it with the threshold of the row's language
    (of all languages together where the language is null or was too rare).
    A null text is an empty one and is scored like any text. Rows whose crc32
    of the id leaves remainder 2 modulo 4 are held out of training; a null id
    is not held out. Without any label every score is 0.
    """
    model = train_toxicity(docs, labels, id_col, text_col, lang_col, label_col, sample)
    plain = docs.select(col(id_col).alias("doc_id"), in_fold(col(id_col)).alias("held_out"), col(lang_col).alias("lang"),
                        col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            score = np.zeros(b.num_rows)
            data, off = text_buffer(b.column(3))
            for lo, hi in byte_slices(off):
                if model is not None:
                    part = off[lo:hi + 1]
                    score[lo:hi] = model.score(*word_hashes(data[part[0]:part[-1]], part - part[0]))
            flagged = np.zeros(b.num_rows, bool)
            if model is not None:
                flagged = score >= np.array([model.threshold(x) for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score),
                                              pa.array((score >= cut).astype(np.int32)), pa.array(flagged)],
                                             names=["doc_id", "held_out", "score", "predicted", "flagged"])

    return plain.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, flagged boolean")
