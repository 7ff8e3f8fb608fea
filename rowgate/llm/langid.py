"""Language ID (operator 2): averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy, with calibrated
rejection.

A text is the average of the embeddings of its subwords (2 to 4 bytes of one
word, its borders included), found by hash. Training sees a bounded sample of
labelled rows (``SAMPLE``, about as many of each language); their subword
counts are made on the executors. A fifth of the sample is held back to fit
the softmax temperature and the rejection margin. At prediction the embedding
and the linear layer are multiplied once, so a subword adds one number per
language; every whole text is read once, in Arrow batches, with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_slices, col, in_fold, sample_ids, text_buffer

SAMPLE = 2000  # most labelled rows that training reads
BUCKETS = 1 << 15
DIM = 16
NGRAMS = (2, 3, 4)


def _byte_classes() -> np.ndarray:
    """Bytes as subwords see them: A-Z lower-cased, ASCII non-letters a border."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    for c in range(97, 123):
        t[c] = t[c - 32] = c
    return t


def subwords(data: np.ndarray, offsets: np.ndarray):
    """Yield (bucket of the subword at each byte, per n-gram size) of texts laid
    end to end; the bucket is BUCKETS where no subword starts."""
    b = _byte_classes()[data].astype(np.uint32)
    n = len(b)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes up to the end of the text
    letter = b != 32
    for size in NGRAMS:
        m = n - size + 1
        if m <= 0:
            continue
        v = b[:m].copy()
        for j in range(1, size):
            v |= b[j:m + j] << np.uint32(8 * j)
        ok = left[:m] >= size
        if size == 2:
            ok &= letter[:m] | letter[1:m + 1]
        for j in range(1, size - 1):
            ok &= letter[j:m + j]
        h = (v * np.uint32(2654435761)) ^ (v >> np.uint32(15)) ^ np.uint32(size * 0x9E3779B)
        h = ((h * np.uint32(2246822519)) >> np.uint32(32 - 15)).astype(np.int64)
        h[~ok] = BUCKETS
        yield h


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # one column of logits per bucket and language; the last row is zero
    bias: np.ndarray
    temperature: float
    margin: float  # texts whose best logit stands out less from the mean are rejected

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(self.langs)
        sums, count = np.zeros((n, k)), np.zeros(n)
        full = np.nonzero(np.diff(offsets) > 0)[0]
        for h in subwords(data, offsets):
            own = full[offsets[full] < len(h)]  # short last texts may have no subword of this size
            if not len(own):
                continue
            at = offsets[own]
            count[own] += np.add.reduceat(h < BUCKETS, at, dtype=np.int64)
            for c in range(k):
                sums[own, c] += np.add.reduceat(self.table[:, c][h], at, dtype=np.float64)
        return sums / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray):
        """(index of the language, calibrated probability, rejected) of each text."""
        z = self.logits(data, offsets)
        best = z.argmax(axis=1)
        p = _softmax(z / self.temperature)
        return best, p[np.arange(len(z)), best], _clarity(z) < self.margin


def _clarity(z: np.ndarray) -> np.ndarray:
    """How far the best logit stands out from the mean. Texts of no known
    language have logits near zero; a text in two known languages is clear."""
    return z.max(axis=1) - z.mean(axis=1) if z.shape[1] > 1 else np.full(len(z), np.inf)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counts(batches):
    """Task function of training: (class, pri, text) -> (class, pri, buckets, counts)."""
    import pyarrow as pa

    for b in batches:
        data, off = text_buffer(b.column(2))
        idx, cnt = [], []
        for s, e in zip(off, off[1:]):
            total = np.zeros(BUCKETS + 1, np.int64)
            for h in subwords(data[s:e], np.array([0, e - s])):
                total += np.bincount(h, minlength=BUCKETS + 1)
            some = np.nonzero(total[:BUCKETS])[0]
            idx.append(some.astype("<u2").tobytes())
            cnt.append(total[some].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())],
                                         names=["class", "pri", "idx", "cnt"])


def fit(rows: list[tuple[str, bytes, bytes]], epochs: int = 12, rate: float = 40.0, batch: int = 32,
        seed: int = 7, reject: float = 0.002) -> LanguageModel | None:
    """Train on (language, buckets, counts) rows; None without any."""
    rows = [(lang, np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(c, "<f4")) for lang, i, c in rows if len(i)]
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({r[0] for r in rows})
    y = np.array([langs.index(r[0]) for r in rows])
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 10 * len(langs) else order[:0]
    train = order[len(held):]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)

    def dense(which):
        x = np.zeros((len(which), BUCKETS), np.float32)
        for r, i in enumerate(which):
            x[r, rows[i][1]] = rows[i][2] / rows[i][2].sum()
        return x

    steps, done = epochs * -(-len(train) // batch), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for lo in range(0, len(train), batch):
            which = train[lo:lo + batch]
            used = np.unique(np.concatenate([rows[i][1] for i in which]))
            x = dense(which)[:, used]
            mean = x @ emb[used]
            g = _softmax(mean @ out + bias)
            g[np.arange(len(which)), y[which]] -= 1
            g /= len(which)
            lr = rate * (1 - done / steps)
            back = g @ out.T
            out -= lr / 40 * mean.T @ g * 10
            bias -= lr / 400 * g.sum(axis=0)
            emb[used] -= lr * (x.T @ back)
            done += 1
    table = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    table[:BUCKETS] = emb @ out
    check = held if len(held) else train
    z = np.concatenate([dense(check[i:i + 256]) @ table[:BUCKETS] + bias for i in range(0, len(check), 256)])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
    right = z.argmax(axis=1) == y[check]
    # Texts of unknown scripts hit buckets at random: reject what is no clearer than such noise, but
    # never more than half the clarity that all but a share ``reject`` of known texts have.
    noise = []
    for i in check:
        noise.append(rows[i][2] @ table[rng.integers(0, BUCKETS, len(rows[i][1]))] / rows[i][2].sum() + bias)
    margin = 0.0
    if len(langs) > 1 and right.any():
        margin = min(0.5 * float(np.quantile(_clarity(z[right]), reject)), float(np.quantile(_clarity(np.array(noise)), 0.99)))
    return LanguageModel(langs, np.asfortranarray(table), bias.astype(np.float64), float(grid[int(np.argmin(loss))]), margin)


def train_language_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                         sample: int = SAMPLE, seed: int = 7) -> LanguageModel | None:
    """Fit on at most ``sample`` rows with a language; rows without id, text or
    language are no training rows."""
    rows = df.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text"))
    ids = sample_ids(rows.where("text IS NOT NULL"), "id", "lang", sample, seed)
    texts = (rows.join(F.broadcast(ids), (rows["id"] == ids["id"]) & (rows["lang"] == ids["class"]))
             .select("class", "pri", "text"))
    got = (texts.mapInArrow(_counts, "class string, pri double, idx binary, cnt binary")
           .orderBy("pri", F.xxhash64("idx", "cnt")).limit(sample).collect())
    return fit([(r["class"], bytes(r["idx"]), bytes(r["cnt"])) for r in got], seed=seed)


def add_language(df: DataFrame, model: LanguageModel | None, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` (aliased by the caller) plus ``lang_pred, score, rejected``."""
    text = col(text_col)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    plain = df.select(*keep, letters.alias("_letters"), text.alias("_text"))
    schema = plain.drop("_letters", "_text").schema.add("lang_pred", "string").add("score", "double").add(
        "rejected", "boolean")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, data_cols = b.num_rows, b.columns[:-2]
            letters = b.column(b.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = np.full(n, "und", dtype=object), np.zeros(n)
            rejected = np.ones(n, bool)
            if model is not None:
                data, off = text_buffer(b.column(b.num_columns - 1))
                names = np.array(model.langs, dtype=object)
                for lo, hi in byte_slices(off):
                    part = off[lo:hi + 1]
                    best, p, far = model.predict(data[part[0]:part[-1]], part - part[0])
                    lang[lo:hi], score[lo:hi], rejected[lo:hi] = names[best], p, far
                lang[~letters], score[~letters], rejected[~letters] = "und", 0.0, True
            yield pa.RecordBatch.from_arrays([*data_cols, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             names=schema.names)

    return plain.mapInArrow(run, schema)


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row.

    Rows whose crc32 of the id leaves remainder 2 modulo 4 are held out of
    training. A text that is null or has no letter is ``und`` with score 0 and
    is rejected; so is every text when there are no training rows. A null id is
    not held out, but is no training row. Only the three named columns are read.
    """
    held = in_fold(col(id_col))
    model = train_language_model(df.where(~held), id_col, text_col, lang_col, sample)
    return add_language(df, model, text_col, [col(id_col).alias("doc_id"), held.alias("held_out")])


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    sample: int = SAMPLE) -> DataFrame:
    """``df`` without the rows whose language is rejected."""
    model = train_language_model(df.where(~in_fold(col(id_col))), id_col, text_col, lang_col, sample)
    keep = [col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    out = add_language(df, model, text_col, keep).where(~F.col("rejected"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
