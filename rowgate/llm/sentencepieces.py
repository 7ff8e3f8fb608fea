"""SentencePiece encoding and decoding by batched numpy Viterbi (operator 8).

A text is normalised as the model says (space becomes U+2581, one is put in
front) and cut into words where no piece can cross: before a run of U+2581
and around characters that occur in no piece. Each distinct word of a batch
is segmented once. Words of equal length advance together: the hashes of all
substrings of one length (differences of prefix hashes) probe the sorted keys
of the pieces of that length, then one step per position takes the maximum
over the piece lengths for all words at once and stores the length as
backpointer. The segmentation maximises the sum of piece scores; among equal
sums the longer last piece wins. A character without a piece costs the lowest
score less 10 and becomes its UTF-8 bytes (models with byte pieces) or the
unknown id. Decoding lays the bytes of the pieces end to end.

Only the vocabulary comes from the model file; it is bounded and travels with
the task.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import byte_slices, col, ragged, text_buffer

SPACE = 0x2581
BASE = np.uint64(0x9E3779B97F4A7C15)
CELLS = 1 << 19  # substring cells (word, position, length) of a group handled at once, over piece lengths
NONE = -(1 << 50)
PAIRED = 1000  # characters with a number of their own in the table of neighbours


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 0 text, 1 byte, 2 control, 3 unknown
    dummy_prefix: bool = True

    def __post_init__(self):
        text = [i for i in range(len(self.pieces)) if self.kinds[i] == 0]
        self.longest = max(len(self.pieces[i]) for i in text)
        # pairs[i, j]: characters i and j (in order of use, the rarest share the last number) stand
        # side by side in some piece, or one of them is rare; a character in no piece has number 0.
        chars = sorted((c for c, _ in Counter("".join(self.pieces[i] for i in text)).most_common(PAIRED)))
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for i in text for c in self.pieces[i]]] = PAIRED + 1
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.pairs = np.zeros((PAIRED + 2, PAIRED + 2), bool)
        self.pairs[PAIRED + 1, 1:] = self.pairs[1:, PAIRED + 1] = True
        for i in text:
            at = self.number[[ord(c) for c in self.pieces[i]]]
            self.pairs[at[:-1], at[1:]] = True
        self.keys, self.ids, self.points, self.maybe = {}, {}, {}, {}
        for size in range(1, self.longest + 1):
            own = np.array([i for i in text if len(self.pieces[i]) == size], np.int64)
            if not len(own):
                continue
            cps = np.frombuffer("".join(self.pieces[i] for i in own).encode("utf-32-le"), "<u4").reshape(-1, size)
            h = np.zeros(len(own), np.uint64)
            for j in range(size):
                h = h * BASE + cps[:, j].astype(np.uint64) + np.uint64(1)
            order = np.argsort(h)
            self.keys[size], self.ids[size], self.points[size] = h[order], own[order], self.scores[own[order]]
            self.maybe[size] = np.zeros(1 << 18, bool)
            self.maybe[size][h >> np.uint64(46)] = True
            if (np.diff(h[order]) == 0).any():
                raise ValueError("two pieces share a hash")
        byte = [i for i in range(len(self.pieces)) if self.kinds[i] == 1]
        self.byte_ids = np.array(byte) if len(byte) == 256 else None
        unknown = np.nonzero(self.kinds == 3)[0]
        self.unknown_id = int(unknown[0]) if len(unknown) else 0
        self.unknown_score = min(int(self.scores[i]) for i in text) - 10
        raw = [b"" if k == 2 else bytes([int(p[3:5], 16)]) if k == 1 else
               (" ⁇ ".encode() if k == 3 else p.replace("▁", " ").encode()) for p, k in zip(self.pieces, self.kinds)]
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)


def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) else 3 if sp.is_unknown(i) else 0 for i in range(n)])
    scores = np.array([round(sp.get_score(i)) if kinds[i] == 0 else 0 for i in range(n)], np.int64)
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], scores, kinds, bool(sp.encode("a") != sp.encode("a")[1:]))


def _segment(vocab: Vocabulary, words: np.ndarray):
    """(row, token) of all words (n, L) of one length, in order; a token below
    zero is -1 - codepoint of a character without a piece."""
    n, size = words.shape
    most = min(vocab.longest, size)
    prefix = np.zeros((n, size + 1), np.uint64)
    for j in range(size):
        prefix[:, j + 1] = prefix[:, j] * BASE + words[:, j] + np.uint64(1)
    # gain[:, j, c]: score of the piece that ends after j + 1 characters and has most - c of them
    gain = np.full((n, size, most), NONE, np.int64)
    token = np.zeros((n, size, most), np.int32)
    power = np.ones(1, np.uint64)
    for length in range(1, most + 1):
        power = power * BASE
        c = most - length
        if length in vocab.keys:
            h = prefix[:, length:] - prefix[:, :-length] * power
            r, p = np.nonzero(vocab.maybe[length][h >> np.uint64(46)])  # the rest cannot be keys
            h = h[r, p]
            at = np.minimum(np.searchsorted(vocab.keys[length], h), len(vocab.keys[length]) - 1)
            hit = vocab.keys[length][at] == h
            r, p, at = r[hit], p[hit] + length - 1, at[hit]
            gain[r, p, c] = vocab.points[length][at]
            token[r, p, c] = vocab.ids[length][at]
    alone = gain[:, :, most - 1] == NONE
    gain[:, :, most - 1][alone] = vocab.unknown_score
    token[:, :, most - 1][alone] = -1 - words[alone].astype(np.int64)
    best = np.full((n, most + size), NONE, np.int64)  # best[:, most - 1 + j]: of the first j characters
    best[:, most - 1] = 0
    choice = np.zeros((n, size), np.int32)
    every = np.arange(n)
    for j in range(size):
        total = best[:, j:j + most] + gain[:, j]
        choice[:, j] = c = total.argmax(axis=1)
        best[:, j + most] = total[every, c]
    rows, tokens, steps = [], [], []
    live, end, step = every, np.full(n, size), 0
    while len(live):
        c = choice[live, end - 1]
        rows.append(live)
        tokens.append(token[live, end - 1, c])
        steps.append(np.full(len(live), step))
        end = end - (most - c)
        more = end > 0
        live, end, step = live[more], end[more], step + 1
    rows, tokens, steps = np.concatenate(rows), np.concatenate(tokens), np.concatenate(steps)
    order = np.lexsort((-steps, rows))
    return rows[order], tokens[order]


def encode(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, ids per text) of UTF-8 texts laid end to end."""
    import pyarrow as pa

    n = len(offsets) - 1
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    head = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))[offsets].astype(np.int64)
    if head[-1] != len(cps):  # bytes that are not UTF-8: text by text
        parts = [data[s:e].tobytes().decode("utf-8", "replace").encode("utf-32-le") for s, e in zip(offsets, offsets[1:])]
        cps = np.frombuffer(b"".join(parts), "<u4")
        head = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts])))
    full = np.diff(head) > 0
    if vocab.dummy_prefix:
        cps = np.insert(cps, head[:-1][full], SPACE)
        head = head + np.concatenate(([0], np.cumsum(full)))
    cps = np.where(cps == 0x20, np.uint32(SPACE), cps).astype(np.uint32)
    if not len(cps):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    number = vocab.number[cps]
    start = np.ones(len(cps), bool)
    start[1:] = ~vocab.pairs[number[:-1], number[1:]]
    start[head[:-1][full]] = True
    first = np.nonzero(start)[0]
    cut = np.append(first, len(cps)).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(start, dtype=np.int32)))[head]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [
        None, pa.py_buffer(cut * 4), pa.py_buffer(np.ascontiguousarray(cps))]).dictionary_encode()
    words = coded.dictionary
    flat = np.frombuffer(words.buffers()[2], "<u4")
    at = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1] // 4
    length = np.diff(at)
    owner, token = [], []
    for size in np.unique(length):
        own = np.nonzero(length == size)[0]
        group = max(1, CELLS // int(size * min(size, vocab.longest)))
        for lo in range(0, len(own), group):
            part = own[lo:lo + group]
            r, t = _segment(vocab, flat[at[part][:, None] + np.arange(size)])
            owner.append(part[r])
            token.append(t)
    owner, token = np.concatenate(owner), np.concatenate(token).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    owner, token = owner[order], token[order]
    owner, token = _spell_unknown(vocab, owner, token)
    size = np.bincount(owner, minlength=len(words))
    begin = np.cumsum(size) - size
    code = coded.indices.to_numpy()
    total = np.concatenate(([0], np.cumsum(size[code])))
    return token[ragged(begin[code], size[code])], total[before[1:]] - total[before[:-1]]


def _spell_unknown(vocab: Vocabulary, owner: np.ndarray, token: np.ndarray):
    """Characters without a piece as byte pieces, or as the unknown id."""
    strange = np.nonzero(token < 0)[0]
    if not len(strange):
        return owner, token
    if vocab.byte_ids is None:
        token = token.copy()
        token[strange] = vocab.unknown_id
        return owner, token
    spelled = [chr(-1 - int(t)).encode("utf-8", "replace") for t in token[strange]]
    count = np.ones(len(token), np.int64)
    count[strange] = [len(s) for s in spelled]
    out = np.repeat(token, count)
    begin = np.cumsum(count) - count
    out[ragged(begin[strange], count[strange])] = vocab.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    return np.repeat(owner, count), out


def decode(vocab: Vocabulary, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, text offsets); the dummy prefix is taken off."""
    size = vocab.raw_size[ids]
    total = np.concatenate(([0], np.cumsum(size)))
    off = total[np.concatenate(([0], np.cumsum(count)))]
    data = vocab.raw[ragged(vocab.raw_start[ids], size)]
    if vocab.dummy_prefix:
        heads = off[:-1][np.diff(off) > 0]
        heads = heads[data[heads] == 32]
        gone = np.zeros(len(data) + 1, np.int64)
        gone[heads + 1] = 1
        keep = np.ones(len(data), bool)
        keep[heads] = False
        return data[keep], off - np.cumsum(gone)[off]
    return data, off


def encode_column(df: DataFrame, model: str, keep: list[Column], text_col: str = "text", ids: bool = False,
                  slice_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` (aliased by the caller) plus ``n_tokens, ids_crc32, text_sha256,
    round_trip`` and, on request, ``ids``.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned
    32-bit integers, ``text_sha256`` the digest of the text decoded from the
    ids, ``round_trip`` whether it is the text itself (a U+2581 in a text comes
    back as a space). A null text is an empty one: no ids.
    """
    vocab = load_vocabulary(model)
    plain = df.select(*keep, col(text_col).alias("_text"))
    schema = (plain.drop("_text").schema.add("n_tokens", "long").add("ids_crc32", "long").add("text_sha256", "string")
              .add("round_trip", "boolean"))
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        for b in batches:
            data, off = text_buffer(b.column(b.num_columns - 1))
            for lo, hi in byte_slices(off, slice_bytes):
                part = off[lo:hi + 1]
                raw = data[part[0]:part[-1]]
                got, count = encode(vocab, raw, part - part[0])
                back, at = decode(vocab, got, count)
                end = np.concatenate(([0], np.cumsum(count)))
                view, text, original = memoryview(got.astype("<u4")).cast("B"), back.tobytes(), raw.tobytes()
                crc = [zlib.crc32(view[4 * s:4 * e]) for s, e in zip(end.tolist(), end[1:].tolist())]
                spans = list(zip(at.tolist(), at[1:].tolist()))
                sha = [hashlib.sha256(text[s:e]).hexdigest() for s, e in spans]
                same = [text[s:e] == original[x:y] for (s, e), x, y in
                        zip(spans, (part[:-1] - part[0]).tolist(), (part[1:] - part[0]).tolist())]
                cols = [*[c.slice(lo, hi - lo) for c in b.columns[:-1]], pa.array(count), pa.array(crc, pa.int64()),
                        pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(end.astype(np.int32)), pa.array(got.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return plain.mapInArrow(run, schema)


def encode_texts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``doc_id`` and the columns of ``encode_column`` for every row (repeated
    rows and null ids too); an empty table gives an empty result. Only the two
    named columns are read."""
    return encode_column(df, model, [col(id_col).alias("doc_id")], text_col, ids)


def decode_ids(df: DataFrame, model: str, keep: list[Column], ids_col: str = "ids") -> DataFrame:
    """``keep`` plus ``text`` decoded from an array of ids (null: null)."""
    vocab = load_vocabulary(model)
    plain = df.select(*keep, col(ids_col).cast("array<int>").alias("_ids"))
    schema = plain.drop("_ids").schema.add("text", "string")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists = b.column(b.num_columns - 1)
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            back, at = decode(vocab, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count)
            raw = back.tobytes()
            text = [raw[s:e].decode("utf-8", "replace") if ok else None
                    for s, e, ok in zip(at.tolist(), at[1:].tolist(), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], names=schema.names)

    return plain.mapInArrow(run, schema)
