"""Quality rules by repetition coverage (operator 11).

Texts are worked on in slices of a few megabytes, whole texts each. Words get
exact ids (a dictionary of the slice's distinct words); every id stands for a
fixed 64-bit number, and one prefix sum of number x base^position gives the
rolling hash of every word window of every length as a difference of two
prefixes. Windows of the shortest length are sorted by hash; each longer
length only looks at starts whose shorter window is duplicated, since both
occurrences of a duplicated window begin with a duplicated shorter one. Equal
neighbours in the sort are compared word by word, so the counts are exact: a
collision makes the slice start again with another base.

All windows of a text that occur twice or more, the first included, cover its
words; the measure of a length is the number of characters of covered words.
Lines are compared as bytes, and a line equal to an earlier one counts as
duplicated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, col, text_buffer

BASE_WINDOW = 8
#: Window length in words -> most characters (percent of those in words) that duplicated windows may cover.
COVERAGE_LIMITS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
LINE_LIMIT = 20  # the same for lines equal to an earlier line
MIN_WORDS = 20
BASE_LIMIT = 30  # percent of words in duplicated windows of BASE_WINDOW words

_WORD, _BLANK, _SYMBOL = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[list(b"#*$%&|<>")] = _SYMBOL


def _numbers(n: int, seed: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each of 0 .. n-1."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def duplicated_windows(ids: np.ndarray, first: np.ndarray, lengths, seed: int = 1):
    """For every n of ``lengths`` (ascending): the starts of the windows of n
    words that occur twice or more in one document. ``ids`` are exact word
    ids, ``first[d]`` the first word of document d, with the end appended."""
    m = len(ids)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(first[1:], sizes)
    while True:
        base, n_ids = np.uint64(2 * (seed * 0x5851F42D4C957F2D % 2 ** 62) + 1), int(ids.max(initial=-1)) + 1
        power = np.full(m + 1, base, np.uint64)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(_numbers(n_ids, seed)[ids] * power[:m], out=total[1:])
        back = np.full(m + 1, pow(int(base), -1, 2 ** 64), np.uint64)
        back[:1] = 1
        back = np.multiply.accumulate(back)
        per_doc = _numbers(len(sizes), seed + 7)
        out, starts, collided = {}, np.arange(m), False
        for n in lengths:
            starts = starts[starts + n <= end[starts]]
            key = (total[starts + n] - total[starts]) * back[starts] ^ per_doc[doc[starts]]
            order = np.argsort(key, kind="stable")
            same = np.nonzero(key[order[1:]] == key[order[:-1]])[0]
            a, b = starts[order[same]], starts[order[same + 1]]
            if (doc[a] != doc[b]).any() or any((ids[a + j] != ids[b + j]).any() for j in range(n)):
                collided = True
                break
            hit = np.zeros(len(starts), bool)
            hit[order[same]] = hit[order[same + 1]] = True
            starts = starts[hit]
            out[n] = starts
        if not collided:
            return out
        seed += 1


def _covered(starts: np.ndarray, n: int, m: int) -> np.ndarray:
    """Words inside any of the windows of n words."""
    edge = np.zeros(m + 1, np.int32)
    edge[starts] += 1  # starts are distinct, so are the ends
    edge[starts + n] -= 1
    return np.cumsum(edge[:m]) > 0


def repetition(data: np.ndarray, offsets: np.ndarray, limits=None) -> dict[str, np.ndarray]:
    """Counts per text of UTF-8 ``data``; text i is ``offsets[i]:offsets[i + 1]``
    and ends with an added newline."""
    import pyarrow as pa

    limits = COVERAGE_LIMITS if limits is None else limits
    n_docs, doc_at = len(offsets) - 1, offsets[:-1]
    kind = _CLASS[data]
    inside = kind != _BLANK
    starts = np.nonzero(inside & ~np.concatenate(([False], inside[:-1])))[0]
    ends = np.nonzero(inside & ~np.concatenate((inside[1:], [False])))[0] + 1
    m = len(starts)

    def per_doc(flags) -> np.ndarray:
        """Sum of byte flags per document (every document has a byte: its newline)."""
        return np.add.reduceat(flags, doc_at, dtype=np.int64) if n_docs else np.zeros(0, np.int64)

    points = inside & ((data & 0xC0) != 0x80)
    at = np.concatenate(([0], np.cumsum(points, dtype=np.int64)))
    chars = at[ends] - at[starts]  # code points of each word
    out = {"word_chars": per_doc(points), "n_symbols": per_doc(kind == _SYMBOL)}
    first = np.searchsorted(starts, offsets)  # first word of each document
    out["n_words"] = np.diff(first)

    # exact word ids: the words without what is between them are one buffer
    where = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(where.tobytes()),
                                                                    pa.py_buffer(data[inside].tobytes())])
    ids = words.dictionary_encode().indices.to_numpy() if m else np.zeros(0, np.int32)
    lengths = sorted({*limits, BASE_WINDOW})
    found = duplicated_windows(ids, first, lengths)
    sums = np.concatenate(([0], np.cumsum(chars)))

    def over_words(values) -> np.ndarray:
        s = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return s[first[1:]] - s[first[:-1]]
    for n in lengths:
        inside_n = _covered(found[n], n, m)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = over_words(inside_n)
        if n in limits:
            out[f"dup_chars_{n}"] = over_words(np.where(inside_n, chars, 0))

    # lines, each with its newline
    line_end = np.nonzero(data == 0x0A)[0] + 1
    line_at = np.concatenate(([0], line_end[:-1]))
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(line_end), [
        None, pa.py_buffer(np.concatenate(([0], line_end)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    line_ids = lines.dictionary_encode().indices.to_numpy().astype(np.int64) if len(line_end) else np.zeros(0, np.int64)
    line_doc = np.searchsorted(offsets, line_at, side="right") - 1
    w0, w1 = np.searchsorted(starts, line_at), np.searchsorted(starts, line_end)
    full = np.nonzero(w1 > w0)[0]
    _, earliest = np.unique(line_doc[full] << 32 | line_ids[full], return_index=True)
    later = np.ones(len(full), bool)
    later[earliest] = False
    again = full[later]
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs).astype(np.int64)
    long = np.zeros(n_docs, np.int64)
    np.add.at(long, line_doc[again], sums[w1[again]] - sums[w0[again]])
    out["dup_line_chars"] = long
    return out


def _verdict(r: dict[str, np.ndarray], limits, line_limit: int, min_words: int, base_limit: int):
    failed = (r["n_words"] < min_words) | (100 * r["n_repeat_words"] > base_limit * r["n_words"])
    kept = ~failed & (100 * r["dup_line_chars"] <= line_limit * r["word_chars"])
    for n, most in limits.items():
        kept &= 100 * r[f"dup_chars_{n}"] <= most * r["word_chars"]
    return failed, kept


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, int] | None = None,
                     line_limit: int = LINE_LIMIT, min_words: int = MIN_WORDS, base_limit: int = BASE_LIMIT) -> DataFrame:
    """Counts and verdict per row: ``id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, dup_line_chars, dup_chars_<n>..., base_failed,
    kept``. Map-only: no shuffle, whatever repeats in the table.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``base_limit`` percent of them in windows of 8 words that occur twice or
    more. ``kept``: not failed, and no more than ``limits[n]`` percent of the
    characters of words in duplicated windows of n words, for every n, nor
    more than ``line_limit`` percent in lines equal to an earlier line.

    A null text has no words: all counts 0, failed, not kept; so have empty and
    blank texts. Null and repeated ids are kept, a row per row of ``df``; an
    empty table gives none; other columns of ``df`` are not looked at. A text
    is one piece of work: it needs about 60 bytes of memory per byte.
    """
    limits = dict(sorted((COVERAGE_LIMITS if limits is None else limits).items()))
    rows = df.select(col(id_col).alias("id"), F.concat(F.coalesce(col(text_col), F.lit("")), F.lit("\n")).alias("t"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
              *[f"dup_chars_{n}" for n in limits]]
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_buffer(b.column(1))
            for lo, hi in byte_slices(offsets):
                r = repetition(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], limits)
                failed, kept = _verdict(r, limits, line_limit, min_words, base_limit)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(r[c], pa.int64()) for c in counts],
                                                  pa.array(failed), pa.array(kept)], ["id", *counts, "base_failed", "kept"])

    out = rows.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)
