"""Phrase collocations by prefix-free parsing (operator 13).

1. Parse. Every text is a sequence of words in pieces. A window of words whose
   hash falls into a fixed class is a trigger; a chunk reaches from one trigger
   to the end of the next one, so neighbouring chunks overlap by less than a
   longest phrase. Where chunks begin depends on content only: passages that
   repeat give equal chunks, and the dictionary of distinct chunks with their
   frequencies is smaller than the corpus. It is one partially aggregated
   shuffle.
2. Count. Phrases are counted inside the distinct chunks, weighted with their
   frequencies. A phrase belongs to the chunk in which it starts before the
   overlap, so overlaps count once. Three passes count words, pairs and all
   longer phrases exactly, keyed by their text. The first two also hash the
   phrases that are one word longer into a table of counters, and the next pass
   only looks at phrases whose counter and whose two shorter phrases reach the
   minimum. These filters only spare rows that cannot reach it: whatever falls
   into one counter is counted exactly afterwards. Their size is bounded
   (``FILTER``).
3. Score, in SQL with exact decimals: cuts joined with the counts of their
   parts, the worst cut per phrase, phrases that are part of one as frequent
   longer phrase dropped, best phrases per language.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_slices, col, freeing_shuffles, lower_ascii, materialize, ragged, text_buffer

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
TRIGGER = 32  # one window in so many is a trigger
LONGEST_CHUNK = 1024  # words; a stretch without any trigger is cut here
FILTER = (1 << 16, 1 << 25)  # least and most counters of a filter (32 MB of counts, 4 MB of bits)
SLICES = 64  # parts in which counters travel and are added up
SLICE_BYTES = 4 << 20
#: floor(1000 a n / (l r)) in exact decimals of 38 digits: counts may have 17 digits.
SCORE = ("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div "
         "(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


_FACTORS = np.random.default_rng(13).integers(0, 2 ** 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``data``; each ends one byte before its
    end, where a blank or a break is. They choose triggers and counters, no
    count depends on them."""
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate(([0], ends[:-1]))
    size = ends - starts
    at = np.arange(len(data), dtype=np.int32) - np.repeat(starts, size).astype(np.int32)
    terms = _FACTORS[at & 4095]
    terms *= data + np.uint64(1)
    terms[ends - 1] = 0
    h = np.add.reduceat(terms, starts) ^ size.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def _phrase_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from every position (the last n - 1 positions wrap
    around; callers leave them out)."""
    out = h.copy()
    for j in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _ODD + np.roll(h, -j)
    return out ^ (out >> np.uint64(32))


def parse_chunks(data: np.ndarray, offsets: np.ndarray, overlap: int, trigger: int = TRIGGER, longest: int = LONGEST_CHUNK):
    """Chunks of lower-cased texts that each end with a newline: (document,
    counted words, first byte, bytes) per chunk and the buffer they are in,
    where words are followed by a space, or by a newline before a break."""
    gap = _GAP[data]
    word = ~gap
    starts = np.nonzero(word & np.concatenate(([True], gap[:-1])))[0]
    ends = np.nonzero(word & np.concatenate((gap[1:], [True])))[0] + 1  # a text ends with a newline
    m = len(starts)
    if m == 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint8),)
    # one byte after each word: a newline if any break lies before the next word (a text ends with one)
    breaks = np.concatenate(([0], np.cumsum(_BREAK[data], dtype=np.int64)))
    stop = breaks[np.append(starts[1:], len(data))] > breaks[ends]
    keep = word.copy()
    keep[ends] = True
    text = data.copy()
    text[ends] = np.where(stop, 0x0A, 0x20)
    text = text[keep]
    size = np.cumsum(ends - starts + 1)  # end of each word and its byte in ``text``
    hashes = _word_hashes(text, size)
    first = np.searchsorted(starts, offsets[:-1])  # first word of each document
    last = np.append(first[1:], m)
    doc = np.repeat(np.arange(len(first)), last - first)
    doc_end = np.repeat(last, last - first)
    window = _phrase_hash(hashes, overlap) if overlap else hashes
    at = np.arange(m)
    is_start = (window % np.uint64(trigger) == 0) & (at + overlap <= doc_end)
    is_start[first[first < last]] = True
    cuts = np.nonzero(is_start)[0]
    reach = np.append(cuts[1:], m) - cuts
    more = (reach - 1) // longest  # stretches without a trigger
    if more.any():
        extra = np.repeat(cuts, more) + (ragged(np.zeros(len(cuts), np.int64), more) + 1) * longest
        cuts = np.sort(np.concatenate((cuts, extra)))
    nxt = np.append(cuts[1:], m)
    # the overlap reaches into the next chunk of the same document, not beyond the piece of the last counted word
    piece_end = np.nonzero(stop)[0] + 1
    until = np.minimum(nxt + overlap, piece_end[np.searchsorted(piece_end, nxt)])
    until = np.minimum(np.maximum(until, nxt), doc_end[cuts])
    lo = np.concatenate(([0], size))[cuts]
    return doc[cuts], nxt - cuts, lo, size[until - 1] - lo, text


def _parse(overlap: int, trigger: int, longest: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_buffer(b.column(1))
            for lo, hi in byte_slices(offsets, SLICE_BYTES):
                doc, counted, at, size, text = parse_chunks(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo],
                                                            overlap, trigger, longest)
                if not len(doc):
                    continue
                chunk = text[ragged(at, size)]
                chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [
                    None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64).tobytes()), pa.py_buffer(chunk.tobytes())])
                t = pa.table({"lang": b.column(0).slice(lo, hi - lo).take(pa.array(doc)), "chunk": chunks, "counted": pa.array(counted)})
                t = t.group_by(["lang", "chunk", "counted"]).aggregate([([], "count_all")])
                t = t.select(["lang", "chunk", "counted", "count_all"]).cast(pa.schema([
                    ("lang", pa.string()), ("chunk", pa.binary()), ("counted", pa.int64()), ("count_all", pa.int64())]))
                yield from t.rename_columns(["lang", "chunk", "counted", "freq"]).to_batches(max_chunksize=20000)
    return run


def _bits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the counter of each hash is marked in ``bitmap``."""
    at = (h % np.uint64(len(bitmap) * 8)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _count(lengths, hashed: int | None, filters, counters: int, min_count: int):
    """Task function: chunks -> exact counts of the phrases of ``lengths``
    words (kind 0) and slices of the counters of phrases of ``hashed`` words
    (kind 1). ``filters`` is a broadcast list of bitmaps of the lengths 2, 3, ..."""
    longest = max(*lengths, hashed or 0)

    def run(batches):
        import pyarrow as pa
        import xxhash

        bitmaps = [np.frombuffer(x, np.uint8) for x in filters.value]
        table, room = np.zeros(counters if hashed else 0, np.uint32), [2 ** 31]

        def work(langs, data, ends_of, counted, freq):
            ends = np.nonzero((data == 0x20) | (data == 0x0A))[0] + 1
            begins = np.concatenate(([0], ends[:-1]))
            m = len(ends)
            last = np.searchsorted(ends, ends_of, side="right")  # words up to each chunk's end
            first = np.concatenate(([0], last[:-1]))
            per = last - first
            chunk = np.repeat(np.arange(len(per)), per)
            eligible = np.arange(m) - first[chunk] < counted[chunk]
            names = langs.dictionary.to_pylist()
            salts = np.fromiter((xxhash.xxh64_intdigest(s.encode(), 1) for s in names), np.uint64, len(names))
            lang = langs.indices.to_numpy().astype(np.int64)[chunk]
            h, freq = _word_hashes(data, ends) ^ salts[lang], freq[chunk]
            stops = data[ends - 1] == 0x0A
            stops[last[per > 0] - 1] = True  # a chunk's last word ends its piece or its overlap
            valid = passed = np.ones(m, bool)
            for k in range(1, longest + 1):
                if k > 1:  # phrases of k words inside a piece that may reach the minimum
                    valid = valid & ~np.roll(stops, -(k - 2))
                    valid[max(m - k + 1, 0):] = False
                    passed = valid & passed & np.roll(passed, -1)
                if k == hashed:
                    at = np.nonzero(passed & eligible)[0]
                    np.add.at(table, (_phrase_hash(h, k)[at] % np.uint64(counters)).astype(np.int64),
                              np.minimum(freq[at], min_count).astype(np.uint32))
                    room[0] -= len(at) * min_count
                    if room[0] < 0:  # before a counter can run over; it only has to tell who reaches the minimum
                        np.minimum(table, min_count, out=table)
                        room[0] = 2 ** 31
                if 2 <= k < len(bitmaps) + 2:
                    at = np.nonzero(passed)[0]
                    passed = np.zeros(m, bool)
                    passed[at[_bits(bitmaps[k - 2], _phrase_hash(h, k)[at])]] = True
                if k in lengths:
                    at = np.nonzero(passed & eligible)[0]
                    if len(at):
                        yield counts(k, at, names, lang, h, freq, data, begins, ends)

        def counts(n, at, names, lang, h, freq, data, begins, ends):
            """Exact groups of the phrases of n words at ``at``: by language and word ids, packed pair by pair."""
            if n == 1:  # all words, each with a blank after it
                ids = _binary(pa, np.where(data == 0x0A, np.uint8(0x20), data), ends).dictionary_encode().indices.to_numpy().astype(np.int64)[at, None]
            else:
                where = (at[:, None] + np.arange(n)).ravel()
                size = ends[where] - 1 - begins[where]
                ids = _binary(pa, data[ragged(begins[where], size)], np.cumsum(size)).dictionary_encode()
                ids = ids.indices.to_numpy().astype(np.int64).reshape(len(at), n)
            group = lang[at]
            for j in range(n):
                group = np.unique(group << 32 | ids[:, j], return_inverse=True)[1]
            total = np.zeros(int(group.max()) + 1, np.int64)
            np.add.at(total, group, freq[at])
            one = np.zeros(len(total), np.int64)
            one[group] = at
            size = ends[one + n - 1] - 1 - begins[one]
            return _rows(pa, 0, pa.array(names).take(pa.array(lang[one])), _binary(pa, data[ragged(begins[one], size)], np.cumsum(size)),
                         _phrase_hash(h, n)[one].view(np.int64), total, None, n)

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= SLICE_BYTES:
                yield from _slice(held, work)
                held, size = [], 0
        yield from _slice(held, work)
        np.minimum(table, min_count, out=table)
        width = -(-counters // SLICES)
        for s in range(SLICES if hashed else 0):
            part = table[s * width:(s + 1) * width]
            nz = np.nonzero(part)[0]
            if len(nz):
                data = nz.astype("<u4").tobytes() + part[nz].astype("<u1" if min_count < 256 else "<u4").tobytes()
                yield _rows(pa, 1, None, None, np.array([s]), np.array([len(nz)]), data, 0)
    return run


def _binary(pa, data: np.ndarray, ends: np.ndarray):
    """Arrow array of the byte strings that end at ``ends``, one after another."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [
        None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


COUNTED = "kind int, lang string, phrase binary, h long, f long, data binary, k int"


def _rows(pa, kind, langs, phrases, h, f, data, k):
    n = len(h)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.string()) if langs is None else langs.cast(pa.string()),
        pa.nulls(n, pa.binary()) if phrases is None else phrases.cast(pa.binary()), pa.array(h, pa.int64()), pa.array(f, pa.int64()),
        pa.nulls(n, pa.binary()) if data is None else pa.array([data], pa.binary()), pa.array(np.full(n, k, np.int32))],
        ["kind", "lang", "phrase", "h", "f", "data", "k"])


def _slice(held, work):
    """``work`` over the chunks of some batches (lang, chunk, counted, freq)."""
    import pyarrow as pa

    if not sum(b.num_rows for b in held):
        return
    t = pa.Table.from_batches(held).combine_chunks()
    data, offsets = text_buffer(t.column(1))
    yield from work(t.column(0).combine_chunks().dictionary_encode(), data, offsets[1:], t.column(2).to_numpy(), t.column(3).to_numpy())


def _add_up(counters: int, min_count: int):
    """Task function: counter slices -> (slice, bitmap of counters that reach the minimum)."""
    def run(batches):
        import pyarrow as pa

        width = -(-counters // SLICES)
        sums: dict = {}
        for b in batches:
            for s, n, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                at = np.frombuffer(data[:4 * n], "<u4")
                total = sums.setdefault(s, np.zeros(width, np.uint32))
                total[at] += np.frombuffer(data[4 * n:], "<u1" if min_count < 256 else "<u4")
                np.minimum(total, min_count, out=total)
        for s, total in sums.items():
            yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int64()),
                                              "bits": [np.packbits(total >= min_count, bitorder="little").tobytes()]})
    return run


def _phrase_counts(spark, chunks: DataFrame, words: int, max_words: int, min_count: int) -> list[DataFrame]:
    """Exact counts ``lang, phrase, h, k, f`` by length of 1, of 2 and of more
    words; of the phrases that reach ``min_count`` only, but of all words."""
    counters = int(np.clip(1 << max(words // 2 - 1, 1).bit_length(), *FILTER))
    passes = [([1], 2), ([2], 3 if max_words > 2 else None), (list(range(3, max_words + 1)), None)]
    filters: list[bytes] = []
    out = []
    for no, (lengths, hashed) in enumerate(passes):
        if not lengths:
            break
        shipped = spark.sparkContext.broadcast(filters)
        rows, _ = materialize(chunks.select("lang", "chunk", "counted", "freq").mapInArrow(
            _count(lengths, hashed, shipped, counters, min_count), COUNTED), f"collocations-rows{no}")
        counts = rows.where("kind = 0").groupBy("lang", "phrase", "h", "k").agg(F.sum("f").alias("f"))
        counts, got = materialize(counts if no == 0 else counts.where(F.col("f") >= min_count), f"collocations-counts{no}",
                                  F.count(F.lit(1)).alias("n"))
        out.append(counts)
        if not got["n"] or hashed is None:
            break
        if no:  # the exact set takes the place of the counters
            filters[-1] = _exact_bits(counts, counters)
        width = counters // SLICES
        marks = np.zeros(counters // 8, np.uint8)
        slices = rows.where("kind = 1").select("h", "f", "data").repartition(SLICES, "h").mapInArrow(
            _add_up(counters, min_count), "s long, bits binary")
        for r in slices.collect():  # SLICES rows, counters / 8 bytes together
            marks[r["s"] * width // 8:(r["s"] + 1) * width // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
        filters.append(marks.tobytes())
    return out


def _exact_bits(counts: DataFrame, counters: int) -> bytes:
    """Bitmap of the counters of the phrases in ``counts``: counters / 32768 rows of 4 kB."""
    bits = (counts.select(F.expr(f"(h & {counters - 1}L) + 1").alias("p")).groupBy(F.expr("bitmap_bucket_number(p) - 1").alias("s"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect())
    out = np.zeros(counters // 8, np.uint8)
    for r in bits:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[:len(out)]
        out[r["s"] * 4096:r["s"] * 4096 + len(part)] = part
    return out.tobytes()


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, top: int = TOP, longer_percent: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the ``top``
    phrases of 2 .. ``max_words`` words that occur at least ``min_count`` times.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces
    and those at spaces and tabs into words; n counts the words of a language,
    f(phrase) its occurrences within pieces. Cutting a phrase of a = f(phrase)
    in two gives l and r, the counts of both parts, and floor(1000 a n / (l r));
    the lowest score over all cuts counts, at the earliest cut that has it.
    Phrases inside a longer one with 100 f(longer) >= longer_percent * a are
    dropped. Order: score, a (both descending), phrase by its UTF-8 bytes.

    A null text is empty, a null language is ``und``; repeated rows count as
    often as they are there; texts without words, empty tables and languages
    without a frequent phrase give no rows. Other columns are not looked at.
    A text is one piece of work: some 60 bytes of memory per byte.
    """
    spark = df.sparkSession
    texts = df.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                      F.concat(lower_ascii(F.coalesce(col(text_col), F.lit(""))), F.lit("\n")).alias("text"))
    with freeing_shuffles(spark):
        parsed = texts.mapInArrow(_parse(max_words - 1, TRIGGER, LONGEST_CHUNK), "lang string, chunk binary, counted long, freq long")
        chunks, m = materialize(parsed.groupBy("lang", "chunk", "counted").agg(F.sum("freq").alias("freq")), "collocations-chunks",
                                F.coalesce(F.sum(F.col("counted") * F.col("freq")), F.lit(0)).alias("words"))
        counts = _phrase_counts(spark, chunks, m["words"], max_words, min_count)
        sizes = counts[0].groupBy("lang").agg(F.sum("f").alias("n"))
        known = counts[0].where(F.col("f") >= min_count)
        for c in counts[1:]:
            known = known.unionByName(c)
        known = known.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f"), "k")
        phrases = known.where("k > 1").withColumn("w", F.split("phrase", " "))
        cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"), "w", "k").select(
            "lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("left"),
            F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("right"))
        parts = known.select("lang", "phrase", "f")
        scored = (cuts.hint("merge").join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
                  .hint("merge").join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
                  .join(sizes, "lang")
                  .withColumn("score", F.expr(SCORE)))
        worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
        longer = (phrases.where("k > 2").select("lang", F.col("f").alias("longer"), F.explode(F.expr(
            "array(array_join(slice(w, 1, k - 1), ' '), array_join(slice(w, 2, k - 1), ' '))")).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
        kept = (worst.hint("merge").join(longer, ["lang", "phrase"], "left")
                .where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < longer_percent * F.col("a").cast("decimal(20,0)"))))
        kept, _ = materialize(kept.select("lang", "phrase", "a", "l", "r", "n", "score"), "collocations-kept")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase").cast("binary").asc())
    return (kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
