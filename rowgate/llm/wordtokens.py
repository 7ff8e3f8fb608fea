"""Batch encoding with the tokenizers library, one call per distinct piece.

A text is cut where the tokenizer cuts anyway and no rule looks across: at
ASCII white space, and between a letter of ASCII or Latin-1 and an ASCII sign
(never next to an apostrophe, which starts contractions). Each distinct piece of a batch
is encoded once by the library; the ids are then laid out per text. Texts
that hold the start of a special token are encoded whole.

This holds for tokenizers that lower-case, drop white space and split letters
from signs, such as ``word_bpe_49k.json``; it is not for others.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from .common import byte_slices, ragged, text_buffer

SEPARATOR = "\x00"  # encoded as one id of its own; pieces that hold it are encoded alone
CHUNK = 4000
END_OF_WORD = "</w>"


def _classes() -> np.ndarray:
    t = np.full(256, 3, np.uint8)
    for c in b" \t\n\r\x0b\x0c":
        t[c] = 0
    for c in range(33, 127):
        t[c] = 2
    for c in range(48, 58):
        t[c] = 3
    for c in range(97, 123):
        t[c] = t[c - 32] = 1
    t[ord("'")] = 3
    return t


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(bytes of the pieces end to end, piece offsets, first piece of each text)."""
    cls = _classes()[data]
    n = len(data)
    lead = np.nonzero(data[:-1] == 0xC3)[0]
    lead = lead[data[lead + 1] & 0xDF != 0x97]  # all of U+00C0 to U+00FF but the signs U+00D7 and U+00F7 are letters
    start = np.zeros(n, bool)
    if n:
        start[1:] = (cls[1:] != cls[:-1]) & ((cls[1:] + cls[:-1] == 3) & (cls[1:] != 0) & (cls[:-1] != 0)
                                             | (cls[:-1] == 0))
        end = lead[lead + 2 < n] + 2
        start[end[cls[end] == 2]] = True
        begin = lead[lead > 0]
        start[begin[cls[begin - 1] == 2]] = True
        start[0] = True
        start[offsets[:-1][offsets[:-1] < n]] = True
        start &= cls != 0
    solid = cls != 0
    place = np.cumsum(solid, dtype=np.int32)  # bytes kept up to and including each byte
    first = np.nonzero(start)[0]
    cut = np.append(place[first] - 1, place[-1] if n else 0)
    count = np.concatenate(([0], np.cumsum(start, dtype=np.int32)))
    return _lower()[data[solid]], cut.astype(np.int64), count[offsets].astype(np.int64)


def plain_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which (not empty) pieces are of lower-case letters of ASCII and Latin-1 alone: neither
    normalisation nor the split into words changes them."""
    good = (data >= 97) & (data <= 122)
    lead = np.nonzero(data[:-1] == 0xC3)[0]
    lead = lead[(data[lead + 1] >= 0x9F) & (data[lead + 1] <= 0xBF) & (data[lead + 1] != 0xB7)]
    good[lead] = good[lead + 1] = True
    return np.logical_and.reduceat(good, offsets[:-1]) if len(offsets) > 1 else np.zeros(0, bool)


class WordTokenizer:
    """Encodes batches of texts; ``word_tokenizer`` gives the one of this process."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self._ids([SEPARATOR])[0]
        # The library's model alone for plain words, given as lists: without normaliser and regex, their bytes
        # spelled as the byte-level step spells them. The last id of a word carries the suffix.
        self.plain, self.spelled = None, {}
        made = json.loads(self.tokenizer.to_str())
        if made["model"].get("end_of_word_suffix") == END_OF_WORD:
            steps = made["pre_tokenizer"] or {}
            if any(t.get("type") == "ByteLevel" for t in steps.get("pretokenizers", [steps])):
                step = ByteLevel(add_prefix_space=False, use_regex=False)
                self.spelled = {c: "".join(t for t, _ in step.pre_tokenize_str(chr(c))) for c in range(0xDF, 0x100)}
            made["normalizer"], made["pre_tokenizer"] = None, {"type": "WhitespaceSplit"}
            self.plain = Tokenizer.from_str(json.dumps(made))
            vocab = self.plain.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(END_OF_WORD)]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_piece_ids``, of words of plain letters; None if words cannot be told apart."""
        lengths, flat = [], []
        for lo in range(0, len(words), CHUNK):
            part = words[lo:lo + CHUNK]
            ids = np.array(self.plain.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            at = np.nonzero(self.ends[ids])[0]
            if len(at) != len(part) or at[-1] != len(ids) - 1:
                return None
            lengths.append(np.diff(at, prepend=-1))
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(lengths)

    def _all_ids(self, items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, first of each piece, ids per piece) of an Arrow binary array of pieces."""
        import pyarrow as pa

        text = lambda some: [b.decode("utf-8", "replace") for b in some.to_pylist()]
        data, off = text_buffer(items)
        plain = plain_pieces(data, off) & (self.plain is not None)
        words = None
        if plain.any():
            length = np.diff(off)[plain]
            row = np.full(int(length.sum()) + len(length), 32, np.uint8)  # plain pieces, a space after each
            row[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[np.repeat(plain, np.diff(off))]
            words = self._plain_ids(row[:-1].tobytes().decode().translate(self.spelled).split(" "))
        if words is None:
            ids, size = self._piece_ids(text(items))
            return ids, np.cumsum(size) - size, size
        others = self._piece_ids(text(items.filter(pa.array(~plain))))
        size, begin = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64)
        size[plain], size[~plain] = words[1], others[1]
        begin[plain] = np.cumsum(words[1]) - words[1]
        begin[~plain] = len(words[0]) + np.cumsum(others[1]) - others[1]
        return np.concatenate((words[0], others[0])), begin, size

    def _piece_ids(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, ids per piece)."""
        joined = len(self.separator) == 1
        lengths, flat = [], []
        for lo in range(0, len(items), CHUNK):
            part = items[lo:lo + CHUNK]
            gap = f" {SEPARATOR} "
            text = gap.join(part)
            if joined and text.count(SEPARATOR) == len(part) - 1:
                ids = np.array(self._ids([text])[0], np.int32)
                at = np.nonzero(ids == self.separator[0])[0]
                if len(at) == len(part) - 1:
                    lengths.append(np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1)
                    flat.append(np.delete(ids, at))
                    continue
            each = self._ids(part)
            lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
            flat.append(np.array([i for ids in each for i in ids], np.int32))
        if not items:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(flat), np.concatenate(lengths)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids per text) of UTF-8 texts laid end to end."""
        import pyarrow as pa

        n = len(offsets) - 1
        special = self._with_special(data, offsets)
        raw, cut, first = pieces(data, offsets)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1,
                                                 [None, pa.py_buffer(cut), pa.py_buffer(raw)])
        coded = array.dictionary_encode()
        ids, begin, size = self._all_ids(coded.dictionary)
        code = coded.indices.to_numpy()
        length = size[code]
        total = np.concatenate(([0], np.cumsum(length)))
        count = total[first[1:]] - total[first[:-1]]
        flat = ids[ragged(begin[code], length)]
        if not len(special):
            return flat, count
        parts, at = [], np.concatenate(([0], np.cumsum(count)))
        for i in range(n):  # rare: some text holds the start of a special token
            if i in special:
                own = np.array(self._ids([data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")])[0], np.int32)
                count[i] = len(own)
                parts.append(own)
            else:
                parts.append(flat[at[i]:at[i + 1]])
        return np.concatenate(parts), count

    def _with_special(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        at = np.nonzero((data[:-1] == 60) & (data[1:] == 124))[0] if len(data) > 1 else np.zeros(0, int)
        return set((np.searchsorted(offsets, at, side="right") - 1).tolist())

    def encode_slices(self, data: np.ndarray, offsets: np.ndarray, most: int = 32 << 20):
        """Yield (first text, last text, ids, ids per text) over bounded runs of texts."""
        for lo, hi in byte_slices(offsets, most):
            part = offsets[lo:hi + 1]
            ids, count = self.encode(data[part[0]:part[-1]], part - part[0])
            yield lo, hi, ids, count


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this process: Spark's Python workers serve many tasks, it is loaded once."""
    return WordTokenizer(path)
