import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rowgate.llm.sentencepieces import Vocabulary, decode, decode_ids, encode, encode_texts, load_vocabulary

from .test_tokens import HARD, batch

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return load_vocabulary(MODEL)


def viterbi(vocab, text):
    """Plain dynamic programming over the whole normalised text."""
    if not text:
        return []
    index = {p: i for i, p in enumerate(vocab.pieces) if vocab.kinds[i] == 0}
    t = ("▁" if vocab.dummy_prefix else "") + text.replace(" ", "▁")
    best = [(0, 0, None)] + [None] * len(t)
    for j in range(1, len(t) + 1):
        for i in range(max(0, j - vocab.longest), j):
            piece = t[i:j]
            if piece in index or j - i == 1:
                score = best[i][0] + (int(vocab.scores[index[piece]]) if piece in index else vocab.unknown_score)
                if best[j] is None or score > best[j][0]:
                    best[j] = (score, i, piece)
    out, j = [], len(t)
    while j:
        _, i, piece = best[j]
        if piece in index:
            out.append([index[piece]])
        else:
            out.append([int(vocab.byte_ids[x]) for x in piece.encode()] if vocab.byte_ids is not None else [vocab.unknown_id])
        j = i
    return [x for part in out[::-1] for x in part]


def test_ids_equal_plain_viterbi_and_the_library_decodes_them(vocab):
    rng = random.Random(6)
    texts = HARD + [" lead", "trail ", "a  b   c    d", "▁", "<s> </s> <unk> <0x41>"]
    texts += ["".join(rng.choices("etaoin shrdlu.,\né日X", k=rng.randint(1, 60))) for _ in range(300)]
    ids, count = encode(vocab, *batch(texts))
    at = np.concatenate(([0], np.cumsum(count)))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    back, off = decode(vocab, ids, count)
    for i, t in enumerate(texts):
        own = ids[at[i]:at[i + 1]].tolist()
        assert own == viterbi(vocab, t), t
        assert back[off[i]:off[i + 1]].tobytes().decode() == t.replace("▁", " ")
        assert sp.decode(own) == t.replace("▁", " ")


def test_ties_go_to_the_longer_last_piece_and_unknown_characters_to_the_unknown_id():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "aa", "aaa"]
    small = Vocabulary(pieces, np.array([0, -1, -2, -2, -4, -3, -4, -6]), np.array([3, 0, 0, 0, 0, 0, 0, 0]))
    texts = ["ab", "aaaa", "b a", "a?b", "??", "aab aab"]
    ids, count = encode(small, *batch(texts))
    at = np.concatenate(([0], np.cumsum(count)))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == viterbi(small, t), t


def test_query_columns_match_brute_force(docs, vocab, tricky_texts):
    rows = list(enumerate(tricky_texts)) + [(None, "no id"), (0, None)]
    df = docs(rows, clashes=True)
    short = [(i, t) for i, t in rows if len(t or "") < 2000]
    got = [tuple(r) for r in encode_texts(df, MODEL).collect()]
    assert len(got) == len(rows) and all(r[4] for r in got)
    want = []
    for i, t in short:
        ids = viterbi(vocab, t or "")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert not (set(want) - set(got))


def test_round_trip_through_columns(docs, tricky_texts):
    rows = [(i, t) for i, t in enumerate(tricky_texts)]
    ids = encode_texts(docs(rows), MODEL, ids=True)
    back = {r.doc_id: r.text for r in decode_ids(ids, MODEL, [F.col("doc_id")]).collect()}
    assert back == {i: t or "" for i, t in rows}
    none = decode_ids(ids.withColumn("ids", F.lit(None).cast("array<int>")), MODEL, [F.col("doc_id")])
    assert {r.text for r in none.collect()} == {None}
    assert encode_texts(docs([]), MODEL).count() == 0
