import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowgate.llm.common import scratch_path
from rowgate.llm.rollups import TokenRollup, count_tokens
from rowgate.llm.token_output import read_token_ids, token_output, write_token_ids
from rowgate.llm.wordtokens import WordTokenizer

from .conftest import prose

SF001 = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")

HARD = ["", "   ", "It's A <|endoftext|> b", "x'.s don't WE'LL 'sabc ''s .'s", "á ≠ x≠y Å Å İİ", "tab\tnew\nline\x0b\x0c\r z",
        "nul\x00x \x00 y", "ünï,côdé…  x y\x1cq \x85", "123abc45.6 1,2", "<|ENDOFTEXT|> <|startoftext|>hi", "...'s!!'t",
        "日本語 テスト,a.b", "a" * 5000, "é.", "<| x", "🙂😀a🙂.b", "a≠b ,̸", "K Å ﬁ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def batch(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def test_batches_equal_the_library_text_by_text(library):
    rng = random.Random(9)
    signs = "aAbé'.,-<|>!19 \n\t's"
    texts = HARD + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(400)]
    ids, count = WordTokenizer(WORDS).encode(*batch(texts))
    at = np.concatenate(([0], np.cumsum(count)))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == library(t), t


def test_plain_words_take_the_short_way_and_equal_the_library(library):
    """Letters of ASCII and Latin-1 are cut from signs and encoded without normaliser and regex."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdeßéöüÀÖÞ×÷ÿñ", k=rng.randint(1, 12))) + rng.choice(["", ".", ",", "'s", "!(", "\u0301", "\u0338.", "9"])
             + "".join(rng.choices("éxö .(", k=3)) for _ in range(3000)]
    tok = WordTokenizer(WORDS)
    slow, seen = tok._ids, []
    tok._ids = lambda items: (seen.extend(items), slow(items))[1]
    ids, count = tok.encode(*batch(texts))
    at = np.concatenate(([0], np.cumsum(count)))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == library(t), t
    words = ["wort", "größe", "été"]
    seen.clear()
    assert tok.encode(*batch([" ".join(words) + "."]))[0].tolist() == library("wort größe été.")
    assert not any(w in t for w in words for t in seen)


def test_index_equals_brute_force(docs, library, tricky_texts):
    rows = list(enumerate([*tricky_texts, *HARD])) + [(3, "repeated id"), (3, "repeated id"), (None, "no id")]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output(docs(rows, clashes=True), WORDS).collect())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = sorted((i is not None, i if i is not None else 0, len(library(t)) + 1, crc(library(t) + [2])) for i, t in rows)
    assert [(i is not None, i or 0) for _, i, _, _ in got] == [w[:2] for w in want]  # ascending ids, null first
    assert sorted((i is not None, i or 0, n, c) for _, i, n, c in got) == want
    assert [s for s, *_ in got] == np.concatenate(([0], np.cumsum([g[2] for g in got])[:-1])).tolist()


def test_files_hold_the_ids_and_lookups_use_their_metadata(docs, spark, library):
    rng = random.Random(1)
    rows = [(i, prose(rng, 20)) for i in range(0, 400, 2)]
    path = scratch_path(spark, "orc-test")
    write_token_ids(docs(rows), path, WORDS, end_id=2)
    got = {r.doc_id: r.ids for r in read_token_ids(spark, path).collect()}
    assert got == {i: library(t) + [2] for i, t in rows}
    one = read_token_ids(spark, path, doc_ids=[44, 45])
    assert [r.doc_id for r in one.collect()] == [44]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in read_token_ids(spark, path, first=10, last=14).orderBy("doc_id").collect()] == [10, 12, 14]


def test_empty_table(docs):
    assert token_output(docs([]), WORDS).count() == 0


def test_counts_of_both_tokenizers(docs, library, tricky_texts):
    from rowgate.llm.sentencepieces import encode, load_vocabulary

    model = public_tokenizers.path("piece_bpe_32k.model")
    vocab = load_vocabulary(model)
    rows = list(enumerate(tricky_texts))
    from pyspark.sql import functions as F
    got = {(r.doc_id, r.tokenizer): r.n_tokens
           for r in count_tokens(docs(rows, clashes=True), {"w": WORDS, "p": model}, [F.col("doc_id")]).collect()}
    for i, t in rows:
        assert got[i, "w"] == len(library(t))
        assert got[i, "p"] == int(encode(vocab, *batch([t or ""]))[1][0])


def test_piece_counts_of_the_query_are_those_of_the_model(spark):
    import sentencepiece

    from rowgate.llm.queries import op4_token_counts

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SF001}/documents.parquet").select("source", "lang", "text", "n_chars").collect():
        if r.n_chars >= 200:
            want[r.source, r.lang][0] += 1
            want[r.source, r.lang][1] += len(sp.encode(r.text or "")) + (r.n_chars > 2000)
    got = {(r.source, r.lang): [r.documents, r.tokens]
           for r in op4_token_counts(spark, SF001).where("tokenizer = 'piece_32k'").collect()}
    assert got == dict(want)


def test_library_counts_of_odd_texts(docs, tricky_texts):
    import sentencepiece
    from pyspark.sql import functions as F

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [*tricky_texts, *HARD]
    got = count_tokens(docs(list(enumerate(texts))), {"p": model}, [F.col("doc_id")], library=True).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}


CHANGE = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, at long, seq string"


def replay(batches):
    state = {}
    for rows in batches:
        last = {}
        for op, i, s, lang, tok, n, at, _ in rows:
            key = (i, tok)
            c = (at or 0, op, n or 0, s or "", lang or "", (s, lang))
            if key not in last or c[:5] > last[key][:5]:
                last[key] = c
        for (i, tok), c in last.items():
            if tok is None:
                for k in [k for k in state if k[0] == i]:
                    state.pop(k)
            elif c[1] == "delete":
                state.pop((i, tok), None)
            else:
                state[i, tok] = (*c[5], c[2])
    out = defaultdict(lambda: [0, 0])
    for (i, tok), (s, lang, n) in state.items():
        out[s, lang, tok][0] += 1
        out[s, lang, tok][1] += n
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def test_rollup_follows_a_feed_of_changes(spark):
    rng = random.Random(8)
    batches = []
    for b in range(4):
        rows = [(rng.choice(["insert", "revise", "delete"]) if b else "insert", rng.choice([None, *range(12)]),
                 rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["t1", "t2"]),
                 rng.choice([0, 5, 7, 1000, None]), rng.randint(0, 3), "x") for _ in range(25)]
        batches.append(rows)
    batches.append([("delete", 4, None, None, None, None, 0, "x"), ("delete", 99, "a", "en", "t1", 5, 0, "x")])
    rollup = TokenRollup(spark, scratch_path(spark, "rollup-test"))
    for n, rows in enumerate(batches):
        changes = spark.createDataFrame(rows, CHANGE)
        assert rollup.commit(f"b{n}", changes)
        assert not rollup.commit(f"b{n}", changes)  # sent twice
        assert sorted(map(tuple, rollup.totals().collect()), key=repr) == replay(batches[:n + 1])
        if n == 2:
            rollup.compact()
            assert sorted(map(tuple, rollup.totals().collect()), key=repr) == replay(batches[:3])


def test_commit_that_died_is_repeated(spark, monkeypatch):
    path = scratch_path(spark, "rollup-dies")
    rollup = TokenRollup(spark, path)
    first = spark.createDataFrame([("insert", 1, "a", "en", "t", 5, 0, "x")], CHANGE)
    second = spark.createDataFrame([("revise", 1, "a", "en", "t", 9, 0, "x"), ("insert", 2, "a", "en", "t", 1, 0, "x")], CHANGE)
    rollup.commit("one", first)
    monkeypatch.setattr(rollup, "_log", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        rollup.commit("two", second)
    again = TokenRollup(spark, path)
    assert [tuple(r) for r in again.totals().collect()] == [("a", "en", "t", 1, 5)]
    assert again.commit("two", second)
    assert [tuple(r) for r in again.totals().collect()] == [("a", "en", "t", 2, 10)]


def test_rollup_empty_batch_and_unknown_op(spark):
    rollup = TokenRollup(spark, scratch_path(spark, "rollup-empty"))
    assert rollup.totals().count() == 0
    assert rollup.commit("none", spark.createDataFrame([], CHANGE))
    assert rollup.totals().count() == 0
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("bad", spark.createDataFrame([("upsert", 1, "a", "en", "t", 5, 0, "x")], CHANGE))
