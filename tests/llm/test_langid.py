import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from rowgate.llm.common import sample_ids
from rowgate.llm.langid import add_language, identify_languages, keep_identified, subwords, train_language_model

SYLLABLES = {"en": ["th", "in", "er", "ou", "ing", "sh"], "de": ["sch", "ung", "ein", "ich", "ö", "keit"],
             "fr": ["eau", "ment", "é", "oi", "tre", "qu"]}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def corpus(n=400):
    rng = random.Random(2)
    return [(i, sentence(rng, lang, rng.randint(3, 60)), lang, f"src{i % 4}", 0)
            for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_contract(docs):
    rows = corpus()
    truth = {r[0]: r[2] for r in rows}
    odd = [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "12 !? 34", "fr", "s", 0),
           (None, sentence(random.Random(1), "de", 9), "de", "s", 0), (1003, sentence(random.Random(1), "fr", 30000), None, "s", 0)]
    got = identify_languages(docs(rows + odd, clashes=True)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got)
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[1003].lang_pred == "fr" and by_id[None].lang_pred == "de"
    assert not any(r.rejected for r in got if r.doc_id in truth)


def test_prediction_ignores_language_source_and_id(docs, spark):
    model = train_language_model(docs(corpus()))
    texts = docs([(1, "thinger shou"), (2, "schung öein")])
    other = docs([(8, "thinger shou", "xx", "zz", 9), (9, "schung öein", None, None, None)])
    preds = [sorted((r.lang_pred, r.score) for r in add_language(d, model, "text", []).collect()) for d in (texts, other)]
    assert preds[0] == preds[1]


def test_unknown_scripts_are_rejected_and_clean_rows_stay(docs):
    rng = random.Random(4)
    strange = [(2000 + i, "".join(chr(rng.randint(0x4E00, 0x6000)) for _ in range(300)), "en", "s", 0) for i in range(20)]
    rows = corpus()
    # strange rows are in the held-out fold, so training does not learn them as English
    strange = [(next(j for j in range(3000 + 50 * k, 9000) if held(j)), *r[1:]) for k, r in enumerate(strange)]
    df = docs(rows + strange, clashes=True)
    left = keep_identified(df)
    assert left.columns == df.columns
    ids = [r.doc_id for r in left.collect()]
    assert set(range(400)) <= set(ids)
    assert sum(i >= 3000 for i in ids) <= 6


def test_no_training_rows(docs):
    assert identify_languages(docs([])).count() == 0
    got = identify_languages(docs([(1, "words here", None, "s", 0)])).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got] == [("und", 0.0, True)]


def test_sample_of_a_class_above_two_to_the_23_rows(spark):
    n = (1 << 23) + (1 << 20)
    df = spark.range(n + 300).select("id", F.when(F.col("id") < n, "en").otherwise("de").alias("lang"))
    got = sample_ids(df, "id", "lang", 200, 7).collect()
    assert all(r.pri >= 0 for r in got)
    # about as many of each class, though one is 30,000 times the other
    assert len(got) == 200 and 70 <= sum(r["class"] == "de" for r in got) <= 130


def test_subwords_do_not_cross_texts():
    data = np.frombuffer("abcd".encode() + "efgh".encode(), np.uint8)
    both = [h.tolist() for h in subwords(data, np.array([0, 4, 8]))]
    first = [h.tolist() for h in subwords(data[:4], np.array([0, 4]))]
    for a, b in zip(both, first):
        assert a[:len(b)] == b
        assert all(x == 1 << 15 for x in a[len(b):4])
