import random

import numpy as np
from pyspark.sql import functions as F

from rowgate.llm.toxicity import score_toxicity, train_toxicity, word_hashes

from .conftest import prose
from .test_langid import held

BAD = ["grumble", "snotface", "dunderhead", "scumble", "ratbag"]


def corpus(n=500):
    rng = random.Random(3)
    rows, toxic = [], {}
    for i in range(n):
        words = prose(rng, rng.randint(5, 120), 3000).split()
        toxic[i] = int(rng.random() < 0.2)
        if toxic[i]:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(BAD) + rng.choice(["", ".", "!", "###"]))
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), "s", 0))
    return rows, toxic


def labels_of(spark, toxic):
    return spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(None, 1, 1), (9999, 0, None)],
                                 "doc_id long, quality int, toxic int")


def test_held_out_texts_are_told_apart(docs, spark):
    rows, toxic = corpus()
    odd = [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (None, "you ratbag", "en", "s", 0),
           (1002, prose(random.Random(1), 30000, 6000) + " Dunderhead!", "fr", "s", 0)]
    got = score_toxicity(docs(rows + odd, clashes=True), labels_of(spark, toxic)).collect()
    assert len(got) == len(rows) + 4
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [i for i in toxic if held(i)]
    right = sum(by_id[i].predicted == toxic[i] for i in test)
    assert right >= 0.95 * len(test)
    assert by_id[1000].score == by_id[1001].score and by_id[1000].predicted == 0
    assert by_id[None].predicted == 1 and by_id[1002].predicted == 1
    flagged = sum(by_id[i].flagged == bool(toxic[i]) for i in test)
    assert flagged >= 0.95 * len(test)


def test_scores_depend_on_the_text_alone(docs, spark):
    rows, toxic = corpus(200)
    model_rows, labels = docs(rows), labels_of(spark, toxic)
    one = score_toxicity(model_rows, labels).select("doc_id", "score").collect()
    again = score_toxicity(model_rows.withColumn("source", F.lit("other")), labels).select("doc_id", "score").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, again))


def test_sample_bound_and_missing_labels(docs, spark):
    rows, toxic = corpus(120)
    model = train_toxicity(docs(rows), labels_of(spark, toxic), sample=40)
    assert model is not None
    none = labels_of(spark, {}).where("doc_id = 1")
    got = score_toxicity(docs(rows[:3]), none).collect()
    assert [(r.score, r.predicted, r.flagged) for r in got] == [(0.0, 0, False)] * 3
    assert score_toxicity(docs([]), none).count() == 0


def test_word_hashes_see_words_only():
    def of(*texts):
        raw = [t.encode() for t in texts]
        return word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    one, two, count = of("Hello, World!", "", "  ", "hello", "world hello")
    assert count.tolist() == [2, 0, 0, 1, 2]
    assert one[0] == one[2] == one[4] and one[1] == one[3] and two[0] == two[2]
    assert (one[0], two[0]) != (one[1], two[1])
    a, b, n = of("ab", "cd")  # words do not run on into the next text
    assert n.tolist() == [1, 1] and a[0] == of("ab")[0][0]


def test_every_labelled_row_teaches(docs, spark):
    """A word that only stands in toxic rows beyond the first 2000 by hash, which once were the sample."""
    rng = random.Random(7)
    ids = [r.id for r in spark.range(12000).orderBy(F.xxhash64("id", F.lit(11)), "id").collect() if not held(r.id)]
    toxic = {i: int(k < 5000) for k, i in enumerate(ids[:7000])}
    rows = [(i, prose(rng, 8, 400) + (" ratbag" if k < 2000 else " zorkle" if k < 5000 else "")) for k, i in enumerate(ids[:7000])]
    rows += [(20000, prose(rng, 8, 400) + " Zorkle!"), (20001, prose(rng, 8, 400) + " ratbag"), (20002, prose(rng, 8, 400))]
    got = {r.doc_id: r.predicted for r in score_toxicity(docs(rows), labels_of(spark, toxic)).where("doc_id >= 20000").collect()}
    assert got == {20000: 1, 20001: 1, 20002: 0}


def test_weights_do_not_depend_on_how_rows_are_dealt(docs, spark, monkeypatch):
    monkeypatch.setattr("rowgate.llm.toxicity.BLOCK_ROWS", 60)
    rows, toxic = corpus(300)
    one, two = (train_toxicity(docs(rows, parts=p), labels_of(spark, toxic)) for p in (1, 5))
    assert (one.first == two.first).all() and (one.weight == two.weight).all() and one.thresholds == two.thresholds
    assert train_toxicity(docs(rows), labels_of(spark, {k: v for k, v in toxic.items() if k > 10 ** 6})) is None
