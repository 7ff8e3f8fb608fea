import random
import re
from collections import Counter

import numpy as np
import pytest

from rowgate.llm import collocations as C
from rowgate.llm.collocations import collocations, parse_chunks

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count=3, top=50, max_words=5, longer_percent=100):
    f, n, out = {}, Counter(), []
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        best = []
        for p, a in cand.items():
            if 100 * inside[p] >= longer_percent * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(rng):
    texts = []
    for i in range(60):
        words = prose(rng, rng.randint(1, 120), 25).split()
        for j in range(3, len(words), rng.randint(4, 12)):
            words[j] += rng.choice([",", ".", "\n", ";", " ", "\t", ":\r", "!?", "\x0b"])
        texts.append(" ".join(words))
    texts += texts[:20]  # copies
    texts += [texts[3].upper(), "the same words " * 300, "a " * 900, "a,a,a,a", "Ä ä", "日本 語。日本 語", None, "", " \n. ", "x" * 5000, "NUL\x00 x y"]
    return [("en" if i % 3 else "de" if i % 2 else None, t) for i, t in enumerate(texts)]


def found(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).collect())


@pytest.mark.parametrize("trigger,longest", [(32, 1024), (3, 7), (1, 1024)])
def test_matches_brute_force(spark, docs, monkeypatch, trigger, longest):
    monkeypatch.setattr(C, "TRIGGER", trigger)
    monkeypatch.setattr(C, "LONGEST_CHUNK", longest)
    rows = corpus(random.Random(4))
    df = docs([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], clashes=True)
    assert found(df, min_count=3, top=50) == brute(rows)


def test_full_counters_only_cost_work(spark, docs, monkeypatch):
    """So few counters that nearly every phrase shares one: the counts stay exact."""
    monkeypatch.setattr(C, "FILTER", (512, 512))
    rows = corpus(random.Random(5))
    df = docs([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)])
    assert found(df, min_count=2, top=5000) == brute(rows, min_count=2, top=5000)


def test_other_lengths_and_shares(spark, docs):
    rows = corpus(random.Random(6))
    df = docs([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)])
    assert found(df, min_count=4, max_words=3, longer_percent=60) == brute(rows, 4, 2000, 3, 60)
    assert found(df, min_count=300, max_words=2) == brute(rows, 300, 2000, 2)


def test_nothing_to_find(spark, docs):
    assert found(docs([])) == [] and found(docs([(1, None), (2, " "), (None, "a b")])) == []


def test_products_beyond_64_bits(spark):
    """The score's arithmetic with counts of trillions."""
    a, n, left, right = 3 * 10 ** 12, 9 * 10 ** 16, 4 * 10 ** 12, 5 * 10 ** 12
    got = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").selectExpr(C.SCORE).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_equal_passages_give_equal_chunks_and_overlaps_count_once():
    rng = random.Random(7)
    passage = prose(rng, 400, 200)
    texts = [prose(rng, 30, 200) + " " + passage + " " + prose(rng, 30, 200) for _ in range(3)]
    data = np.frombuffer("".join(t + "\n" for t in texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) + 1 for t in texts])))
    doc, counted, at, size, text = parse_chunks(data, offsets, 4, 8)
    chunks = [bytes(text[a:a + s]) for a, s in zip(at, size)]
    assert counted.sum() == sum(len(t.split()) for t in texts)
    shared = Counter(chunks)
    assert sum(n for n in shared.values() if n == 3) > 0.7 * len(chunks)
