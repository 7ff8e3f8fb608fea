import random
import re

import numpy as np
import pytest

from rowgate.llm import repetition
from rowgate.llm.repetition import COVERAGE_LIMITS, duplicated_windows, repetition_rules

from .conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    for n in (*COVERAGE_LIMITS, 8):
        where = {}
        for i in range(len(words) - n + 1):
            where.setdefault(tuple(words[i:i + n]), []).append(i)
        inside = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(n)}
        if n == 8:
            out["n_repeat_words"] = len(inside)
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in inside)
    seen, out["n_dup_lines"], out["dup_line_chars"] = set(), 0, 0
    for line in text.split("\n"):
        if line in seen and WORD.search(line):
            out["n_dup_lines"] += 1
            out["dup_line_chars"] += sum(map(len, WORD.findall(line)))
        seen.add(line)
    out["base_failed"] = len(words) < 20 or 100 * out["n_repeat_words"] > 30 * len(words)
    out["kept"] = (not out["base_failed"] and 100 * out["dup_line_chars"] <= 20 * out["word_chars"]
                   and all(100 * out[f"dup_chars_{n}"] <= most * out["word_chars"] for n, most in COVERAGE_LIMITS.items()))
    return out


def check(df, rows):
    got = sorted((tuple(sorted((k, v) for k, v in r.asDict().items())) for r in repetition_rules(df).collect()), key=repr)
    want = sorted((tuple(sorted({"doc_id": i, **brute(t)}.items())) for i, t in rows), key=repr)
    assert got == want


def repeats(rng):
    base = prose(rng, 60, 40)
    words = base.split()
    yield base + "\n" + base
    yield "\n".join([base, "a line of its own", base, "a line of its own", " a line of its own"])
    yield " ".join(words[:25] + words[5:17] + words)
    yield "x " * 400
    yield "a b c d e f g h i j\n\n\n" * 3
    yield "one two three four five six seven eight nine ten " * 2 + prose(rng, 100, 5000)
    yield prose(rng, 3000, 12)
    yield "## ** $$ %% && || <> " * 4


def test_matches_brute_force(spark, docs, tricky_texts):
    rng = random.Random(1)
    texts = tricky_texts + list(repeats(rng)) + [None, "\n", "\r\n\x0b\x0c", "    x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two"), (3, "copy"), (3, "copy")]
    check(docs(rows, clashes=True), rows)


def test_slices_do_not_matter(spark, docs, monkeypatch):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate([*repeats(rng)] * 3)]
    monkeypatch.setattr(repetition.byte_slices, "__defaults__", (600,))
    check(docs(rows, parts=1), rows)


def test_empty_table(spark, docs):
    out = repetition_rules(docs([]))
    assert out.count() == 0 and dict(out.dtypes)["kept"] == "boolean" and dict(out.dtypes)["n_words"] == "bigint"


def test_a_collision_starts_again(monkeypatch):
    real, calls = repetition._numbers, []

    def weak(n, seed):
        calls.append(seed)
        return np.zeros(n, np.uint64) if len(calls) < 4 else real(n, seed)
    monkeypatch.setattr(repetition, "_numbers", weak)
    ids = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2])
    got = duplicated_windows(ids, np.array([0, 6, 9]), [2, 3])
    assert got[2].tolist() == [0, 3] and got[3].tolist() == [] and len(calls) > 2


@pytest.mark.parametrize("words", [200_000])
def test_one_very_long_text(spark, docs, words):
    rng = random.Random(3)
    text = prose(rng, words, 5000)
    r = repetition_rules(docs([(1, text + "\n" + text[:len(text) // 2])], parts=1)).first()
    assert r.n_words > words and not r.kept and r.base_failed
