import hashlib
import random
from collections import defaultdict

import pytest

from rowgate.llm.mixing import leaf_budgets, mix, mixed_documents


def fill(budget, children):
    """Plain water-filling: {child: (capacity, weight)} -> {child: tokens}."""
    got, left = {}, dict(children)
    while left:
        total = sum(w for _, w in left.values())
        full = {c: cap for c, (cap, w) in left.items() if w == 0 or cap * total <= w * budget}
        full = {c: (cap if left[c][1] else 0) for c, cap in full.items()}
        if not full:
            got.update({c: budget * w // total for c, (_, w) in left.items()})
            break
        got.update(full)
        budget -= sum(full.values())
        left = {c: v for c, v in left.items() if c not in full}
    return got


def brute_budgets(tokens, weights, levels, budget, epochs):
    """Recursive budgets of the leaves {path: tokens}."""
    weight = lambda i, v: weights.get(levels[i], {}).get(v, weights.get(levels[i], {}).get("*", 1))

    def cap(path):
        return sum(t * epochs for p, t in tokens.items() if p[:len(path)] == path
                   and all(weight(i, v) > 0 for i, v in enumerate(p)))
    out = {}

    def down(path, b):
        if len(path) == len(levels):
            out[path] = b
            return
        names = {p[len(path)] for p in tokens if p[:len(path)] == path}
        got = fill(b, {v: (cap((*path, v)), weight(len(path), v)) for v in names})
        for v in names:
            down((*path, v), got[v])
    down((), min(budget, cap(())))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_recursive_water_filling(spark, seed):
    rng = random.Random(seed)
    levels = ["a", "b", "c"]
    tokens = {(a, b, c): rng.choice([0, 3, 50, 1000, 10 ** 6]) for a in ("x", "y", None) for b in ("p", "q", None) for c in "123"
              if rng.random() < 0.8}
    weights = {"a": {"x": 5, "y": 2}, "b": {"p": 3, "*": 1, None: 0 if seed == 3 else 2}, "c": {"1": 7, "2": 1}}
    for share in (0, 1, 5, 9):
        budget = sum(tokens.values()) * share // 7
        leaves = spark.createDataFrame([(*p, t) for p, t in tokens.items()], "a string, b string, c string, tokens long")
        got = {tuple(r)[:3]: r.budget for r in leaf_budgets(leaves, levels, weights, budget, 2).collect()}
        assert got == brute_budgets(tokens, weights, levels, budget, 2)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("A", "small", 10), ("A", "big", 1000), ("B", "only", 1000)], "d string, s string, tokens long")
    got = {r.s: r.budget for r in leaf_budgets(leaves, ["d", "s"], {}, 400, 1).collect()}
    assert got == {"small": 10, "big": 190, "only": 200}  # what "small" lacks stays in A
    got = {r.s: r.budget for r in leaf_budgets(leaves, ["d", "s"], {"s": {"big": 0}}, 400, 1).collect()}
    assert got == {"small": 10, "big": 0, "only": 390}  # A is exhausted: B gets the rest


def brute_mix(rows, weights, num, den, epochs, seed):
    leaves = defaultdict(list)
    for r in rows:
        leaves[r[2], r[3]].append((r[0], len((r[1] or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budgets = brute_budgets(tokens, weights, ["lang", "source"], sum(tokens.values()) * num // den, epochs)
    out = []
    for leaf, b in budgets.items():
        for e in range(1, epochs + 1):
            if b <= 0:
                break
            start = 0
            order = sorted(leaves[leaf], key=lambda r: (hashlib.md5(f"{seed}:{e}:{r[0]}".encode()).hexdigest()[:15], r[0]))
            for i, n in order:
                take = min(n, b - start)
                if start < b or b >= tokens[leaf] > 0:
                    out.append((i, *leaf, e, n, take, tokens[leaf], budgets[leaf]))
                start += n
            b -= tokens[leaf]
    return sorted(out, key=repr)


@pytest.mark.parametrize("num, den, epochs", [(1, 2, 1), (6, 10, 2), (3, 1, 3), (0, 1, 1)])
def test_prefixes_of_seeded_epochs(docs, num, den, epochs, monkeypatch):
    from rowgate.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)  # several buckets a leaf
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) if i % 11 else None, rng.choice(["en", "de", None]),
             rng.choice(["hot", "hot", "s1", "s2"]), 0) for i in range(160)]
    weights = {"lang": {"en": 4}, "source": {"hot": 1, "s1": 5}}
    got = mix(docs(rows, clashes=True), ["lang", "source"], weights, (num, den), epochs, seed=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_mix(rows, weights, num, den, epochs, 3)


def test_whole_rows_repeats_and_empty_tables(docs):
    rows = [(1, "a b c", "en", "s", 0), (1, "a b c", "en", "s", 0), (None, "d", "en", None, 0), (2, None, None, "s", 0)]
    df = docs(rows, clashes=True)
    out = mixed_documents(df, ["lang", "source"], {}, (1, 1), max_epochs=1)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "d"), (1, "a b c"), (1, "a b c")]
    assert mix(docs([]), ["lang"], {}, (1, 2)).count() == 0
    assert mix(docs([None, ""]), ["lang"], {}, (1, 2)).count() == 0


def test_levels_may_have_any_name(docs):
    from pyspark.sql import functions as F

    names = ["tokens", "budget", "n", "w"]
    got = mix(docs([(i, "a b", "en", f"s{i % 2}", 0) for i in range(6)]), {n: F.col("source") for n in names}, {}, (1, 2))
    assert got.columns[1:5] == names and got.agg(F.sum("take_tokens")).first()[0] == 6


def test_native_plan(docs):
    plan = mix(docs(["a b", "c"]), ["lang", "source"], {}, (1, 1))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
