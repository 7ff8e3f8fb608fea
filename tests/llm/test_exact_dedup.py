import hashlib
from collections import defaultdict

from rowgate.llm.exact_dedup import drop_exact_copies, exact_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        sha, top = hashlib.sha256(t.encode()).hexdigest(), max(ids, key=lambda i: -1 if i is None else i)
        ids.remove(top)
        out += [(i, top, len(ids) + 1, k, sha) for i, k in [(top, True), *[(i, False) for i in ids]]]
    return sorted(out, key=repr)


def test_groups_match_brute_force(docs, tricky_texts):
    rows = list(enumerate(tricky_texts))
    got = exact_groups(docs(rows, clashes=True))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_small_digits_recurse_through_shared_prefixes(docs, tricky_texts):
    rows = [(i, t[:400] if t else t) for i, t in enumerate(tricky_texts)]
    got = exact_groups(docs(rows), first_digit=1, growth=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_repeated_rows_and_null_ids_keep_exactly_one(docs):
    rows = [(7, "same"), (7, "same"), (7, "SAME"), (None, "same"), (None, "alone"), (3, "other"), (3, "third"), (None, None)]
    got = exact_groups(docs(rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    left = drop_exact_copies(docs(rows, clashes=True))
    assert left.columns == docs(rows, clashes=True).columns
    assert sorted((r.text or "").lower() for r in left.collect()) == ["", "alone", "other", "same", "third"]


def test_hot_group_and_empty_table(docs):
    rows = [(i, "copy " * 30 if i % 3 else f"text {i}") for i in range(300)]
    assert sorted(map(tuple, exact_groups(docs(rows, parts=8)).collect()), key=repr) == brute(rows)
    assert exact_groups(docs([])).count() == 0 and drop_exact_copies(docs([])).count() == 0


def test_join_is_never_broadcast_or_windowed(docs):
    plan = exact_groups(docs([(1, "a"), (2, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan
