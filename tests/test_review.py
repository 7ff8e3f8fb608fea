from rowgate.operators.review import review_sources, secret_lines

GOOD = """# Databricks notebook source
# MAGIC %md
# MAGIC # Orders load
# COMMAND ----------
# read the input path from a widget
path = dbutils.widgets.get("input_path")
password = dbutils.secrets.get(scope="s", key="db")
try:
    df = spark.read.parquet(path)
    df.write.mode("overwrite").saveAsTable("t")
except Exception as e:
    raise
print(df.limit(10).collect())
"""

BAD = """df = spark.read.csv("/mnt/raw/orders.csv")
token = "abc123secret"
rows = df.collect()
display(df)
df.write.save("/mnt/out")
"""


def test_review_verdicts(spark):
    files = spark.createDataFrame([("good.py", GOOD), ("bad.py", BAD)], "path string, text string")
    got = {(r.path, r.standard): r for r in review_sources(files).collect()}
    for std in ("secrets", "parameters", "documentation", "performance", "error_handling"):
        assert got[("good.py", std)].verdict == "PASS", std
        assert got[("bad.py", std)].verdict == "FAIL", std
    assert got[("bad.py", "secrets")].first_line == 2
    assert got[("bad.py", "parameters")].hits == 2
    assert [tuple(e) for e in got[("bad.py", "performance")].evidence] == [(3, "rows = df.collect()"), (4, "display(df)")]
    assert got[("good.py", "performance")].evidence == [] and got[("bad.py", "documentation")].evidence == []
    assert got[("bad.py", "error_handling")].first_line == 1


def test_try_without_top_level_io(spark):
    text = "try:\n    x = spark.read.table('a')\nexcept Exception:\n    pass\n"
    files = spark.createDataFrame([("f", text)], "path string, text string")
    got = {r.standard: r.verdict for r in review_sources(files).collect()}
    assert got["error_handling"] == "PASS"


def test_secret_lines_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secret_lines(docs, path="doc_id")
    assert found.count() == 12
    assert all('token = "' in r.line for r in found.collect())


def test_review_files_from_a_folder(spark, tmp_path):
    from rowgate.sources.tables import load_source_files
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "bad.py").write_text(BAD)
    (tmp_path / "good.py").write_text(GOOD)
    (tmp_path / "notes.txt").write_text("token = 'x1234'\n")
    files = load_source_files(spark, str(tmp_path))
    assert files.count() == 2
    got = {(r.path.rsplit("/", 1)[-1], r.standard): r for r in review_sources(files).collect()}
    assert got[("bad.py", "secrets")].first_line == 2
    assert got[("bad.py", "performance")].first_line == 3
    assert got[("good.py", "secrets")].verdict == "PASS"


BLOCKS = [  # (text, lines that read or write outside a try block)
    ("def load():\n    return spark.read.table('a')\ntry:\n    load()\nexcept Exception:\n    pass\n", [2]),
    ("try:\n    x = 1\nexcept Exception:\n    df.write.save(p)\nfinally:\n    spark.read.table('b')\n", [4, 6]),
    ("try:\n  if a:\n      for b in c:\n          spark.read.table(b)\n  spark.read.table('d')\nspark.read.table('e')\n", [6]),
    ("try:\n    x()\n\n# a comment\n    spark.read.table('a')\n", []),
    ("def f():\n    try:\n        try:\n            a()\n        except E:\n            spark.read.table('a')\n    except E:\n        pass\n", []),
    ("if a:\n\ttry:\n\t\tspark.read.table('a')\n        spark.read.table('b')\n", [4]),
    ("try : x = spark.read.table('a')\nspark.read.table('b')  # try:\n", [2]),
    ("# spark.read.table('a')\n  # try:\n    spark.table('b')\n", [3]),
    ("text = 1\n", []), ("", []), ("try:\n", []),
]


def test_each_read_and_write_belongs_to_its_block(spark):
    files = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BLOCKS)] + [(99, None)], "path int, text string")
    got = {r.path: r for r in review_sources(files).where("standard = 'error_handling'").collect()}
    for i, (text, want) in enumerate(BLOCKS):
        assert [e.line_no for e in got[i].evidence] == want, text
        assert (got[i].verdict, got[i].hits, got[i].first_line) == ("FAIL" if want else "PASS", len(want), want[0] if want else None)
    assert got[99].verdict == "PASS"


def test_block_rule_matches_a_plain_walk(spark):
    import random
    rng = random.Random(3)
    kinds = ["try:", "except E:", "x = spark.read.table('a')", "y()", "", "# spark.read", "def f():", "df.write.save(p)"]
    texts = ["\n".join(" " * (2 * rng.randint(0, 3)) + rng.choice(kinds) for _ in range(rng.randint(1, 25))) for _ in range(300)]

    def walk(text):
        out, lines = [], text.split("\n")
        for i, line in enumerate(lines):
            body = line.strip()
            if not ("spark.read" in body or ".write." in body) or body.startswith("#"):
                continue
            depth, guarded = len(line) - len(line.lstrip()), False
            for above in reversed(lines[:i]):
                if above.strip() and not above.strip().startswith("#") and len(above) - len(above.lstrip()) < depth:
                    depth = len(above) - len(above.lstrip())
                    guarded = guarded or above.strip() == "try:"
            out += [] if guarded else [i + 1]
        return out
    files = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    for r in review_sources(files).where("standard = 'error_handling'").collect():
        assert [e.line_no for e in r.evidence] == walk(texts[r.path]), texts[r.path]
