import random
import string

import pytest
from pyspark.sql import functions as F, types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

#: Names that the operators use inside; a table may have them too.
CLASHES = ["rid", "row", "gid", "digit", "rest", "fp", "root", "u", "bucket", "id", "names", "masks", "h", "m", "_text",
           "_letters", "n_tokens", "keep_id", "epoch", "segment", "pos"]


@pytest.fixture(scope="session")
def docs(spark):
    """A ``documents`` table from texts, (id, text) pairs or whole rows."""
    def make(rows, parts=3, clashes=False):
        full = []
        for i, r in enumerate(rows):
            if not isinstance(r, tuple):
                r = (i, r)
            if len(r) == 2:
                r = (*r, "en", f"src{i % 3}", len(r[1]) if r[1] is not None else None)
            full.append(r)
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        if clashes:
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df
    return make


def prose(rng: random.Random, words: int, vocab: int = 300) -> str:
    pool = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(vocab)]
    return " ".join(rng.choice(pool) for _ in range(words))


@pytest.fixture(scope="session")
def tricky_texts():
    """Nulls, empty and blank texts, copies, near copies, case variants, shared
    prefixes, a very long text, repeated characters, non-ASCII."""
    rng = random.Random(5)
    base = prose(rng, 120)
    long = prose(rng, 30000, 4000)
    texts = [None, None, "", " \n\t ", base, base, base.upper(), base + ".", base[:-1], base[:64], base[:64] + "x", base[:63],
             long, long, long + " end", long[:-3], "a" * 500, "a" * 300 + "b", "ÄÖ straße", "äö straße", "日本語 テスト 日本語",
             "x", "X", "one two", "one  two", "🙂 \x00 control"]
    texts += [" ".join([w if rng.random() > 0.02 else "zz" for w in base.split()]) for _ in range(10)]
    texts += [prose(rng, rng.randint(1, 80)) + " " + base[100:260] for _ in range(8)]
    return texts
