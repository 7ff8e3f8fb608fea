"""Registered queries of the llm operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import materialize, scratch_path, table
from .collocations import collocations
from .exact_dedup import exact_groups
from .hard_negatives import mine_hard_negatives
from .langid import identify_languages
from .mixing import mix
from .repeats import remove_repeats
from .repetition import repetition_rules
from .rollups import TokenRollup, count_tokens
from .sentencepieces import encode_texts
from .simhash import near_duplicates
from .token_output import token_output
from .topk import exact_topk
from .toxicity import score_toxicity



def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; it must be the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark, sf):
    return exact_topk(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_language_id(spark, sf):
    return identify_languages(table(spark, sf, "documents"))


def op3_token_output(spark, sf):
    return token_output(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_token_counts(spark, sf):
    """Rollup of a feed over all documents: three batches of inserts, one of
    which is sent twice; then the end-of-document id of all long documents is
    counted too (revisions) and documents that are too short go (deletes)."""
    docs = table(spark, sf, "documents")
    versions = {"word_bpe_49k": tokenizer_file("word_bpe_49k.json"), "piece_32k": tokenizer_file("piece_bpe_32k.model")}
    keep = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    counts, _ = materialize(count_tokens(docs, versions, keep, library=True), "token-counts")
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    part = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(3))
    inserts = [counts.where(F.coalesce(part, F.lit(0)) == i).withColumn("op", F.lit("insert")) for i in range(3)]
    for i in (0, 1, 1, 2):
        rollup.commit(f"insert-{i}", inserts[i])
    rollup.commit("end-ids", counts.where("n_chars > 2000").select(
        F.lit("revise").alias("op"), "doc_id", "source", "lang", "tokenizer", (F.col("n_tokens") + 1).alias("n_tokens")))
    rollup.commit("too-short", counts.where("n_chars < 200").withColumn("op", F.lit("delete")))
    return rollup.totals()


def op5_exact_dedup(spark, sf):
    return exact_groups(table(spark, sf, "documents"))


MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {"src0": 2}}


def domain_of(source):
    """Domain of a source, by the last digit of its name."""
    return (F.when(F.right(source, F.lit(1)).isin(*"01234"), "web").when(F.right(source, F.lit(1)).isin(*"567"), "books")
            .otherwise("code"))


def op6_mixing(spark, sf):
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mix(table(spark, sf, "documents"), levels, MIX_WEIGHTS, share=(6, 10), max_epochs=2, seed=17)


def op7_repeats(spark, sf):
    return remove_repeats(table(spark, sf, "documents"), length=50)


def op8_sentencepiece(spark, sf):
    return encode_texts(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_simhash(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), shingle=3, radius=3)


def op10_toxicity(spark, sf):
    return score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_repetition(spark, sf):
    return repetition_rules(table(spark, sf, "documents"))


def op12_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10,
                               low_percent=30, high_percent=90)


def op13_collocations(spark, sf):
    return collocations(table(spark, sf, "documents"), max_words=5, min_count=100, top=2000, longer_percent=100)


QUERIES = {
    "op1_topk": op1_topk,
    "op2_language_id": op2_language_id,
    "op3_token_output": op3_token_output,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_repeats": op7_repeats,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_repetition": op11_repetition,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}
