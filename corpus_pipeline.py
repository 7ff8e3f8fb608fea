"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. Every stage works on all its predecessor kept, null and
repeated rows included; all but the last return the columns of ``docs``,
whatever they are, as whole rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowgate.llm.common import scratch_path, table
from rowgate.llm.exact_dedup import drop_exact_copies
from rowgate.llm.langid import keep_identified
from rowgate.llm.mixing import mixed_documents
from rowgate.llm.queries import MIX_WEIGHTS, domain_of, tokenizer_file
from rowgate.llm.sentencepieces import encode_texts
from rowgate.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected. The classifier learns from
    ``docs`` outside the held-out fold."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (largest id) of each group of equal texts, A-Z lower-cased."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest id) of each SimHash component: 3-word shingles,
    3 or fewer differing bits."""
    return drop_near_duplicates(docs, shingle=3, radius=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as ``docs`` has, dealt to domain, language and source by
    target weights: sources short of their share come twice (two epochs),
    sources beyond it with a seeded prefix."""
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixed_documents(docs, levels, MIX_WEIGHTS, share=(1, 1), max_epochs=2, seed=17)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of whole texts, as counts and digests, one row per document
    and epoch, and whether decoding gives the text back."""
    return encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("encode", encode)]

#: Learned models and Viterbi segmentation are beyond SQL: tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
