"""Token counts as delta-maintained rollups (operator 4).

Totals of documents and tokens by source, language and tokenizer version are
additive, so a batch of changes needs no recount: every change becomes signed
rows (what a document counted until now, negative; what it counts from now
on, positive), and their sums per group are the batch's delta. Totals are the
sum of all committed deltas. A ledger keeps the counts a batch has set, so
that later deletes and revisions know what to take off.

A commit has an id and is idempotent: committing the id again changes
nothing, and a commit that died half-way is overwritten by its repetition,
because ledger and delta are read only up to the last entry of the commit
log, which is written last. One writer at a time.

Deltas are partial sums made before the shuffle, so a source with a third of
all rows is one row a task; changes are joined to the ledger by document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import byte_slices, col, freeing_shuffles, materialize, text_buffer
from .sentencepieces import encode as encode_pieces, load_vocabulary
from .wordtokens import WordTokenizer

DIMS = ("source", "lang", "tokenizer")
COMMITS = "seq int, batch_id string, base int"
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, seq int"
DELTA = "source string, lang string, tokenizer string, documents long, tokens long, seq int"


class TokenRollup:
    """Totals under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], COMMITS).coalesce(1).write.mode("ignore").parquet(f"{self.path}/commits")

    def commits(self) -> list:
        """Committed batches, oldest first (one row a batch)."""
        return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").orderBy("seq").collect()

    def _log(self, seq: int, batch_id: str | None, base: int | None) -> None:
        self.spark.createDataFrame([(seq, batch_id, base)], COMMITS).coalesce(1).write.mode("append").parquet(
            f"{self.path}/commits")

    def _read(self, what: str, schema: str, last: int) -> DataFrame:
        if last == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}").where(F.col("seq") <= last)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, source, lang, tokenizer, n_tokens and,
        optionally, the order ``at``); False if ``batch_id`` is committed already.

        ``insert`` and ``revise`` set the count of a (document, tokenizer
        version), whether or not it had one, with its source and language;
        ``delete`` takes it off (of an unknown document: nothing). A tokenizer of
        null deletes the document under all versions. Of several changes of a
        batch to one pair the one with the largest ``at`` holds, at a tie the one
        largest by (op, tokens, source, lang). Null counts are 0, null source and
        language are groups of their own; a null id is one document. Any other
        op is an error.
        """
        log = self.commits()
        if any(r["batch_id"] == batch_id for r in log):
            return False
        last = max([r["seq"] for r in log], default=0)
        at = F.col("at").cast("long") if "at" in changes.columns else F.lit(0).cast("long")
        op = F.lower("op")
        rows = changes.select(
            col("doc_id").cast("long").alias("doc_id"), col("tokenizer").alias("tokenizer"),
            F.struct(at.alias("at"), F.when(op.isin("insert", "revise", "delete"), op).otherwise(
                F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null"))))).alias("op"),
                F.coalesce(col("n_tokens").cast("long"), F.lit(0)).alias("n"), col("source").alias("source"),
                col("lang").alias("lang")).alias("c"))
        with freeing_shuffles(self.spark):
            rows, m = materialize(rows.groupBy("doc_id", "tokenizer").agg(F.max("c").alias("c")), "rollup-changes",
                                  F.count_if(F.col("tokenizer").isNull()).alias("all_versions"))
            known = self._ledger(last, rows.select(F.col("doc_id").alias("changed")).distinct())
            if m["all_versions"]:
                gone = rows.where("tokenizer IS NULL AND c.op = 'delete'").select(F.col("doc_id").alias("gone"), "c")
                spread = known.join(gone, known["doc_id"].eqNullSafe(gone["gone"])).select("doc_id", "tokenizer", "c")
                rows = rows.where("tokenizer IS NOT NULL OR c.op <> 'delete'").unionByName(spread)
                rows = rows.groupBy("doc_id", "tokenizer").agg(F.max("c").alias("c"))
            old = known.withColumnsRenamed({"doc_id": "o_doc", "tokenizer": "o_tok"}).select(
                "o_doc", "o_tok", F.struct("source", "lang", "n_tokens").alias("old"))
            both = rows.join(old, F.col("doc_id").eqNullSafe(F.col("o_doc")) & F.col("tokenizer").eqNullSafe(F.col("o_tok")),
                             "left").select("doc_id", "tokenizer", "c", "old")
            seq = last + 1
            alive = F.col("c.op") != "delete"
            (both.where(alive | F.col("old").isNotNull())
             .select("doc_id", "tokenizer", F.col("c.source").alias("source"), F.col("c.lang").alias("lang"),
                     F.col("c.n").alias("n_tokens"), alive.alias("alive"))
             .write.mode("overwrite").parquet(f"{self.path}/ledger/seq={seq}"))
            signed = both.where("old IS NOT NULL").select(
                F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), "tokenizer",
                F.lit(-1).alias("d"), (-F.col("old.n_tokens")).alias("t")).unionByName(both.where(alive).select(
                    F.col("c.source").alias("source"), F.col("c.lang").alias("lang"), "tokenizer", F.lit(1).alias("d"),
                    F.col("c.n").alias("t")))
            (signed.groupBy(*DIMS).agg(F.sum("d").alias("documents"), F.sum("t").alias("tokens"))
             .where("documents <> 0 OR tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/delta/seq={seq}"))
        self._log(seq, batch_id, None)
        return True

    def _ledger(self, last: int, ids: DataFrame) -> DataFrame:
        """What the documents with id in ``changed`` count now, by tokenizer version."""
        entries = self._read("ledger", LEDGER, last)
        entries = entries.join(ids, entries["doc_id"].eqNullSafe(ids["changed"]), "left_semi")
        now = entries.groupBy("doc_id", "tokenizer").agg(
            F.max_by(F.struct("source", "lang", "n_tokens", "alive"), "seq").alias("v"))
        return now.where("v.alive").select("doc_id", "tokenizer", "v.source", "v.lang", "v.n_tokens")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` of all committed batches."""
        log = self.commits()
        last = max([r["seq"] for r in log], default=0)
        base = max([r["base"] or 0 for r in log], default=0)
        deltas = self._read("delta", DELTA, last).where(F.col("seq") > base).drop("seq")
        if base:
            deltas = deltas.unionByName(self.spark.read.schema(DELTA).parquet(f"{self.path}/base/seq={base}").drop("seq"))
        return (deltas.groupBy(*DIMS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
                .where("documents <> 0 OR tokens <> 0"))

    def compact(self) -> None:
        """Fold all committed deltas into one base; totals stay as they are."""
        last = max([r["seq"] for r in self.commits()], default=0)
        if last:
            self.totals().withColumn("seq", F.lit(last)).write.mode("overwrite").parquet(f"{self.path}/base/seq={last}")
            self._log(last, None, last)


def count_tokens(df: DataFrame, tokenizers: dict[str, str], keep: list, text_col: str = "text",
                 library: bool = False) -> DataFrame:
    """``keep`` (aliased by the caller) plus ``tokenizer, n_tokens``: one row
    per row and tokenizer version, counted on whole texts (null: empty).
    ``tokenizers`` maps versions to files: ``.json`` for the tokenizers library
    (see ``wordtokens``), ``.model`` for SentencePiece pieces: the model's own
    encoding with ``library``, else the best-scoring one of ``sentencepieces``
    (not the same for a BPE model)."""
    plain = df.select(*keep, col(text_col).alias("_text"))
    schema = plain.drop("_text").schema.add("tokenizer", "string").add("n_tokens", "long")
    pieces = {name: _model_bytes(path) if library else load_vocabulary(path)
              for name, path in tokenizers.items() if path.endswith(".model")}

    def run(batches):
        import pyarrow as pa

        words, models = {}, {}
        for b in batches:
            data, off = text_buffer(b.column(b.num_columns - 1))
            for name, path in tokenizers.items():
                if name not in pieces and name not in words:
                    words[name] = WordTokenizer(path)
                if library and name in pieces and name not in models:
                    import sentencepiece

                    models[name] = sentencepiece.SentencePieceProcessor(model_proto=pieces[name])
                count = np.zeros(b.num_rows, np.int64)
                for lo, hi in byte_slices(off, (1 if name in models else 8) << 20):
                    part = off[lo:hi + 1]
                    if name in models:
                        texts = [data[s:e].tobytes() for s, e in zip(part.tolist(), part[1:].tolist())]
                        count[lo:hi] = [len(ids) for ids in models[name].encode(texts, num_threads=1)]
                        continue
                    raw = data[part[0]:part[-1]], part - part[0]
                    count[lo:hi] = (encode_pieces(pieces[name], *raw) if name in pieces else words[name].encode(*raw))[1]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([name] * b.num_rows, pa.string()),
                                                  pa.array(count)], names=schema.names)

    return plain.mapInArrow(run, schema)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
