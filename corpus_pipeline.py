"""From raw documents to token ids: toxic ones go, then repeated lines, near copies and benchmark leaks; the rest is encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
``documents``; the last returns digests of the ids and of the text decoded from them.

Edge cases: null and empty texts are never toxic, lose no lines and match no benchmark item; those and texts without words
are near copies of each other, so one of them stays. A null doc_id has no label, comes before others, and
documents that share a doc_id go together only where the benchmark leaks into one. Of rows that repeat a doc_id and text one
stays. Between near copies the least doc_id stays. Empty tables of documents, labels or benchmark are taken as
such: nothing is toxic without labels, nothing leaks without items. Very long texts are worked on whole. Further columns
pass through the stages but the last; names that start with ``_tx_``, ``_ld_``, ``_nc_`` and ``_dc_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_decode
from millrace.llm.common import forget, scratch, table
from millrace.llm.decontaminate import decontaminate
from millrace.llm.line_dedup import drop_repeated_lines
from millrace.llm.near_copies import keep_one
from millrace.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(docs).drop("_ld_deleted")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = encode_decode(docs, packed=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("bpe", bpe)]
#: The stages are beyond SQL (dictionaries, XXH64, BPE); the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            forget(spark, last)  # the next stage reads what has just been written
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
