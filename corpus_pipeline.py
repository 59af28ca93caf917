"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet in the shared checkpoint folder and rereads them as the next one's documents. All but the
last return the columns of ``documents``.

* language_id: rows without letters, or that their best language explains worse than chance, go.
* simhash_near_dedup: one row of each component of fingerprints within 2 bits stays.
* benchmark_decontamination: rows that hold a benchmark item, as it is, re-parameterised or as a passage, go.
* secret_scan: every row stays, secret values are replaced by ``[SECRET]`` and n_chars follows.
* best_fit_packing: one row per piece with its sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandlake.llm.common import save, table
from demandlake.llm.decontaminate import drop_leaks
from demandlake.llm.language_id import keep_identified
from demandlake.llm.packing import pack, pieces
from demandlake.llm.secret_scan import redact
from demandlake.llm.simhash import keep_one
from demandlake.llm.tokens import vocab_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), parts=True)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, vocab_path("byte_bpe_50k.json")))


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: The stages score, link and tokenise in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
