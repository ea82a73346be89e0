"""A training corpus from raw documents: five stages, each written as Parquet before the next one reads it.

1. quality: documents that the base rules or the line labels reject go.
2. near_dedup: of each class of near-duplicates the document with the smallest doc_id stays.
3. secrets: every span found is masked in the text.
4. mixing: documents are repeated by whole epochs and blocks until the source weights are met; none goes.
5. tokens: the token ids of every text, and digests that show the way back.

Null texts count as empty, so the first stage rejects them. Rows that share doc_id
and text are one document: they stay or go together. Other rows that share a
doc_id are judged row by row. Other columns pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import bpe, mixing, quality, secret_scan, simhash
from veilwork.llm.common import documents, stored
from veilwork.llm.queries import TOKENIZER

#: No source is repeated more often than this.
REPETITION = 2.0


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.Target(repetition=REPETITION))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_first),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: XXH64 fingerprints, the chain's training and byte-pair merges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
