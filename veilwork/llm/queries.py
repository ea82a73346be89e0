"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import bpe, gru_lm, importance, license_scan, media_ts, mixing, periods, quality, secret_scan, simhash, sql, suffix_dedup, token_counts, warc
from veilwork.llm.common import documents, pages, stored

TOKENIZER = "byte_bpe_50k.json"


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.read_streams(stored(media_ts.write_streams(documents(spark, sf_dir))))


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(documents(spark, sf_dir), mixing.Target(repetition=2.0))


def op3_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), limit=512)


def op4_merged_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(documents(spark, sf_dir))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives have damage between their records, so reading takes the search."""
    read = warc.read_archives(warc.archives(pages(spark, sf_dir), least=0, damage_every=warc.DAMAGE_EVERY)).where("kind = 'record'")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(documents(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("found")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.find(periods.planted(documents(spark, sf_dir))))


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.drawn(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transport_streams": op1_transport_streams,
    "op2_temperature_mix": op2_temperature_mix,
    "op3_whole_token_counts": op3_whole_token_counts,
    "op4_merged_suffixes": op4_merged_suffixes,
    "op5_line_quality": op5_line_quality,
    "op6_secret_spans": op6_secret_spans,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_covering_simhash": op9_covering_simhash,
    "op10_gru_scores": op10_gru_scores,
    "op11_license_scan": op11_license_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_draw": op13_importance_draw,
}

ORACLES: dict[str, str] = {
    "op2_temperature_mix": sql.MIXED,
    "op4_merged_suffixes": sql.REPEATS,
    "op6_secret_spans": sql.SECRETS,
    "op7_warc_salvage": sql.WARC,
    "op11_license_scan": sql.LICENSES,
    "op12_periodic_runs": sql.PERIODS,
    "op13_importance_draw": sql.IMPORTANCE,
}
