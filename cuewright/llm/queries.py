"""One query for each operator, over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, middle, ngram_join, packing, pii, quality, repeats, sharding, telephony, token_counts, token_files, windows
from .common import documents_of, shared_dir

SHARD_BYTES = 1 << 20


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents_of(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", judged["evidence_"].alias("evidence"), judged["posterior_"].alias("posterior"), judged["keep_"].alias("keep"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents_of(spark, sf_dir), SHARD_BYTES)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.stored_features(documents_of(spark, sf_dir))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents_of(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup_repeats(documents_of(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(documents_of(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_spans(token_files.read_token_files(spark, path))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents_of(spark, sf_dir))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.transform(documents_of(spark, sf_dir))
    told = cut.withColumn("digests", middle.digests(cut["output"], cut["form"]))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "digests.*")


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = windows.pack(documents_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_best_fit_packing, op2_token_counts, op3_quality_classifier, op4_sharding, op5_media_columns, op6_ngram_jaccard_join, op7_substring_dedup, op8_token_files, op9_pii, op10_benchmark_decontamination, op11_middle, op12_window_packing, op13_filter_audit]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.shard_sql(SHARD_BYTES), "op11_middle": middle.MIDDLE_SQL, "op13_filter_audit": filter_audit.AUDIT_SQL}
