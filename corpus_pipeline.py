"""From raw documents to packed training sequences, stage by stage.

quality: documents that the classifier rejects go.  near_duplicates: one document of each group
stays.  decontamination: documents with a benchmark passage go.  pii: personal data is replaced by
its kind.  packing: the rest is tokenised and packed; it returns the pieces.

No stage can be said in SQL (a fitted model, shingle hashes, a tokenizer), so ORACLE_SQL is None.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import decontamination, ngram_join, packing, pii, quality
from cuewright.llm.common import documents_of, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judged(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("keep_").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("benchmark decontamination", decontamination_stage), ("PII", pii_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
