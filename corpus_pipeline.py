"""The corpus pipeline: STAGES applied in order to `documents`. Each stage's rows are
written as Parquet in the shared folder and reread as the next one's input, and what a stage
stored on the way is deleted then; every stage works on all rows that its predecessor
kept, and its decisions take effect.

1. quality rules: documents that fail the base rules, or whose host is rejected, go
2. n-gram Jaccard join (five words, 0.8): one document of each group of near copies stays
3. suffix-array dedup: 200-byte strings that repeat across the kept texts are cut out
4. benchmark decontamination: documents that hold a benchmark item go
5. BPE encoding: digests of the token ids and of the decoded text

No SQL form: byte strings that repeat anywhere and subword ids have none; the stages are
tested one by one and as a chain against brute force.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netwarden.llm import bpe, decontaminate, jaccard_join, quality_rules, suffix_dedup
from netwarden.llm.common import finished, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return finished(lambda: quality_rules.keep_good(docs), "pipeline-quality_rules")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return finished(lambda: jaccard_join.keep_one(docs, size=5, percent=80), "pipeline-jaccard_join")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return finished(lambda: suffix_dedup.remove_repeats(docs, n_chars="n_chars"), "pipeline-suffix_dedup")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return finished(lambda: decontaminate.drop_leaking(docs, read(spark, sf_dir, "benchmark")), "pipeline-decontaminate")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return finished(lambda: bpe.encode_digest(docs, public_tokenizers.path("byte_bpe_50k.json")), "pipeline-bpe")


STAGES = [("quality_rules", quality), ("jaccard_join", near_copies), ("suffix_dedup", repeated_strings),
          ("decontaminate", benchmark_leaks), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
