"""Registered queries of this subpackage: op<N>_<name>, and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.llm import bpe, byte_tokens, decontaminate, html_extract, jaccard_join, license_scan, lm_score, quality_rules, reshard, spelling_variants, suffix_dedup, token_alignment, token_files
from netwarden.llm.common import read

QUERIES = {}
ORACLE = {}


def _query(name, sql=None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return put


@_query("op4_quality_rules", quality_rules.ORACLE)
def op4(spark, d):
    return quality_rules.quality_report(read(spark, d, "documents"))


@_query("op9_license_scan", license_scan.ORACLE)
def op9(spark, d):
    return license_scan.scan(read(spark, d, "documents"))


@_query("op2_html_extract")
def op2(spark, d):
    return html_extract.extract_pages(read(spark, d, "pages"))


@_query("op5_bpe")
def op5(spark, d):
    import public_tokenizers
    return bpe.encode_digest(read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op7_token_files")
def op7(spark, d):
    import public_tokenizers
    return token_files.file_report(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                   end_id=2, n_ids=49_408)


@_query("op1_decontaminate")
def op1(spark, d):
    return decontaminate.find_leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


@_query("op6_reshard")
def op6(spark, d):
    # the old layout: the corpus lies in eight shards by source
    return reshard.shard_report(read(spark, d, "documents"), F.pmod(F.xxhash64("source"), F.lit(8)))


@_query("op10_lm_score")
def op10(spark, d):
    return lm_score.score_documents(read(spark, d, "documents"))


@_query("op3_jaccard_join")
def op3(spark, d):
    return jaccard_join.near_duplicates(read(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


@_query("op8_suffix_dedup")
def op8(spark, d):
    return suffix_dedup.dedup_report(read(spark, d, "documents"))


@_query("op13_byte_tokens")
def op13(spark, d):
    import public_tokenizers
    return byte_tokens.token_digests(read(spark, d, "documents"),
                                     public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op12_token_alignment")
def op12(spark, d):
    import public_tokenizers
    return token_alignment.alignment_report(read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                            public_tokenizers.path("piece_bpe_32k.model"))


@_query("op11_spelling_variants")
def op11(spark, d):
    return spelling_variants.variants(read(spark, d, "documents"))
