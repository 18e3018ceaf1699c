"""Registered queries of the corpus operators and their SQL twins.

Each query runs its operator with production parameters on the whole of its
table and derives the stated digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import byte_bpe, decontamination, embedding_dedup, filter_audit, language_id, license_scan, minhash_dedup, oracle, periodic_runs, pii, quotation, source_mixing, suffix_dedup, toxicity
from edgeloom.llm.columns import fold_of, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs, fold_of() != 0))
    return found.select("doc_id", (fold_of() == 0).alias("held_out"), "lang_pred", "score", "phrase_chars")


def op2_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.vector_links(read(spark, sf_dir, "embeddings"), 0.93)


def op3_levenshtein_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"), fold_of() != 0))
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted")


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotation.formatted(quotation.link_quotes(read(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "turn", "role", "thread", "reply_to", "n_quoted", "n_linked", "message")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_bwt_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(read(spark, sf_dir, "documents"), length=400)


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"), license_scan.built_in(spark))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op11_filter_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("share")


def op12_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.taken_words(read(spark, sf_dir, "documents"))


def op13_basic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.with_periodic_tail(read(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli")
    sums = [F.sha2(F.concat(listed, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")]
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *best, milli, *sums)


def corpus_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_cross_parsing, op2_int8_tiles, op3_levenshtein_lexicon, op4_quotation_links, op5_byte_bpe, op6_pigeonhole_edits, op7_bwt_expansion, op8_license_digests, op9_superminhash, op10_bootstrapped_pii, op11_filter_shapley, op12_block_mixing, op13_basic_factors)}


def corpus_sql() -> dict[str, str]:
    return {"op2_int8_tiles": oracle.INT8_TILES, "op4_quotation_links": oracle.QUOTATION_LINKS, "op8_license_digests": oracle.license_digests(), "op9_superminhash": oracle.SUPERMINHASH, "op11_filter_shapley": oracle.FILTER_AUDIT}
