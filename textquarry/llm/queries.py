"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, filter_audit, line_dedup, merkle, neardup, ngram_join, pii, quality_crf, quality_rules, secrets, token_count, warc
from .common import table


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    out = quality_crf.score(docs, model, carry=["doc_id"])
    return out.select("doc_id", quality_crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "bad_lines")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path, directory = warc.archive(pages, spark)
    read = warc.lookup(warc.page_keys(pages), directory, path)
    stored = F.col("record_type") == "response"
    kind = pages.schema["page_id"].dataType
    return read.select(
        F.when(F.col("page") != "", F.col("page")).cast(kind).alias("page_id"),
        F.when(stored, F.octet_length("body")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(stored, warc.base32_sha1(F.col("body"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers") != "", F.col("refers")).cast(kind).alias("refers_to"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, carry=["doc_id"], back=True)
    return bpe.bpe_digest(encoded)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_documents(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return decontam.contamination_digest(found)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows; the tampered leaf of every seventh id or so is folded with the original siblings."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.col("n_chars").cast("decimal(38,0)") + F.when(chosen, 1).otherwise(0)
    tampered = merkle.leaf_digest("doc_id", "source", "lang", changed, "text")
    out = merkle.manifest(table(spark, sf_dir, "documents"), fields, extra={"tampered": tampered})
    out = out.withColumn("proof_sha256", F.sha2(merkle.proof().cast("binary"), 256)).withColumn("folded_root", merkle.folded("tampered"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_crf, op2_pii, op3_token_count, op4_line_dedup, op5_warc,
        op6_quality_rules, op7_byte_bpe, op8_near_dedup, op9_secrets, op10_decontamination,
        op11_filter_audit, op12_merkle_manifest, op13_ngram_join,
    )
}
