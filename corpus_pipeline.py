"""A training-data pipeline over ``documents``: classify, remove boilerplate, deduplicate, decontaminate, encode.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's result to the shared
folder and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import bpe, decontam, line_dedup, neardup, quality_crf
from textquarry.llm.common import saved, table

#: Similarity in hundredths from which documents are near-duplicates here.
SIMILAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores at least 0.5.

    Without labels of both kinds all stay. Null and empty texts are scored as one empty line;
    repeated rows get the same score; columns of any name pass through.
    """
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    plain, names = _plain(docs)
    scored = quality_crf.score(plain, model, text_col=names["text"])
    return _named(scored.where("score >= 0.5"), names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; so do documents that consisted of nothing else (copies of the one that keeps them).

    Null texts stay null and empty ones empty; null sources are one site; the document with the
    smallest id keeps a line, and rows that repeat that id all do; columns of any name pass through.
    """
    plain, names = _plain(docs)
    text = names["text"]
    cleaned = line_dedup.dedup_lines(plain, site_col=names["source"], text_col=text, id_col=names["doc_id"])
    cleaned = cleaned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.col("n_removed") > 0
    new = cleaned.withColumn(text, F.when(changed, F.col("kept_text")).otherwise(F.col(text)))
    if "n_chars" in names:
        n_chars = names["n_chars"]
        new = new.withColumn(n_chars, F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars)))
    return _named(new, names)


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with nothing, and those names by the old ones."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(new).alias(old) for old, new in names.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 and more), the one with the smallest id.

    Texts that are null or have no words, and rows without an id, stay; repeated rows of a kept id all stay.
    """
    return neardup.keep_one(docs, percent=SIMILAR)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go.

    Null and empty texts have no words and stay; rows are taken one by one, so repeats and ties need no rule.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining text, their digest and that of the decoded bytes. Null texts are encoded as empty."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, carry=["doc_id"], back=True)
    return bpe.bpe_digest(encoded, carry=["ids"])


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("contamination", contamination), ("encoding", encoding)]

#: The classifier and the encoder are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
