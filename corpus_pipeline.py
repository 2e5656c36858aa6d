"""The corpus pipeline: quality rules, near copies, benchmark passages, personal data, tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, common, decontam, jaccard, pii, quality


# All stages: null texts and ids, repeated rows and other columns pass as they are unless a docstring says otherwise; an
# empty table gives no rows; a column of docs that has the name of one that the operator adds keeps its own values.


def _beside(docs: DataFrame, added: Iterable[str], use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """use(docs) with the columns of docs alone, also those that have a name that the operator adds."""
    own = {c: f"__own_{c}" for c in docs.columns if c in added}
    out = use(docs.withColumnsRenamed(own))
    return out.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, null and empty texts among them."""
    trusted = common.read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _beside(docs, quality.NEW, lambda d: quality.quality_rules(d, trusted).where("kept"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the smallest doc_id, of each class that 5-word shingles with a similarity of 0.8 or more link.

    Of repeated rows one stays; texts without words are in no class and all stay.
    """
    return jaccard.drop_near_copies(docs, n=5, num=8, den=10)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of 10 words of a benchmark item; a null text has none."""
    items = common.read_table(spark, sf_dir, "benchmark")
    return _beside(docs, decontam.NEW, lambda d: decontam.find_hits(d, items, 10).where("n_hit = 0"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of personal data in its place in each text; n_chars, if there, follows the new text."""
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast("bigint"))
    return masked.select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each text; a null text has none."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", token_stage),
]

#: SQL can't express the hashed likelihood ratio or merging by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
