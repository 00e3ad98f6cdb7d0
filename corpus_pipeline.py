"""From raw documents to token ids in five stages, each an operator of ``proofledger.llm`` on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofledger.llm import byte_bpe, mixing, near_join, pseudonyms, weak_rules
from proofledger.llm.common import let_go, settle, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are more likely bad than good by the rules' votes, go."""
    return weak_rules.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more stays, that with the least doc_id."""
    return near_join.one_of_each(docs, size=5, share=(4, 5))


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms of their format."""
    return pseudonyms.pseudonymised(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document is taken up to twice."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed), n_tokens and the text that the ids decode to."""
    ids = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    return ids.select("doc_id", "ids", "n_tokens", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_values),
    ("mixing sources", source_mixture),
    ("byte-level BPE", token_ids),
]
#: Estimation, similarity classes, keyed permutations and merges by rank have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settled = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        let_go(*settled)
        settled = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
