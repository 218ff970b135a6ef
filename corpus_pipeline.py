"""The corpus pipeline: quality, toxicity, near-duplicates, benchmark leaks, tokens.

Each stage takes all that the one before kept. The fitted stages learn from the labelled rows of their own input, in
the learning fold (crc32 of the id, modulo 5, is not 0).

Null texts are empty documents to the classifiers, link with nothing, hold no item and have no tokens. Rows without an id
are judged like others, teach nothing and are no duplicates; of rows that share an id one stays. Texts of any length are
read whole. Other columns, whatever their names, are carried to the last stage. Empty tables give empty results: without
labels the classifiers keep what their prior keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forerun.llm import bpe_stream, decontaminate, ngram_join, quality, toxicity
from forerun.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (1) accepts."""
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (9) does not reject."""
    return toxicity.kept(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


#: The near-duplicate stage's own words of a shingle and percentage; the query of operator 5 has others.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join (5) links on 5-word shingles at 80 %."""
    return ngram_join.one_of_each(docs, k=NEAR_SHINGLE, percent=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the decontamination search (2) finds no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text (7)."""
    return bpe_stream.digests(docs, bpe_stream.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the fitted models, the edit search or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
