"""From raw documents to packed training sequences.

Stages: language ID drops texts without a recognisable language, the line classifier
drops texts of low quality, the n-gram join keeps one document of each group of near
copies, and best-fit packing lays what is left out in sequences. Every stage reads what
its predecessor kept; all but the last return the columns of documents.

No stage can be put in SQL (trained models, a similarity join, a tokenizer), so
ORACLE_SQL is None and tests hold the stages against the operators' scores and brute force.

Edge cases: null and empty texts have no language, so they go in the first stage. Rows
with null ids take part in all but the near-copy stage, which keeps them. Repeated rows
are near copies of one another: one stays. Columns of any other name come through the
stages as they are. Without a labelled row the first stage keeps nothing, and without
two labels the second keeps all. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import best_fit_packing, chosen_path_join, language_id, quality_crf
from quern.llm._common import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and ones near chance level go."""
    return language_id.recognised(docs, language_id.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier predicts to be good."""
    return quality_crf.good(docs, quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return chosen_path_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence of 2048 tokens."""
    rows = best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", without_near_copies),
    ("best_fit_packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
