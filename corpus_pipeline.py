"""The corpus pipeline: language ID, toxicity, near duplicates, decontamination, tokens.

Every stage takes what the one before it kept; all but the last return the columns of documents.

Documents whose text is null, empty or has no letter go in the first stage. Rows of a null doc_id are near copies of nothing and
leak nothing, so they pass both; of rows that repeat a doc_id each goes or stays with the others. An empty table gives an
empty one; further columns are carried along, and those that a stage makes for itself do not clash with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmirror.llm import bpe, decontaminate, langid, ngram_jaccard, toxicity
from eventmirror.llm.common import materialise
from eventmirror.llm.queries import VOCABULARY, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language is too uncertain."""
    return langid.keep_identified(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are predicted toxic."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies."""
    return ngram_jaccard.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, token ids and their hash; the ids decode to the text's bytes."""
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path)
    return bpe.decode(encoded.withColumn("tokens", F.col("ids")), path).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "tokens")


STAGES = [
    ("language_id", identified),
    ("toxicity", civil),
    ("ngram_jaccard", distinct),
    ("decontamination", clean),
    ("byte_bpe", tokens),
]

#: Trained models and merges are beyond SQL; tests hold run() against a version that goes row by row, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
