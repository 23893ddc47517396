"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path
from . import bpe, decontaminate, embedding_dedup, html_extract, langid, license_scan, ngram_jaccard, periodic_runs, preference, sharding, toxicity, vector_codes, warc
from .common import discard_folder, materialise

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Whole texts go to Python in batches; 1,000 rows and, where long texts come together, 4 MB keep a batch small.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_preferences(preference.pair_neighbours(table(spark, sf_dir, "conversations")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, archives = fresh_path(spark, "warc-written"), fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), written, least_bytes=0)
    index = materialise(warc.normalise(spark, written, archives), "warc-index")
    discard_folder(spark, written)
    return warc.read_archives(index, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    tokens = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(tokens, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.find_runs(docs.withColumn("text", periodic_runs.periodic_text(F.col("doc_id"), F.col("text")))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(vector_codes.books_text(books).encode()).hexdigest()
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_decontamination, op3_html_extraction, op4_embedding_dedup, op5_preference_chat,
        op6_ngram_jaccard, op7_language_id, op8_warc, op9_byte_bpe, op10_toxicity, op11_periodic_runs, op12_vector_codes, op13_license_scan,
    )
}
SQL = {
    "op2_decontamination": decontaminate.SQL,
    "op5_preference_chat": preference.SQL,
    "op6_ngram_jaccard": ngram_jaccard.SQL,
    "op8_warc": warc.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_license_scan": license_scan.SQL,
}
