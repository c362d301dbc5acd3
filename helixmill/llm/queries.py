"""The queries op1 to op12 with production parameters, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmill.llm import ann, bpe, codes, langid, packing, pieces, quality, simhash, suffix, urls, warc
from helixmill.llm.common import table

RANKS, TOKENIZER, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(table(spark, sf_dir, "documents"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.length_histogram(bpe.encoded_lengths(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urls.CONTRACT), "action string, host string, path string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(codes.digest(books)))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), PIECES)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_warc, op4_simhash, op5_suffix_array, op6_token_counts, op7_language_id, op8_ann, op9_url_filters, op10_packing, op11_vector_codes, op12_sentencepiece)}
ORACLE = {"op2_quality": quality.ORACLE, "op9_url_filters": urls.ORACLE, "op11_vector_codes": codes.ORACLE}
