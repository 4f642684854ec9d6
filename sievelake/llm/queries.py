"""The queries ``opN_<name>``: each applies its operator to whole tables and derives the contract's columns."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, byte_bpe, exact_dedup, fingerprints, langid, licenses, line_dedup, mixing, ngram_join, token_files
from .shared import shared_dir, spread

QUERIES, ORACLE_SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe(
        documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        keep=("ids_sha256", "decoded_sha256"),
    )


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/sievelake/token_files-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return token_files.read_token_files(spark, path, keep=("ids_crc32",))


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", langid.fold("doc_id", 5) == 0)
    prototypes = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs, prototypes).select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")



@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "lines_removed", "chunks_removed", "text")


ORACLE_SQL["op1_exact_dedup"] = exact_dedup.ORACLE_SQL
ORACLE_SQL["op8_line_dedup"] = line_dedup.ORACLE_SQL


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir), words=4, threshold=85)


@query
def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = brown_lm.fit(docs.filter(langid.fold("doc_id", 7) != 2))
    held_out = langid.fold("doc_id", 7) == 2
    return brown_lm.score(docs, model).withColumn("held_out", held_out)
