"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spectraloom.llm import (bpe, byte_bpe, chat, chunking, filter_audit, jaccard, line_dedup, mixing, multi_index,
                             pitman_yor, quality, toxicity, vector_codes)
from spectraloom.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PREDICTED_FROM = 0.3


def remainder(n: int):
    """crc32 of the id as text, modulo n; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(pages, "source", distinct=True)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.read_vocabulary(VOCABULARY))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.mix_documents(docs).select("doc_id", F.coalesce("source", F.lit("")).alias("source"),
                                             F.coalesce("lang", F.lit("")).alias("lang"), "topic", "n_tokens",
                                             "probability", "kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return judged(quality.score(docs, model), remainder(5) == 0)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitman_yor.score_documents(table(spark, sf_dir, "documents"), remainder(10) != 0)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                       "base_score", "score")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.edited_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return judged(toxicity.score(docs, model), remainder(4) == 2)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.conversation_digests(chat.format_turns(rows.unionByName(more)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary.read(BYTE_VOCABULARY, public_tokenizers.PATTERN)
    rows = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("ident").alias("vec_id"), vector_codes.code_text("codes").alias("code"), "error",
                       "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_bpe, op3_ngram_jaccard, op4_mixing, op5_quality,
                                   op6_embedding_dedup, op7_pitman_yor, op8_fingerprints, op9_toxicity, op10_chat,
                                   op11_filter_audit, op12_byte_bpe, op13_vector_codes)}
SQL = {"op1_line_dedup": line_dedup.SQL, "op4_mixing": mixing.sql(), "op11_filter_audit": filter_audit.SQL,
       "op13_vector_codes": vector_codes.sql()}
