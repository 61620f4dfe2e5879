"""From raw documents to token ids, one operator a stage. Each stage reads what the one before has written.

quality: documents the classifier rejects go. lines: boilerplate lines of a source go. near_duplicates: of each group
one document stays, the one with the smallest id. mixture: a sample at the target weights of source, language and
topic. tokens: the ids of every text. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spectraloom.llm import bpe, jaccard, line_dedup, mixing, quality
from spectraloom.llm.common import Scratch, small_side, table
from spectraloom.llm.queries import PREDICTED_FROM, VOCABULARY, remainder


def own_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents' columns, which operators hand on in ``row``."""
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled documents of this stage's input."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return own_columns(quality.with_row(docs, model).where(F.col("score") >= PREDICTED_FROM), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of a text count as one page of their source: a text with many copies is no boilerplate."""
    cleaned = line_dedup.marked_pages(docs, "source", distinct=True)
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("cleaned").cast(kind)).otherwise(F.col("row.n_chars"))
    return cleaned.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row, the one with the smallest id; equal ids are told apart by text and row, null ids last."""
    scratch = Scratch(spark, "groups")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"),
                    F.monotonically_increasing_id().alias("number"))
    rows = scratch.keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                    name.alias("name")), "rows")  # written once: the numbers hold for all that follows
    groups = jaccard.similar_documents(rows.select("name", F.col("row.text").alias("text")), "name")
    gone = scratch.keep(groups.where("component_id <> doc_id").select(F.col("doc_id.number").alias("number")), "gone")
    rows = rows.withColumn("number", F.col("name.number"))
    return own_columns(rows.join(small_side(gone), "number", "left_anti"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return own_columns(mixing.weighed_documents(docs).where("kept"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, bpe.read_vocabulary(VOCABULARY)).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near_duplicates", one_of_each), ("mixture", mix),
          ("tokens", tokens)]

#: The classifier's training and the merges of a vocabulary file are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
