"""A training-data pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and reads
it again for the next stage. An empty table gives an empty table, and columns beside those of documents are left behind, in every
stage; what a stage does with nulls, blanks and repeated rows is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregale.llm import bpe, jaccard, linededup, mixing, quality
from gregale.llm.common import Scratch, read

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows of the input, scores 0.5 or more.

    Null and empty texts get the score of a text without words; repeated rows and rows without an id are scored like any. Without
    labelled rows all score 0.5 and stay.
    """
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat elsewhere; those of which no line stays go. n_chars counts what stays.

    Null texts, rows without an id and texts of fewer than three lines stay as they are; rows of one id are told apart by their
    texts, and equal rows all stay or lose the same lines.
    """
    out = linededup.dedup_lines(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the smallest id.

    Texts without words link with nothing and stay, as do rows without an id. Rows that repeat the id that stays, stay.
    """
    groups = jaccard.similar_documents(docs).where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(groups, "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a row per copy.

    A null source is a source of its own; texts without words are taken as often as their source's whole passes say.
    """
    out = mixing.mix(docs.select(*COLUMNS)).where(F.col("copies") > 0)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the hash of what they decode to. Null texts have no tokens."""
    coded = bpe.code_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", fresh_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("mixing_sources", mixed),
    ("byte_level_bpe", tokens),
]

#: A trained classifier can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.keep_only(name)
    return docs
