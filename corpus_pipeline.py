"""From raw documents to packed sequences: language ID, quality rules, near-duplicate removal, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents and leave out others. A null text is an empty one, which the
first stage rejects; rows without an id take part like others, after those with one; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, langid, packing, quality, substring
from lodestone.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("doc_id", "lang", "source")


def _document(rows: DataFrame, text) -> DataFrame:
    """The columns of documents, with a new text and its length."""
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    labelled = langid.identify_held_out(docs, COLUMNS)
    return labelled.where(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    return _document(quality.measured(docs, OTHERS).where("kept"), F.col("cleaned"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the first row with the smallest id; ids may repeat."""
    return jaccard.representatives(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeated windows cover; others keep their text as it is."""
    out = substring.dedup(docs, carry=(*OTHERS, "text"))
    return _document(out, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece and its place in a sequence."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the language model, the packing search or byte-pair merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
