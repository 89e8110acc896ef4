"""A training-data pipeline: quality rules, quality classifier, near-dedup, substring dedup and packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and all but the
last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm import near_copies, packing, quality_model, quality_rules, substring_dedup
from rastrel.llm._io import materialise, own_name, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule table keeps."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; the model learns from the labelled rows of the whole input table."""
    model = quality_model.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    named = (own_name("score", docs.columns), own_name("predicted", docs.columns))
    return quality_model.classify(docs, model, named=named).where(f"`{named[1]}` = 1").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their 5-word shingles), that of the smallest id."""
    return near_copies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id has; n_chars follows the text.

    A document of which nothing is left goes, as it was nothing but repeats."""
    words, gone = own_name("n_words", docs.columns), own_name("n_removed", docs.columns)
    kept = substring_dedup.dedup_substrings(docs, counts=(words, gone)).where(f"`{gone}` = 0 or `{gone}` < `{words}`")
    return kept.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near dedup", near_dedup), ("substring dedup", repeats), ("packing", pack)]

#: A trained model and components of near copies are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
