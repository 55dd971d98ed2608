"""A corpus through five stages: toxicity, near duplicates, repeated passages, benchmark passages, tokens.

Each stage is a function of the session, the documents its predecessor kept and the folder of the tables.
Its result is written as Parquet in the shared checkpoint folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.llm import (
    common,
    decontamination,
    queries,
    sentencepiece_bpe,
    simhash,
    substring_dedup,
    toxicity,
)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half; it learns from the labelled ones of ``docs``. Null and
    empty texts score by the bias alone and stay; without labels everything stays. Null ids, repeated rows, very
    long texts and further columns stay as they are; an empty table stays empty."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (by fingerprints or five-word shingles), the one of smallest id,
    null ids last. Of texts without words (null ones too) one stays, and one of rows repeated with id and text. Texts
    are read whole; further columns stay; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds. A text goes if this stage took something from it
    and left nothing but white space; null, empty and blank texts that came in stay. Rows equal in id and text
    stay alike; a null id counts as the earliest; further columns stay; an empty table stays empty."""
    blank = common.unused(docs.columns, 1)[0]
    marked = docs.withColumn(blank, ~F.col("text").rlike(r"\S"))
    cleaned = substring_dedup.dedup_substrings(marked, keep_all_columns=True)
    return cleaned.where(F.col("text").isNull() | F.col(blank) | F.col("text").rlike(r"\S")).drop(blank)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates; null and empty texts stay, rows of one id and text go or stay
    together, further columns stay. Without a benchmark everything stays; an empty table stays empty."""
    return decontamination.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text. Null texts count as empty; null
    ids and repeated rows give a row each; an empty table gives an empty result."""
    return sentencepiece_bpe.encode_documents(docs, queries.PIECE_MODEL)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: No stage but the last is a closed SQL expression (a trained model, connected components); the tests hold
#: every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``; the result is the last one's, read from its table."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs
