"""The corpus pipeline: documents through five stages, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a table:
the columns of documents for all stages but the last, which returns the pieces of packed
sequences. Every stage works on all rows that its predecessor kept.

Defined cases: columns beyond those of documents are left out; an empty table goes through all stages; a
null or empty text fails the quality rules (too few words); rows without an id are judged like others and
never count as the copy of another row; rows that repeat an id are told apart by their text, and of equal
rows one stays; very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsift.llm import minhash, packing, pii, quality, toxicity
from alertsift.llm.common import staged, table, unstaged
from alertsift.llm.toxicity_query import held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs).where(F.col("kept")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the limit; held-out labels stay unused here too."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.learn(docs, labels))
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the least id."""
    return minhash.one_of_each(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars follows the new text."""
    found = pii.find(docs.select(*COLUMNS), pii.fit(docs))
    clean = F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    return (
        found.withColumn("_clean", clean)
        .withColumn("n_chars", F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("n_chars")))
        .withColumn("text", F.col("_clean"))
        .select(*COLUMNS)
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_dedup_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # learnt scores and packing have no SQL form; tests hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if hasattr(before, "stage_path"):
            unstaged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
