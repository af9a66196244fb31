"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists (name, function) in order.  A function takes the session, the
documents its predecessor kept and the folder of the tables, and returns the
documents that go on, with the columns of ``documents``; the last returns the
packed pieces.  Every stage handles null and empty texts, repeated rows and
empty input as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsieve.llm import catalog, line_dedup, mixing, packing, quality_rules, simhash
from alertsieve.llm.common import paths_table
from alertsieve.session import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return quality_rules.keep_good(docs.select(*COLUMNS), catalog.table(prepare(spark), sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; ``n_chars`` follows the text."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: 3-word shingles, 2 bits."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs.select(*COLUMNS), shingle=3, radius=2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights: documents repeat or go, and the last one
    a source's target reaches may be cut; ``n_chars`` follows the text."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    out = mixing.mix_documents(docs, mixing.pattern_weights(docs, catalog.MIX_WEIGHTS), budget=catalog.MIX_BUDGET,
                               max_epochs=catalog.MIX_EPOCHS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row a piece."""
    prepare(spark)
    return packing.pack_documents(docs, catalog.tokenizer_path(), end_id=1, window=2048)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: the near-duplicate stage hashes with XXH64, the packing stage tokenizes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written under the
    checkpoint folder before the next one reads it."""
    docs = catalog.table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = paths_table(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
