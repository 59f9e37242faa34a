"""The corpus pipeline: quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet in the shared folder and
reads them again as the next one's documents, so that a lost executor never costs more than a stage. A stage's rows are removed once the
next one's are written; the last one's stay, since the result reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import packing, pii, quality, simhash
from lettermill.llm.common import Folder, bounded_batches, release, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; their cutoffs come from the labels."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more on five-word shingles."""
    bounded_batches(spark)
    return simhash.one_of_each(docs, size=5, similarity=0.8)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by marks."""
    bounded_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document lies in which training sequence, counted in words."""
    placed = packing.pack(docs.select("doc_id", packing.word_count("text").alias("size")), id_col="doc_id")
    return placed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("pii", personal_data_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents."""
    docs = table(spark, sf_dir, "documents")
    folder = Folder(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = folder.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            folder.drop(before)
        before = name
        release(spark)
    return docs


#: SQL has no BK-trees, transducers or best fit; the stages are tested against plain versions instead.
ORACLE_SQL = None
