"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, segmentation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  All stages but the last return the columns of
``documents``; the last adds ``piece_ids``.

``ORACLE_SQL`` is None: zstandard ratios, XXH64 fingerprints and sampled segmentations are beyond
SQL.  The tests hold every stage against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearwave.llm.common import table
from nearwave.llm.compression_rules import keep_good
from nearwave.llm.decontaminate import without_leaks
from nearwave.llm.line_dedup import without_site_boilerplate
from nearwave.llm.piece_sampling import with_pieces
from nearwave.llm.simhash_dedup import keep_one_per_group
from nearwave.workdir import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word counts and compression bands keep."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source.

    Copies count once: they are still there, and a text must not become boilerplate by its own copies.
    """
    return without_site_boilerplate(docs, copies=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of a sampled segmentation."""
    return with_pieces(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_encoding", segmentation),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the segmented corpus."""
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
