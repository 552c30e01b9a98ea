"""Ranked answers and the radius they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Pieces in which the rows of one group are merged before the last step.
MERGE_WAYS = 32


def top_k(pairs: DataFrame, k: int, by: tuple[str, ...] = ("qid",), ways: int = MERGE_WAYS) -> DataFrame:
    """The k nearest ``(id, dist)`` per group, ties to the smaller id, ranked from 1.

    Filtering a ``row_number`` makes Spark cut every task's rows to k per group before
    the shuffle.  What is left still grows with the number of tasks, so a group is first
    merged in pieces by a hash of the id.  ``ways=1`` is for pairs that come from few tasks for each group.
    """
    if ways == 1:
        return _nearest(pairs, k, by).select(*by, "rn", "id", "dist")
    piece = F.pmod(F.xxhash64("id"), F.lit(ways))
    merged = _nearest(pairs.withColumn("_piece", piece), k, (*by, "_piece")).drop("_piece", "rn")
    return _nearest(merged, k, by).select(*by, "rn", "id", "dist")


def _nearest(pairs: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("dist", "id"))
    return pairs.withColumn("rn", rank).filter(F.col("rn") <= k)


def answer_radius(answers: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Largest distance in each answer."""
    return answers.groupBy(*by).agg(F.max("dist").alias("radius"))
