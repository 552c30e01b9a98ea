"""Samples chosen by a hash of the series id, so they do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwave.functions.hashing import hash32, sample_threshold
from nearwave.operators.blocks import as_queries, series_envelope


def sample_fraction(sample_num: int, total: int) -> float:
    return min(1.0, sample_num / total) if total else 1.0


def in_sample(fraction: float, seed: int = 0) -> Column:
    """True for ids of a Bernoulli sample; samples of one seed are nested."""
    return hash32(seed, F.col("id")) < sample_threshold(fraction)


def bernoulli_sample(series: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Each row with probability ``fraction``, without replacement."""
    return series.filter(in_sample(fraction, seed))


def envelope_sample(series: DataFrame, fraction: float = 0.01, seed: int = 0) -> DataFrame:
    """``(id, smax, smin)`` of a Bernoulli sample."""
    return series_envelope(bernoulli_sample(series, fraction, seed))


def sample_series(series: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``min(n, rows)`` random series, for unique ids.

    The n smallest hashes are found on ids alone; series are then filtered by the last of them.
    """
    h = hash32(seed, F.col("id"))
    last = series.select(h.alias("h"), "id").orderBy("h", "id").limit(n).agg(F.max(F.struct("h", "id")).alias("m")).first().m
    if last is None:
        return series.limit(0)
    return series.filter((h < last.h) | ((h == last.h) & (F.col("id") <= last.id)))


def sample_queries(series: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Random series as packed queries ``(qid, pos, q)`` over all their positions."""
    return as_queries(sample_series(series, n, seed))
