"""Search radii: a distance beyond which a series cannot be in the answer."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwave.operators.scan import Query, scan, scan_pairs
from nearwave.operators.topk import top_k


def sample_radius(
    sample: DataFrame, queries: list[Query], k: int, exclude_self: bool = False
) -> dict[int, float]:
    """k-th smallest true distance over a sample of the stored series.

    A subset's k-th distance is never below that of the whole set, so no member of the
    true answer lies beyond it.  Infinite where the sample has fewer than k series.
    """
    nearest = top_k(scan_pairs(scan(sample, queries, k, exclude_self=exclude_self)), k)
    rows = nearest.filter(F.col("rn") == k).select("qid", "dist").collect()
    found = {r.qid: r.dist for r in rows}
    return {q.qid: found.get(q.qid, inf) for q in queries}


def sample_rank(k: int, sample_num: int, total: int) -> int:
    """Rank in a sample that stands for rank k in the whole table."""
    return floor(k * (sample_num / total)) + 1 if total else 1


def estimated_radius(envelopes: DataFrame, queries: list[Query], rank: int) -> DataFrame:
    """``(qid, radius)``: the rank-th smallest envelope upper bound over a sample.

    The largest one if the sample has fewer rows.  An estimate only: fewer than k series
    may lie within it.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest = {q.qid: np.empty(0) for q in queries}
        for batch in batches:
            smax, smin = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for q in queries:
                bound = np.maximum(np.abs(smax - q.lo), np.abs(smin - q.hi))
                smallest[q.qid] = np.sort(np.concatenate([smallest[q.qid], bound]))[:rank]
        for qid, bound in smallest.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([qid] * len(bound), pa.int64()),
                    pa.array(np.arange(len(bound)), pa.int64()),
                    pa.array(bound),
                ],
                names=["qid", "id", "dist"],
            )

    bounds = envelopes.select("smax", "smin").mapInArrow(kernel, "qid BIGINT, id BIGINT, dist DOUBLE")
    return top_k(bounds, rank).groupBy("qid").agg(F.max("dist").alias("radius"))


def collect_radius(radii: DataFrame) -> dict[int, float]:
    return {r.qid: r.radius for r in radii.select("qid", "radius").collect()}
