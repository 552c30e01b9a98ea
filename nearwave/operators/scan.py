"""Full scan of a series table for packs of queries.

Each task streams Arrow batches of series past the queries and keeps only its own k
nearest per query.  No (query, series) pair is ever a row, and what leaves a task is at
most k rows per query whatever the size of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwave.functions.arrow import at_positions, flat_lists

# Points of the queries, and queries, that travel with the tasks at a time, about.
PACK_POINTS = 1 << 20
PACK_QUERIES = 1000
# Points looked at before rows already too far away are dropped: few at first, then more.
FIRST_STEP = 4
LARGEST_STEP = 64
# Values per step of a kernel, so that its working set stays near the cache.
VALUES_PER_STEP = 1 << 20

SCAN_SCHEMA = "qid BIGINT, id BIGINT, dist DOUBLE, kept BIGINT"


@dataclass(frozen=True)
class Query:
    """One packed query on the driver."""

    qid: int
    pos: np.ndarray
    q: np.ndarray

    @property
    def hi(self) -> float:
        return float(self.q.max())

    @property
    def lo(self) -> float:
        return float(self.q.min())


def check_unique(queries: DataFrame) -> None:
    """Raises if two rows share a query id."""
    if queries.groupBy("qid").count().filter("count > 1").limit(1).count():
        raise ValueError("query ids must be unique")


def n_packs(queries: DataFrame) -> int:
    """Packs that the queries fill, by their points or by their number."""
    size = queries.agg(F.sum(F.size("q")).alias("points"), F.count(F.lit(1)).alias("n")).first()
    return max(-(-(size.points or 0) // PACK_POINTS), -(-size.n // PACK_QUERIES))


def query_packs(queries: DataFrame) -> Iterator[list[Query]]:
    """All queries with points, a pack at a time: each is the queries of some hashes of the id."""
    check_unique(queries)
    n = n_packs(queries)
    rows = queries.filter(F.size("q") > 0).select(
        F.col("qid").cast("bigint"), F.col("pos").cast("array<bigint>"), F.col("q").cast("array<double>")
    )
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) if n > 1 else rows
        found = [Query(r.qid, np.array(r.pos, np.int64), np.array(r.q, np.float64)) for r in part.collect()]
        if found:
            yield sorted(found, key=lambda q: q.qid)


def distances(matrix: np.ndarray, q: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (columns of ``matrix``) within ``limit`` of ``q``, and their distances.

    ``matrix`` is (position, row).  Rows with NaN (too short) are never within.
    """
    alive = np.arange(matrix.shape[1])
    dist = np.zeros(len(alive))
    start, step = 0, FIRST_STEP
    while start < len(q) and len(alive):
        part = matrix[start : start + step]
        if len(alive) < matrix.shape[1]:
            part = part[:, alive]
        dist = np.maximum(dist, np.abs(part - q[start : start + step, None]).max(axis=0))
        near = dist <= limit
        if not near.all():
            alive, dist = alive[near], dist[near]
        start, step = start + step, min(2 * step, LARGEST_STEP)
    return alive, dist


def envelope_bound(smax: np.ndarray, smin: np.ndarray, qmax: float, qmin: float) -> np.ndarray:
    """``functions.distance.block_lower_bound`` on arrays."""
    ends = []
    for end in (smax, smin):
        ends.append(np.minimum(np.abs(end - qmax), np.abs(end - qmin)))
    for end in (qmax, qmin):
        ends.append(np.minimum(np.abs(smax - end), np.abs(smin - end)))
    return np.maximum.reduce(ends)


class Nearest:
    """The k nearest (distance, id) seen so far."""

    def __init__(self, k: int):
        self.k = k
        self.dist = np.empty(0)
        self.id = np.empty(0, dtype=np.int64)

    @property
    def limit(self) -> float:
        return self.dist[-1] if len(self.dist) == self.k else np.inf

    def add(self, ids: np.ndarray, dist: np.ndarray) -> None:
        ids, dist = np.concatenate([self.id, ids]), np.concatenate([self.dist, dist])
        order = np.lexsort((ids, dist))[: self.k]
        self.id, self.dist = ids[order], dist[order]


def row_steps(n_rows: int, width: int) -> Iterator[slice]:
    step = max(1, VALUES_PER_STEP // max(1, width))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


def scan(
    series: DataFrame,
    queries: list[Query],
    k: int,
    *,
    bounds: dict[int, float] | None = None,
    full_length: bool = False,
    exclude_self: bool = False,
) -> DataFrame:
    """Per task and query the k nearest ``(qid, id, dist)`` plus one summary row.

    ``bounds`` maps a query to a radius: series whose whole envelope is farther away by
    ``block_lower_bound`` are skipped before any distance is taken.  The summary row has
    no id and counts in ``kept`` the series that were compared.
    ``full_length`` requires every series to be exactly as long as the query.
    """
    if not queries:
        return series.sparkSession.createDataFrame([], SCAN_SCHEMA)
    wanted = np.unique(np.concatenate([q.pos for q in queries]))
    rows_of = {q.qid: np.searchsorted(wanted, q.pos) for q in queries}
    # Only the run of queried positions leaves the JVM, unless whole series are looked at.
    whole = full_length or bounds is not None
    offs = wanted if whole else wanted - wanted[0]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = {q.qid: Nearest(k) for q in queries}
        kept = dict.fromkeys(nearest, 0)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat, offsets = flat_lists(batch.column(1))
            for rows in row_steps(len(ids), len(wanted)):
                ends = offsets[rows.start : rows.stop + 1]
                _compare(ids[rows], flat[ends[0] : ends[-1]], ends - ends[0], nearest, kept)
        for q in queries:
            best = nearest[q.qid]
            n = len(best.id)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([q.qid] * (n + 1), pa.int64()),
                    pa.array([*best.id.tolist(), None], pa.int64()),
                    pa.array([*best.dist.tolist(), None], pa.float64()),
                    pa.array([None] * n + [kept[q.qid]], pa.int64()),
                ],
                names=["qid", "id", "dist", "kept"],
            )

    def _compare(ids, flat, offsets, nearest, kept) -> None:
        lengths = np.diff(offsets)
        matrix = at_positions(flat, offsets, offs)
        if full_length and (lengths == 0).any():
            raise ValueError("a query and the stored series differ in length")
        if bounds is not None:
            smax = np.maximum.reduceat(flat, offsets[:-1])
            smin = np.minimum.reduceat(flat, offsets[:-1])
        for q in queries:
            if full_length and (lengths != len(q.q)).any():
                raise ValueError(f"query {q.qid} and the stored series differ in length")
            rows = rows_of[q.qid]
            every = len(rows) == len(wanted) and (np.diff(rows) == 1).all()
            part = matrix if every else matrix[rows]
            chosen = np.ones(len(ids), dtype=bool)
            if exclude_self:
                chosen &= ids != q.qid
            if bounds is not None:
                chosen &= envelope_bound(smax, smin, q.hi, q.lo) <= bounds[q.qid]
            if not chosen.all():
                part = part[:, chosen]
            kept[q.qid] += int(chosen.sum())
            best = nearest[q.qid]
            near, dist = distances(part, q.q, best.limit)
            if len(near):
                best.add(ids[chosen][near], dist)

    # An empty series has no distance, but where lengths must agree it is an error like any other.
    usable = series if full_length else series.filter(F.size("v") > 0)
    values = F.col("v") if whole else F.slice("v", int(wanted[0]) + 1, int(wanted[-1] - wanted[0]) + 1)
    return usable.select("id", values.alias("v")).mapInArrow(kernel, SCAN_SCHEMA)


def scan_pairs(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("id").isNotNull()).select("qid", "id", "dist")


def scan_counts(scanned: DataFrame) -> DataFrame:
    """Series compared per query."""
    return (
        scanned.filter(F.col("id").isNull()).groupBy("qid").agg(F.sum("kept").alias("n_kept"))
    )
