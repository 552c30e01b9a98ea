"""Query tables of any size: stored once by Spark, streamed in packs by the tasks that hold the series.

A task reads its part of the series once, in chunks of bounded size, and sends the packs of queries past
each chunk.  Where queries have radii they are stored by cell (``operators.cells``), series come to the tasks by cell
too, and a chunk reads only the cells whose queries may have it within their radius.  What leaves a task is at most
k rows for a query and chunk.  Neither queries nor series pass through the driver, and neither side is copied for the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import inf
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwave.functions.arrow import at_positions, flat_lists
from nearwave.operators.leaves import Leaves, by_shape
from nearwave.operators.scan import check_unique
from nearwave.sources.streams import stored_batches
from nearwave.workdir import new_folder

if TYPE_CHECKING:
    from nearwave.operators.cells import Cells

# Points of the queries, and values of the series, that a task holds at a time.
PACK_POINTS = 1 << 18
CHUNK_VALUES = 1 << 23

PAIRS = "qid BIGINT, id BIGINT, dist DOUBLE"


@dataclass(frozen=True)
class Reach:
    """Per cell that has queries: their largest and smallest value at each position, and their largest radius.

    ``top`` and ``bottom`` are (position, cell), NaN where not all queries of the cell ask for a position.
    """

    cell: np.ndarray
    top: np.ndarray
    bottom: np.ndarray
    radius: np.ndarray


@dataclass(frozen=True)
class StoredQueries:
    """A query table in the shared folder, with what its readers have to know."""

    folder: str
    n_queries: int
    first: int
    last: int
    """Range of the positions that are asked for."""
    most_points: int
    cells: Cells | None = None
    """Where queries and series lie, if the queries have a column ``radius`` and are stored in folders by cell."""
    reach: Reach | None = None

    def packs(self, near: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``(qid, pos, q)`` in batches of ``PACK_POINTS`` points at most; a longer query is a pack of its own.

        With radii, which are a fourth column, only those of the cells ``near`` if these are given.
        """
        rows = max(1, PACK_POINTS // max(1, self.most_points))
        if self.reach is None:
            yield from stored_batches(self.folder, ["qid", "pos", "q"], rows)
            return
        for cell in (self.reach.cell if near is None else near).tolist():
            yield from stored_batches(f"{self.folder}/cell={cell}", ["qid", "pos", "q", "radius"], rows)

    def near(self, chunk: Chunk, first: int) -> np.ndarray:
        """Cells some of whose queries may have a series of the chunk within their radius.

        ``first`` is where in the chunk's series the first position lies that is asked for.
        """
        chunk.prepare(np.arange(first, first + len(self.reach.top)))
        rows = np.searchsorted(chunk.wanted, np.arange(first, first + len(self.reach.top)))
        return self.reach.cell[chunk.leaves.near_boxes(rows, self.reach.top, self.reach.bottom, self.reach.radius)]

    def table(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.read.schema("qid BIGINT, pos ARRAY<INT>, q ARRAY<DOUBLE>").parquet(self.folder)


def store_queries(queries: DataFrame) -> StoredQueries:
    """Writes the queries that have points; query ids must be unique."""
    check_unique(queries)
    folder = new_folder(queries.sparkSession, "queries")
    rows = queries.filter(F.size("q") > 0).select(
        F.col("qid").cast("bigint"), F.col("pos").cast("array<int>"), F.col("q").cast("array<double>")
    )
    rows.write.parquet(folder)
    stored = StoredQueries(folder, 0, 0, 0, 1)
    size = stored.table(queries).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.array_min("pos")).alias("first"),
        F.max(F.array_max("pos")).alias("last"),
        F.max(F.size("q")).alias("most"),
    )
    n, first, last, most = size.first()
    return StoredQueries(folder, n, first or 0, last or 0, most or 1)


class Chunk:
    """Some series, laid out in leaves at the positions that queries ask for."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray):
        self.given = ids, flat, offsets
        self.wanted = np.empty(0, np.int64)

    def prepare(self, wanted: np.ndarray) -> None:
        """Lays the series out for queries at these positions too; packs often share them."""
        if np.isin(wanted, self.wanted).all():
            return
        ids, flat, offsets = self.given
        self.wanted = np.union1d(wanted, self.wanted)
        self.leaves = Leaves(ids, at_positions(flat, offsets, self.wanted))


def nearest_of(
    chunk: Chunk,
    pos: np.ndarray,
    q: np.ndarray,
    ends: np.ndarray,
    k: int,
    limits: np.ndarray,
    skip: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, dist)``: the k nearest series of a chunk within each query's limit, by query, distance and id.

    Query ``i`` asks for ``q`` at ``pos`` from ``ends[i]`` to ``ends[i + 1]``.
    """
    chunk.prepare(np.unique(pos))
    found = []
    for shape, queries in by_shape(pos, ends):
        values = q[ends[queries][None, :] + np.arange(len(shape))[:, None]]
        rows = np.searchsorted(chunk.wanted, shape)
        who, ids, dist = chunk.leaves.nearest(rows, values, k, limits[queries], None if skip is None else skip[queries])
        found.append((queries[who], ids, dist))
    query, ids, dist = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(query, kind="stable")
    return query[order], ids[order], dist[order]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Rows ``(id, v)`` of a task in chunks of about ``CHUNK_VALUES`` values."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        flat, offsets = flat_lists(batch.column(1))
        held.append((ids, flat, np.diff(offsets)))
        n += len(flat)
        if n >= CHUNK_VALUES:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Chunk:
    ids, flat, lengths = (np.concatenate(c) for c in zip(*held))
    return Chunk(ids, flat, np.concatenate([[0], np.cumsum(lengths)]))


def scan_many(
    series: DataFrame,
    asked: StoredQueries,
    k: int,
    *,
    start: int = 0,
    full_length: bool = False,
    exclude_self: bool = False,
) -> DataFrame:
    """``(qid, id, dist)``: for each query the k nearest of every chunk of the series, within its radius if it has one.

    ``start`` is the position of the series' first value.  ``full_length`` requires every series to be exactly as long as each query.
    """
    offset = 0 if full_length else asked.first

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            # All lengths are compared, also of queries that are too far away.
            near = None if full_length or asked.reach is None else asked.near(chunk, asked.first - offset)
            for pack in asked.packs(near):
                qids = pack.column(0).to_numpy(zero_copy_only=False)
                pos, ends = flat_lists(pack.column(1), np.int64)
                q, _ = flat_lists(pack.column(2))
                pos = pos - offset
                if full_length:
                    _same_length(chunk, qids, np.diff(ends))
                limits = pack.column(3).to_numpy() if asked.reach is not None else np.full(len(qids), inf)
                query, ids, dist = nearest_of(chunk, pos, q, ends, k, limits, qids if exclude_self else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[query]), pa.array(ids), pa.array(dist)], names=["qid", "id", "dist"]
                )

    usable = series if full_length else series.filter(F.size("v") > 0)
    values = F.col("v") if full_length else F.slice("v", asked.first - start + 1, asked.last - asked.first + 1)
    rows = usable.select("id", values.alias("v"))
    if asked.cells is not None:
        rows = asked.cells.dealt(rows, asked.first - offset, CHUNK_VALUES)
    return rows.mapInArrow(kernel, PAIRS)


def _same_length(chunk: Chunk, qids: np.ndarray, asked: np.ndarray) -> None:
    lengths = np.diff(chunk.given[2])
    differs = asked != lengths[0] if (lengths == lengths[0]).all() else np.ones(len(asked), bool)
    if differs.any():
        raise ValueError(f"query {qids[differs][0]} and the stored series differ in length")


def sample_radii(sample: DataFrame, asked: StoredQueries, k: int, exclude_self: bool = False) -> DataFrame:
    """``(qid, radius)``: k-th smallest distance to the whole stored sample, for queries that have one.

    The sample is stored, and tasks stream it past their part of the queries, a chunk at a time.
    """
    folder = new_folder(sample.sparkSession, "sample")
    run = F.slice("v", asked.first + 1, asked.last - asked.first + 1)
    sample.filter(F.size("v") > 0).select("id", run.alias("v")).write.parquet(folder)
    rows = max(1, CHUNK_VALUES // (asked.last - asked.first + 1))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[Chunk] = []
        for batch in batches:
            qids = batch.column(0).to_numpy(zero_copy_only=False)
            pos, ends = flat_lists(batch.column(1), np.int64)
            q, _ = flat_lists(batch.column(2))
            # A sample of one chunk is laid out once for all batches.
            parts = iter(kept) if kept else chunks(stored_batches(folder, ["id", "v"], rows))
            best, n = np.full((len(qids), k), inf), np.zeros(len(qids), np.int64)
            seen = 0
            for chunk in parts:
                seen, last = seen + 1, chunk
                query, _, dist = nearest_of(chunk, pos - asked.first, q, ends, k, best[:, -1], qids if exclude_self else None)
                nth = np.arange(len(query)) - np.searchsorted(query, query)
                new = np.full(best.shape, inf)
                new[query, nth] = dist
                n += np.bincount(query, minlength=len(qids))
                best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, :k]
            kept = [last] if seen == 1 else []
            yield pa.RecordBatch.from_arrays([pa.array(qids[n >= k]), pa.array(best[n >= k, -1])], names=["qid", "radius"])

    return asked.table(sample).select("qid", "pos", "q").mapInArrow(kernel, "qid BIGINT, radius DOUBLE")
