"""Radii for query tables of any size, from the series around each query.

The k-th distance to any k series is never below the k-th distance to all of them.  Here these are the series
of the query's own cell: cells halve the series again and again at medians of the position where a sample of
them spreads most.  Where a query lies decides how close its radius is, never what is searched afterwards: that
is every series that may lie within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from math import ceil, inf, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwave.functions.arrow import at_positions, flat_lists
from nearwave.functions.hashing import hash32
from nearwave.operators.leaves import spread
from nearwave.operators.many import Chunk, Reach, StoredQueries, nearest_of
from nearwave.workdir import new_folder

# Values of the sample that the cells are laid out by, and its rows.
LAYOUT_VALUES = 1 << 20
LAYOUT_ROWS = 1 << 14
# Sample rows of a cell, and series of a cell, at least.
MIN_SAMPLE_PER_CELL = 32
MIN_IN_CELL = 512
# Values of the series, and points of the queries, that meet in one task, at most.
CELL_VALUES = 1 << 20
MAX_TASKS = 10_000

_ASKED = "qid BIGINT, pos ARRAY<INT>, q ARRAY<DOUBLE>, radius DOUBLE"


class Cells:
    """A tree of splits at sample medians; rows without a value at a split go left."""

    sizes: dict[int, tuple[int, int]]
    """Values and rows of the series in each cell that has any."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        self.sizes = {}
        self.width = sample.shape[0]
        self.depth = max(0, int(log2(max(1, n_cells))))
        self.position = np.zeros(2**self.depth - 1, dtype=np.int64)
        self.bound = np.full(2**self.depth - 1, inf)
        parts = {0: np.arange(sample.shape[1])}
        for node in range(len(self.bound)):
            rows = parts.pop(node)
            right = np.zeros(len(rows), dtype=bool)
            if len(rows) > 1:
                self.position[node] = spread(sample[:, rows]).argmax()
                values = sample[self.position[node], rows]
                if not np.isnan(values).all():
                    self.bound[node] = np.nanmedian(values)
                right = values >= self.bound[node]
            parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]

    @property
    def n(self) -> int:
        return 2**self.depth

    def of(self, matrix: np.ndarray) -> np.ndarray:
        """Cell of each column of ``matrix`` (position, row)."""
        node, rows = np.zeros(matrix.shape[1], dtype=np.int64), np.arange(matrix.shape[1])
        for _ in range(self.depth):
            node = 2 * node + 1 + (matrix[self.position[node], rows] >= self.bound[node])
        return (node - (2**self.depth - 1)).astype(np.int32)

    def dealt(self, series: DataFrame, first: int, most: int) -> DataFrame:
        """``(id, v)`` so that a task has series of neighbouring cells, with ``most`` values at most on average.

        ``first`` is where in the series the cells' first position lies.
        """
        total = sum(points for points, _ in self.sizes.values())
        n = max(2 * series.sparkSession.sparkContext.defaultParallelism, ceil(2 * total / most))
        # Cells lie one behind the other; a large one is spread over as many tasks as it fills.
        parts, before = [], 0
        for cell, (points, _) in sorted(self.sizes.items()):
            begin, end = (int(x * n / max(1, total)) for x in (before, before + points - 1))
            parts.append((cell, begin, end - begin + 1))
            before += points
        if len(parts) < 2:
            return series
        where = F.broadcast(series.sparkSession.createDataFrame(parts, "cell INT, part INT, n_parts INT"))
        part = F.col("part") + F.pmod(hash32(5, F.col("id")), F.col("n_parts")).cast("int")
        placed = _series_in_cells(series, self, np.arange(first, first + self.width)).join(where, "cell", "left")
        # Null, for a series without any of the positions, is the first task.
        return placed.repartitionById(n, part).select("id", "v")


def layout(series: DataFrame, k: int, width: int) -> Cells:
    """Cells for series ``(id, v)``: few enough that most hold far more than k of them."""
    size = series.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("points")).first()
    parallel = 4 * series.sparkSession.sparkContext.defaultParallelism
    n = min(max(2 * parallel, ceil(2 * (size.points or 0) / CELL_VALUES)), size.n // max(MIN_IN_CELL, 4 * k))
    rows = min(LAYOUT_ROWS, max(1, LAYOUT_VALUES // width))
    n = min(n, rows // MIN_SAMPLE_PER_CELL)
    if n < 2:
        return Cells(np.empty((width, 0)), 1)
    # The hash is a column first: an order by an expression takes it anew in every comparison.
    some = series.select(hash32(1, F.col("id")).alias("h"), "id", "v").orderBy("h", "id").limit(rows).select("v").collect()
    lengths = [len(r.v) for r in some]
    flat = np.concatenate([np.asarray(r.v, dtype=np.float64) for r in some])
    return Cells(at_positions(flat, np.concatenate([[0], np.cumsum(lengths)]), np.arange(width)), n)


def _series_in_cells(series: DataFrame, cells: Cells, positions: np.ndarray) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_lists(batch.column(1))
            cell = cells.of(at_positions(flat, offsets, positions))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "cell"])

    return series.mapInArrow(kernel, "id BIGINT, v ARRAY<DOUBLE>, cell INT")


def _queries_in_cells(queries: DataFrame, cells: Cells, first: int, width: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, ends = flat_lists(batch.column(1), np.int64)
            q, _ = flat_lists(batch.column(2))
            matrix = np.full((width, len(ends) - 1), np.nan)
            matrix[pos - first, np.repeat(np.arange(len(ends) - 1), np.diff(ends))] = q
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells.of(matrix))], names=["qid", "pos", "q", "radius", "cell"]
            )

    return queries.select("qid", "pos", "q", "radius").mapInArrow(kernel, f"{_ASKED}, cell INT")


def _radius_kernel(k: int, first: int, exclude_self: bool):
    """The queries of one cell, with their k-th distance to its series as radius where that is smaller."""

    def kernel(stored: pa.Table, asked: pa.Table) -> pa.Table:
        radius = asked.column("radius").to_numpy().copy()
        if stored.num_rows and asked.num_rows:
            flat, offsets = flat_lists(stored.column("v").combine_chunks())
            chunk = Chunk(stored.column("id").to_numpy(), flat, offsets)
            pos, ends = flat_lists(asked.column("pos").combine_chunks(), np.int64)
            q, _ = flat_lists(asked.column("q").combine_chunks())
            skip = asked.column("qid").to_numpy() if exclude_self else None
            query, _, dist = nearest_of(chunk, pos - first, q, ends, k, radius, skip)
            last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == k - 1)
            radius[query[last]] = dist[last]
        columns = [*(asked.column(c) for c in ("qid", "pos", "q")), pa.array(radius, pa.float64()), asked.column("cell")]
        return pa.table(columns, names=["qid", "pos", "q", "radius", "cell"])

    return kernel


def close_queries(
    series: DataFrame, queries: DataFrame, k: int, first: int, last: int, exclude_self: bool = False
) -> tuple[DataFrame, Cells]:
    """``(qid, pos, q, radius, cell)``, the queries with radii cut to the k-th distance in their cell; and the cells.

    ``series`` are ``(id, v)`` whose first value is at position ``first``; no query asks beyond ``last``.  A cell
    with many queries is met in parts, and of one with many series a query meets one part.
    """
    spark, width = series.sparkSession, last - first + 1
    series = series.filter(F.size("v") > 0).select("id", "v")
    cells = layout(series, k, width)
    if cells.n == 1:
        return queries.select("qid", "pos", "q", "radius", F.lit(0).alias("cell")), cells
    folder = new_folder(spark, "cells")
    _series_in_cells(series, cells, np.arange(width)).write.parquet(f"{folder}/series")
    _queries_in_cells(queries, cells, first, width).write.parquet(f"{folder}/queries")
    stored = spark.read.schema("id BIGINT, v ARRAY<DOUBLE>, cell INT").parquet(f"{folder}/series")
    asked = spark.read.schema(f"{_ASKED}, cell INT").parquet(f"{folder}/queries")

    # At most a row for each cell.
    def points(rows: DataFrame, values: str) -> dict[int, tuple[int, int]]:
        sizes = rows.groupBy("cell").agg(F.sum(F.size(values)).alias("points"), F.count(F.lit(1)).alias("n")).collect()
        return {r.cell: (r.points, r.n) for r in sizes}

    held, wanted = points(stored, "v"), points(asked, "q")
    cells.sizes = held
    both = sorted(held.keys() & wanted.keys())
    if not both:
        return asked, cells
    parallel = 4 * spark.sparkContext.defaultParallelism
    least = ceil(parallel / len(both))
    cuts = []
    for c in both:
        # Parts of the series still hold far more than k of them, or the part would tell nothing.
        n_stored = max(1, min(ceil(held[c][0] / CELL_VALUES), held[c][1] // (4 * k)))
        n_asked = max(ceil(wanted[c][0] / n_stored / CELL_VALUES), min(ceil(least / n_stored), ceil(wanted[c][1] / MIN_IN_CELL)))
        cuts.append((c, n_stored, n_asked))
    parts = F.broadcast(spark.createDataFrame(cuts, "cell INT, n_stored INT, n_asked INT"))
    tile = ["cell", "stored_part", "asked_part"]
    # More tasks than tiles, so that few have several of them.
    n_tasks = min(MAX_TASKS, 2 * sum(a * b for _, a, b in cuts))
    left = (
        stored.join(parts, "cell")
        .withColumn("stored_part", F.pmod(hash32(2, F.col("id")), "n_stored").cast("int"))
        .withColumn("asked_part", F.explode(F.sequence(F.lit(0), F.col("n_asked") - 1)))
        .select(*tile, "id", "v")
    )
    right = (
        asked.join(parts, "cell")
        .withColumn("stored_part", F.pmod(hash32(4, F.col("qid")), "n_stored").cast("int"))
        .withColumn("asked_part", F.pmod(hash32(3, F.col("qid")), "n_asked").cast("int"))
        .select(*tile, "qid", "pos", "q", "radius")
    )
    near = (
        left.repartition(n_tasks, *tile)
        .groupBy(*tile)
        .cogroup(right.repartition(n_tasks, *tile).groupBy(*tile))
        .applyInArrow(_radius_kernel(k, first, exclude_self), f"{_ASKED}, cell INT")
    )
    if alone := sorted(wanted.keys() - held.keys()):
        near = near.unionByName(asked.filter(F.col("cell").isin(alone)))
    return near, cells


def _reach(queries: DataFrame, first: int, width: int) -> Reach:
    """What the queries ``(pos, q, radius, cell)`` of each cell have in common; at most a row a cell leaves a task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        for batch in batches:
            pos, ends = flat_lists(batch.column(0), np.int64)
            q, _ = flat_lists(batch.column(1))
            radius, cell = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            matrix = np.full((width, len(cell)), np.nan)
            matrix[pos - first, np.repeat(np.arange(len(cell)), np.diff(ends))] = q
            for c in np.unique(cell).tolist():
                some = cell == c
                part = matrix[:, some]
                now = part.max(axis=1), part.min(axis=1), float(radius[some].max())
                was = found.get(c, now)
                found[c] = np.maximum(was[0], now[0]), np.minimum(was[1], now[1]), max(was[2], now[2])
        if found:
            columns = [list(found), [f[0].tolist() for f in found.values()], [f[1].tolist() for f in found.values()]]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())))]
            arrays.append(pa.array([f[2] for f in found.values()], pa.float64()))
            yield pa.RecordBatch.from_arrays(arrays, names=["cell", "top", "bottom", "radius"])

    schema = "cell INT, top ARRAY<DOUBLE>, bottom ARRAY<DOUBLE>, radius DOUBLE"
    rows = queries.select("pos", "q", "radius", "cell").mapInArrow(kernel, schema).collect()
    cell, at = np.unique([r.cell for r in rows], return_inverse=True)
    top, bottom = np.full((len(cell), width), -inf), np.full((len(cell), width), inf)
    radius = np.full(len(cell), -inf)
    np.maximum.at(top, at, np.array([r.top for r in rows]))
    np.minimum.at(bottom, at, np.array([r.bottom for r in rows]))
    np.maximum.at(radius, at, np.array([r.radius for r in rows]))
    return Reach(cell, top.T.copy(), bottom.T.copy(), radius)


def with_radii(
    series: DataFrame, asked: StoredQueries, k: int, start: int = 0, exclude_self: bool = False
) -> StoredQueries:
    """The stored queries with radii, in folders by cell, so that a pack's queries are alike.

    ``start`` is the position of the series' first value.
    """
    if not asked.n_queries:
        return asked
    spark = series.sparkSession
    run = F.slice("v", asked.first - start + 1, asked.last - asked.first + 1)
    queries = asked.table(series).withColumn("radius", F.lit(inf))
    close, cells = close_queries(series.select("id", run.alias("v")), queries, k, asked.first, asked.last, exclude_self)
    folder = new_folder(spark, "queries")
    close.write.partitionBy("cell").parquet(folder)
    reach = _reach(spark.read.schema(f"{_ASKED}, cell INT").parquet(folder), asked.first, asked.last - asked.first + 1)
    return replace(asked, folder=folder, cells=cells, reach=reach)
