"""Range search of an index for query tables of any size: query blocks stored by time block, met by the stored blocks.

The parts of all queries are written as a table in directories by time block.  A task that scans blocks of the
index streams the query parts of the same time blocks past them, so there is one scan of the index
whatever the number of queries, and neither side is copied or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwave.functions.arrow import at_positions, flat_lists, list_column
from nearwave.operators.many import PACK_POINTS
from nearwave.sources.streams import stored_batches
from nearwave.sources.tables import BlockIndex
from nearwave.workdir import new_folder

# Stored values that are laid out as a matrix at a time; pairs of a query part and a block, and their
# points, that are compared at a time.
STEP_VALUES = 1 << 21
STEP_PAIRS = 1 << 18
POINTS_AT_ONCE = 8

_PARTS = "tb INT, qid BIGINT, n_tb INT, radius DOUBLE, offs ARRAY<INT>, vals ARRAY<DOUBLE>"
MEASURED = "qid BIGINT, id BIGINT, n_tb INT, d DOUBLE"


def query_parts(queries: DataFrame, t_len: int) -> DataFrame:
    """One row per query and touched time block of queries ``(qid, pos, q, radius)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qids, radii = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            pos, ends = flat_lists(batch.column(1), np.int64)
            q, _ = flat_lists(batch.column(2))
            out: list[tuple] = []
            offs, vals = [], []
            for qid, radius, a, b in zip(qids.tolist(), radii.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                order = np.argsort(pos[a:b], kind="stable")
                p, x = pos[a:b][order], q[a:b][order]
                tbs, starts = np.unique(p // t_len, return_index=True)
                for tb, i, e in zip(tbs.tolist(), starts.tolist(), [*starts[1:].tolist(), len(p)]):
                    out.append((tb, qid, len(tbs), radius))
                    offs.append(p[i:e] - tb * t_len)
                    vals.append(x[i:e])
            if out:
                ends_out = np.concatenate([[0], np.cumsum([len(v) for v in vals])])
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.float64()))]
                lists = [list_column(np.concatenate(offs).astype(np.int32), ends_out), list_column(np.concatenate(vals), ends_out)]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=["tb", "qid", "n_tb", "radius", "offs", "vals"])

    return queries.select("qid", "pos", "q", "radius").mapInArrow(cut, _PARTS)


@dataclass(frozen=True)
class AskedBlocks:
    """Query parts stored by time block."""

    folder: str
    tbs: list[int]
    rows: int
    """Parts of a pack, so that it has a bounded number of points."""

    def packs(self, tb: int) -> Iterator[Pack]:
        for batch in stored_batches(f"{self.folder}/tb={tb}", ["qid", "n_tb", "radius", "offs", "vals"], self.rows):
            yield Pack(batch)


def store_parts(parts: DataFrame, index: BlockIndex) -> AskedBlocks:
    """Writes query parts in directories by time block; there are as many as the longest query has blocks."""
    folder = new_folder(index.spark, "asked")
    parts.write.partitionBy("tb").parquet(folder)
    tbs = [r.tb for r in index.spark.read.parquet(folder).select("tb").distinct().collect()]
    return AskedBlocks(folder, sorted(tbs), max(1, PACK_POINTS // index.t_len))


class Pack:
    """Query parts of one time block as flat arrays, and padded to a matrix with NaN."""

    def __init__(self, batch: pa.RecordBatch):
        get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        self.qid, self.n_tb, self.radius = (get[c].to_numpy(zero_copy_only=False) for c in ("qid", "n_tb", "radius"))
        self.offs, self.ends = flat_lists(get["offs"], np.int64)
        self.vals, _ = flat_lists(get["vals"])
        self.hi = np.maximum.reduceat(self.vals, self.ends[:-1])
        self.lo = np.minimum.reduceat(self.vals, self.ends[:-1])
        self.last = self.offs[self.ends[1:] - 1]  # offsets ascend
        new = np.ones(len(self.offs), bool)
        new[1:] = self.offs[1:] != self.offs[:-1]
        new[self.ends[:-1]] = True
        self.new = new.astype(np.int64)
        self.n_points = np.add.reduceat(self.new, self.ends[:-1])
        """Different positions of each part."""

    def padded(self) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (0 where there is no point) and values (NaN there) per part and point."""
        lengths = np.diff(self.ends)
        offs = np.zeros((len(lengths), int(lengths.max())), np.int64)
        vals = np.full(offs.shape, np.nan)
        inside = np.arange(offs.shape[1])[None, :] < lengths[:, None]
        offs[inside], vals[inside] = self.offs, self.vals
        return offs, vals

    def value_blocks(self, v_len: int, stored: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per part and value block greatest and least value (NaN if untouched), and whether all of it is queried."""
        n_blocks = -(-stored // v_len)
        part = np.repeat(np.arange(len(self.qid)), np.diff(self.ends))
        cell = part * n_blocks + np.minimum(self.offs // v_len, n_blocks - 1)
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        hi, lo = (np.full(len(self.qid) * n_blocks, np.nan) for _ in range(2))
        points = np.zeros(len(hi), np.int64)
        hi[cell[starts]] = np.maximum.reduceat(self.vals, starts)
        lo[cell[starts]] = np.minimum.reduceat(self.vals, starts)
        points[cell[starts]] = np.add.reduceat(self.new, starts)
        sizes = np.minimum(v_len, stored - np.arange(n_blocks) * v_len)
        shape = (len(self.qid), n_blocks)
        return hi.reshape(shape), lo.reshape(shape), points.reshape(shape) == sizes[None, :]


class StoredBlocks:
    """Stored blocks of one time block, in the order of their maxima."""

    def __init__(self, stored: int, v_len: int, ids, n, tmax, tmin, flat, offsets):
        order = np.argsort(tmax, kind="stable")
        width = int(n.max())
        self.stored, self.v_len = stored, v_len
        self.ids, self.n, self.tmax, self.tmin = ids[order], n[order], tmax[order], tmin[order]
        # A row for each block, so that the points of a pair lie side by side.
        self.matrix = np.ascontiguousarray(at_positions(flat, offsets, np.arange(width)).T[order])
        starts = range(0, width, v_len)
        self.mx, self.mn = (
            np.stack([f.reduce(self.matrix[:, a : a + v_len], axis=1) for a in starts], axis=1) for f in (np.fmax, np.fmin)
        )

    def in_range(self, pack: Pack) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query part, row) that pass the range test, some at a time; those of a part stay together."""
        r = pack.radius
        full = pack.n_points == self.stored
        first = np.searchsorted(self.tmax, np.nextafter(pack.hi - r, -inf))
        stop = np.where(full, np.searchsorted(self.tmax, np.nextafter(pack.hi + r, inf), side="right"), len(self.tmax))
        counts = np.maximum(0, stop - first)
        group = np.cumsum(counts) // STEP_PAIRS
        for start, end in zip(*_runs(group)):
            n = counts[start:end]
            part = np.repeat(np.arange(start, end), n)
            row = np.repeat(first[start:end] - (np.cumsum(n) - n), n) + np.arange(len(part))
            tmax, tmin, limit = self.tmax[row], self.tmin[row], r[part]
            hi, lo = pack.hi[part], pack.lo[part]
            passed = (self.n[row] > pack.last[part]) & (hi - tmax <= limit) & (tmin - lo <= limit)
            passed &= ~full[part] | ((tmax - hi <= limit) & (lo - tmin <= limit))
            yield part[passed], row[passed]

    def within_bound(self, pack: Pack, part: np.ndarray, row: np.ndarray, blocks: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose value-block bound does not exceed the radius: a fully queried value block must match
        both ends of the stored envelope, any other one has its values inside."""
        hi, lo, full = blocks
        for j in range(min(hi.shape[1], self.mx.shape[1])):
            h, w, mx, mn, limit = hi[part, j], lo[part, j], self.mx[row, j], self.mn[row, j], pack.radius[part]
            beyond = (h - mx > limit) | (mn - w > limit)
            beyond |= full[part, j] & ((mx - h > limit) | (w - mn > limit))
            part, row = part[~beyond], row[~beyond]
        return part, row


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of equal numbers."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return starts, np.append(starts[1:], len(group))


# What is measured of one pack against some stored blocks: qid, id, n_tb and distance of each row.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def within_radius(
    block_filter: bool = True, prune: bool = True, exclude_self: bool = False
) -> Callable[[StoredBlocks, Pack], Iterator[Found]]:
    """Measures what passes the filters; ``prune`` drops what lies beyond the radius."""

    def measure(blocks: StoredBlocks, pack: Pack) -> Iterator[Found]:
        offs, vals = pack.padded()
        value_blocks = pack.value_blocks(blocks.v_len, blocks.stored) if block_filter else None
        for part, row in blocks.in_range(pack):
            if exclude_self:
                other = blocks.ids[row] != pack.qid[part]
                part, row = part[other], row[other]
            if value_blocks is not None:
                part, row = blocks.within_bound(pack, part, row, value_blocks)
            dist = np.zeros(len(part))
            for start in range(0, offs.shape[1], POINTS_AT_ONCE):
                some = slice(start, start + POINTS_AT_ONCE)
                apart = np.abs(blocks.matrix[row[:, None], offs[part, some]] - vals[part, some])
                dist = np.fmax(dist, np.fmax.reduce(apart, axis=1))
                if prune:
                    near = dist <= pack.radius[part]
                    part, row, dist = part[near], row[near], dist[near]
            ids = blocks.ids[row]
            yield pack.qid[part], ids, pack.n_tb[part], dist

    return measure


def measured(
    index: BlockIndex, asked: AskedBlocks, measure: Callable[[StoredBlocks, Pack], Iterator[Found]]
) -> DataFrame:
    """``(qid, id, n_tb, d)`` of one scan of the index's blocks against the stored query parts."""
    t_len, v_len, uniform = index.t_len, index.v_len, index.uniform_len

    def compared(block: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, n, tmax, tmin, lengths, flat = (np.concatenate(c) for c in zip(*held))
        stored = t_len if uniform is None else max(0, min(t_len, uniform - block * t_len))
        blocks = StoredBlocks(stored, v_len, ids, n, tmax, tmin, flat, np.concatenate([[0], np.cumsum(lengths)]))
        for pack in asked.packs(block):
            for found in measure(blocks, pack):
                if len(found[0]):
                    columns = [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["qid", "id", "n_tb", "d"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        values: dict[int, int] = {}
        for batch in batches:
            tb, ids, n, tmax, tmin = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            flat, offsets = flat_lists(batch.column(5))
            lengths = np.diff(offsets)
            for a, b in zip(*_runs(tb)):
                block = int(tb[a])
                rows = slice(a, b)
                held.setdefault(block, []).append(
                    (ids[rows], n[rows], tmax[rows], tmin[rows], lengths[rows], flat[offsets[a] : offsets[b]])
                )
                values[block] = values.get(block, 0) + int(offsets[b] - offsets[a])
                # Blocks lie in the order of time: what is held is one time block, or the ends of small files.
                if values[block] >= STEP_VALUES or sum(values.values()) >= 4 * STEP_VALUES:
                    largest = max(values, key=values.get)
                    yield from compared(largest, held.pop(largest))
                    del values[largest]
        for block, parts in held.items():
            yield from compared(block, parts)

    stored = index.blocks.filter(F.col("tb_dir").isin(asked.tbs)) if asked.tbs else index.blocks.limit(0)
    return stored.select("tb", "id", "n", "tmax", "tmin", "seg").mapInArrow(kernel, MEASURED)
