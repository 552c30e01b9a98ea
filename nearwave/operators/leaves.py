"""Series of one task in leaves, and the nearest of them for groups of queries.

Series are split at medians of the position where they spread most until a leaf has few of them, and every
leaf keeps its largest and smallest value at each position.  Runs of leaves have envelopes too, and runs of these.
Queries are put in groups in the same way.  A query that lies farther than its limit from all of the largest
envelopes is dropped first.  A group meets the leaves from the nearest on; a query is compared with a leaf's series
only if the leaf's envelope lies within the k-th distance that the query has found so far.  Every other pair is
farther by the bound, whatever the values are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import numpy as np

# Series of a leaf, and queries of a group, at most.
LEAF_ROWS = 32
GROUP_QUERIES = 32
# Envelopes under one envelope of the next level, and envelopes of the highest level at most.
BOX_LEAVES = 16
TOP_BOXES = 64
# Rows up to which every query is compared with all of them.
FEW_ROWS = 1024
# Leaves a group meets before it drops those that have become too far: few at first, then more.
FIRST_LEAVES = 2
MOST_LEAVES = 512
# Distances held by one step of the kernel.
STEP_DISTANCES = 1 << 14
# Positions compared before pairs already too far away are dropped.
FIRST_POSITIONS = 6
# Rows from which the spread at each position is taken.
SPREAD_ROWS = 256
# Candidates of a group that are kept before they are cut to k for each query.
MOST_CANDIDATES = 1 << 18


def spread(matrix: np.ndarray) -> np.ndarray:
    """Standard deviation at each position; 0 where it is none."""
    step = -(-matrix.shape[1] // SPREAD_ROWS)
    with np.errstate(all="ignore"):
        return np.nan_to_num(np.nan_to_num(matrix[:, ::step]).std(axis=1))


def telling_order(matrix: np.ndarray) -> np.ndarray:
    """Positions of ``matrix`` (position, row) in an order where each tells most beyond those before it.

    The one that spreads most comes first, then always the one with most variance left when those before it are
    known.  It decides how early a pair is dropped, never whether it is.
    """
    with np.errstate(all="ignore"):
        some = matrix[:, :: max(1, -(-matrix.shape[1] // SPREAD_ROWS))]
        known = np.isfinite(some)
        mean = np.where(known, some, 0).sum(axis=1) / np.maximum(1, known.sum(axis=1))
        left = np.where(known, some - mean[:, None], 0)
        order = np.empty(len(left), dtype=np.int64)
        free = np.ones(len(left), dtype=bool)
        for i in range(len(left)):
            power = (left**2).sum(axis=1)
            order[i] = np.where(free, power, -1).argmax()
            free[order[i]] = False
            if i + 1 >= FIRST_POSITIONS or not 0 < power[order[i]] < inf:
                order[i + 1 :] = np.flatnonzero(free)
                break
            axis = left[order[i]] / np.sqrt(power[order[i]])
            left = left - (left @ axis)[:, None] * axis
    return order


def split_order(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of ``matrix`` (position, row) in an order where neighbours are alike, and where each leaf ends."""
    order, ends = np.arange(matrix.shape[1]), []
    waiting = [(0, len(order))]
    while waiting:
        a, b = waiting.pop()
        if b - a <= most:
            ends.append(b)
            continue
        part = matrix[:, order[a:b]] if b - a <= 2 * SPREAD_ROWS else matrix[:, order[a : b : (b - a) // SPREAD_ROWS]]
        widest = int(spread(part).argmax())
        # Whole leaves to the left, so that nearly all leaves are full.
        half = (-(-(b - a) // most) // 2) * most
        order[a:b] = order[a:b][np.argpartition(matrix[widest, order[a:b]], half)]
        waiting += [(a + half, b), (a, a + half)]
    return order, np.array(ends, dtype=np.int64)


class Leaves:
    """Series ``(position, row)`` in leaves; NaN where a series is too short."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        if ids.dtype != np.int64:
            raise ValueError("series ids must not be null")
        order, ends = split_order(matrix, LEAF_ROWS)
        n, width = len(ends), matrix.shape[0]
        rows = np.diff(ends, prepend=0)
        # Short leaves are filled up with rows that are never within any distance.
        place = np.repeat(np.arange(n) * LEAF_ROWS - (ends - rows), rows) + np.arange(len(order))
        self.ids = np.zeros(n * LEAF_ROWS, dtype=np.int64)
        self.ids[place] = ids[order]
        full = np.full((width, n * LEAF_ROWS), np.nan)
        full[:, place] = matrix[:, order]
        self.values = full.reshape(width, n, LEAF_ROWS)
        self.ids = self.ids.reshape(n, LEAF_ROWS)
        with np.errstate(all="ignore"):
            self.levels = [(np.fmax.reduce(self.values, axis=2), np.fmin.reduce(self.values, axis=2))]
            while (m := self.levels[-1][0].shape[1]) > TOP_BOXES:
                high, low = self.levels[-1]
                starts = np.arange(0, m, BOX_LEAVES)
                self.levels.append((np.fmax.reduceat(high, starts, axis=1), np.fmin.reduceat(low, starts, axis=1)))
        # The same row by row, where single rows are looked at.
        self.rows = np.ascontiguousarray(full.T)
        self.row_levels = tuple(np.ascontiguousarray(e.T) for e in self.levels[0])
        self.orders: dict[bytes, np.ndarray] = {}

    def picked(self, matrix: np.ndarray, at: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Some rows of ``matrix`` (row, position) at increasing positions."""
        part = matrix[at]
        return part if len(positions) == matrix.shape[1] else part[:, positions]

    def _telling(self, rows: np.ndarray) -> np.ndarray:
        """The order of the positions ``rows`` in which they are compared."""
        if rows.tobytes() not in self.orders:
            some = self.values[rows].reshape(len(rows), -1)
            self.orders[rows.tobytes()] = telling_order(some[:, ~np.isnan(some).all(axis=0)])
        return self.orders[rows.tobytes()]

    def near_boxes(self, rows: np.ndarray, top: np.ndarray, bottom: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Which of some boxes (position, box) have a highest envelope within their limit; NaN tells nothing."""
        high, low = (e[rows] for e in self.levels[-1])
        near = np.empty(top.shape[1], dtype=bool)
        step = STEP_DISTANCES
        for a in range(0, len(near), step):
            bound = np.zeros((len(near[a : a + step]), high.shape[1]))
            with np.errstate(invalid="ignore"):
                for i in range(len(rows)):
                    np.fmax(bound, bottom[i, a : a + step, None] - high[i], out=bound)
                    np.fmax(bound, low[i] - top[i, a : a + step, None], out=bound)
            near[a : a + step] = (bound <= limits[a : a + step, None]).any(axis=1)
        return near

    def reached(self, rows: np.ndarray, top: np.ndarray, bottom: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Leaves whose envelopes lie within the limit of a box, from the nearest on, and how far they are."""
        at = np.arange(self.levels[-1][0].shape[1])
        for level in reversed(range(len(self.levels))):
            high, low = self.levels[level]
            with np.errstate(invalid="ignore"):
                # Rounding keeps order, so a bound is never above a distance.  NaN tells nothing: fmax leaves it out.
                apart = np.fmax(bottom[:, None] - high[rows[:, None], at], low[rows[:, None], at] - top[:, None])
            bound = np.fmax.reduce(apart, axis=0, initial=0.0)
            near = bound <= limit
            at, bound = at[near], bound[near]
            if level:
                at = (at[:, None] * BOX_LEAVES + np.arange(BOX_LEAVES)).ravel()
                at = at[at < self.levels[level - 1][0].shape[1]]
        order = np.argsort(bound, kind="stable")
        return at[order], bound[order]

    def nearest(
        self, rows: np.ndarray, q: np.ndarray, k: int, limits: np.ndarray | None = None, skip: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, id, dist)`` of the k nearest series to each query, by query, distance and id.

        ``q`` is (position, query) at the matrix positions ``rows``.  Series beyond a query's limit, and the
        series whose id is the query's ``skip``, are no answers.
        """
        telling = self._telling(rows)
        rows, q = rows[telling], q[telling]
        limits = np.full(q.shape[1], inf) if limits is None else limits
        if self.ids.size <= FEW_ROWS:
            return self._nearest_of_all(rows, q, k, limits, skip)
        near = np.arange(q.shape[1])
        if (limits < inf).any():
            some = slice(0, FIRST_POSITIONS)
            near = np.flatnonzero(self.near_boxes(rows[some], q[some], q[some], limits))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(near):
            q, limits, skip = q[:, near], limits[near], None if skip is None else skip[near]
            order, ends = split_order(q, GROUP_QUERIES)
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                who = order[a:b]
                group = _Group(self, rows, q[:, who], k, limits[who], None if skip is None else skip[who])
                one, ids, dist = group.search()
                found.append((near[who[one]], ids, dist))
        query, ids, dist = (np.concatenate(c) for c in zip(*found))
        sort = np.argsort(query, kind="stable")
        return query[sort], ids[sort], dist[sort]

    def _nearest_of_all(
        self, rows: np.ndarray, q: np.ndarray, k: int, limits: np.ndarray, skip: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`nearest` without looking at envelopes, for few series."""
        ids, found = self.ids.ravel(), []
        values = self.values.reshape(len(self.values), -1)
        step = max(1, 4 * STEP_DISTANCES // max(1, len(ids)))
        for a in range(0, max(1, q.shape[1]), step):
            dist = np.zeros((len(limits[a : a + step]), len(ids)))
            with np.errstate(invalid="ignore"):
                for i, row in enumerate(rows):
                    apart = values[row] - q[i, a : a + step, None]
                    np.maximum(dist, np.abs(apart, out=apart), out=dist)
                within = dist <= limits[a : a + step, None]
            if skip is not None:
                within &= ids != skip[a : a + step, None]
            if k < len(ids):
                within &= dist <= np.partition(np.where(within, dist, inf), k - 1, axis=1)[:, k - 1 : k]
            query, at = np.nonzero(within)
            dist = dist[query, at]
            order = np.lexsort((ids[at], dist, query))
            query, at, dist = query[order], at[order], dist[order]
            kept = np.arange(len(query)) - np.searchsorted(query, query) < k
            found.append((query[kept] + a, ids[at[kept]], dist[kept]))
        query, ids, dist = (np.concatenate(c) for c in zip(*found))
        return query, ids, dist


class _Group:
    """Some queries of one shape on their way past the leaves."""

    def __init__(self, leaves: Leaves, rows: np.ndarray, q: np.ndarray, k: int, limits: np.ndarray, skip: np.ndarray | None):
        self.leaves, self.rows, self.q, self.k, self.limits, self.skip = leaves, rows, q, k, limits.copy(), skip
        along = np.argsort(rows)
        self.positions, self.q_rows = rows[along], np.ascontiguousarray(q[along].T)
        self.best = np.full((q.shape[1], k), inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaves, bound = self.leaves.reached(self.rows, self.q.max(axis=1), self.q.min(axis=1), self.limits.max())
        at, step = 0, max(FIRST_LEAVES, -(-2 * self.k // LEAF_ROWS))
        while at < len(leaves):
            end = min(at + step, int(np.searchsorted(bound, self.limits.max(), side="right")))
            if end <= at:
                break
            self._meet(leaves[at:end])
            at, step = end, min(4 * step, MOST_LEAVES)
        return self._cut()

    def _meet(self, leaves: np.ndarray) -> None:
        """Compares each query with the leaves whose envelopes lie within its limit."""
        high, low = self.leaves.levels[0]
        bound = np.zeros((self.q.shape[1], len(leaves)))
        with np.errstate(invalid="ignore"):
            for i, row in enumerate(self.rows[:FIRST_POSITIONS]):
                q = self.q[i][:, None]
                np.fmax(bound, q - high[row, leaves], out=bound)
                np.fmax(bound, low[row, leaves] - q, out=bound)
            query, leaf = np.nonzero(bound <= self.limits[:, None])
            bound, leaf = bound[query, leaf], leaves[leaf]
            if len(self.rows) > FIRST_POSITIONS and len(query):
                q = self.q_rows[query]
                high, low = (self.leaves.picked(e, leaf, self.positions) for e in self.leaves.row_levels)
                bound = np.fmax(bound, np.fmax.reduce(np.fmax(q - high, low - q), axis=1))
                near = bound <= self.limits[query]
                query, leaf, bound = query[near], leaf[near], bound[near]
        pairs = max(1, STEP_DISTANCES // LEAF_ROWS)
        if len(query) > pairs:
            near = np.argsort(bound, kind="stable")
            query, leaf, bound = query[near], leaf[near], bound[near]
        for a in range(0, len(query), pairs):
            still = np.flatnonzero(bound[a : a + pairs] <= self.limits[query[a : a + pairs]]) + a
            if len(still):
                still = still[np.argsort(query[still], kind="stable")]
                self._compare(query[still], leaf[still])

    def _compare(self, query: np.ndarray, leaf: np.ndarray) -> None:
        """Distances of pairs, which come by query."""
        with np.errstate(invalid="ignore"):
            apart = self.leaves.values[self.rows[:FIRST_POSITIONS, None], leaf]
            apart -= self.q[:FIRST_POSITIONS, query, None]
            dist = np.abs(apart, out=apart).max(axis=0)
            # Rows too short, and those that fill a leaf, are NaN and within no limit.
            pair, at = np.nonzero(dist <= self.limits[query][:, None])
            query, dist, at = query[pair], dist[pair, at], leaf[pair] * LEAF_ROWS + at
            if len(self.rows) > FIRST_POSITIONS and len(query):
                apart = self.leaves.picked(self.leaves.rows, at, self.positions)
                dist = np.abs(apart - self.q_rows[query]).max(axis=1)
            within = dist <= self.limits[query]
        ids = self.leaves.ids.ravel()[at]
        if self.skip is not None:
            within &= ids != self.skip[query]
        if within.any():
            self._keep(query[within], ids[within], dist[within])

    def _keep(self, query: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Takes in what was found, which comes by query; the k-th distances become the limits."""
        who, first, n = np.unique(query, return_index=True, return_counts=True)
        nth = np.arange(len(query)) - np.repeat(first, n)
        new = np.full((len(who), int(n.max())), inf)
        new[np.repeat(np.arange(len(who)), n), nth] = dist
        best = np.concatenate([self.best[who], new], axis=1)
        best.partition(self.k - 1, axis=1)
        self.best[who] = best[:, : self.k]
        self.limits[who] = np.minimum(self.limits[who], best[:, self.k - 1])
        near = dist <= self.limits[query]
        self.held.append((query[near], ids[near], dist[near]))
        self.n_held += int(near.sum())
        if self.n_held > MOST_CANDIDATES:
            self.held = [self._cut()]
            self.n_held = len(self.held[0][0])

    def _cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, ids, dist = (np.concatenate(c) for c in zip(*self.held))
        near = dist <= self.limits[query]
        query, ids, dist = query[near], ids[near], dist[near]
        order = np.lexsort((ids, dist, query))
        query, ids, dist = query[order], ids[order], dist[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.k
        return query[kept], ids[kept], dist[kept]


def by_shape(pos: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries of equal positions: the positions, and which queries have them."""
    lengths = np.diff(ends)
    if len(lengths) and (lengths == lengths[0]).all():
        table = pos.reshape(len(lengths), lengths[0])
        if (table == table[0]).all():
            yield table[0], np.arange(len(lengths))
            return
    shapes: dict[bytes, list[int]] = {}
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        shapes.setdefault(pos[a:b].tobytes(), []).append(i)
    for shape, queries in shapes.items():
        yield np.frombuffer(shape, dtype=pos.dtype), np.array(queries)
