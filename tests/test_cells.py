"""Radii from cells, and leaves, against brute force; pairs compared grow slower than queries times series."""

import numpy as np
import pytest

from nearwave.operators import cells, leaves, many
from nearwave.operators.blocks import as_queries
from nearwave.operators.scan import distances
from nearwave.plans import join, search
from nearwave.sources.tables import write_block_index
from nearwave.workdir import new_folder
from tests.brute_force import answers, nearest

RNG = np.random.default_rng(21)
VALUES = {i: np.cumsum(RNG.normal(size=6)) for i in range(300)} | {i: np.full(6, 2.0) for i in range(300, 340)}
WHOLE = {i: (list(range(6)), v) for i, v in VALUES.items()}


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(cells, "MIN_IN_CELL", 30)
    monkeypatch.setattr(cells, "CELL_VALUES", 240)
    monkeypatch.setattr("nearwave.operators.scan.PACK_QUERIES", 7)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_answers_with_cells(spark, series_of, exclude_self):
    series, want = series_of(VALUES), nearest(VALUES, WHOLE, 3, exclude_self)
    index = write_block_index(series, new_folder(spark, "cells-test"), 4, 2, sample_num=60)
    assert answers(search.knn_scan(series, as_queries(series), 3, exclude_self=exclude_self)) == want
    assert answers(search.knn_index(index, as_queries(series), 3, exclude_self=exclude_self)) == want
    assert answers(join.knn_join(series, as_queries(series), 3, index, exclude_self, 500)) == want


def test_radii_hold_and_are_close(series_of, queries_of):
    """No radius is below the k-th distance, also for queries with gaps; most of whole queries are near it."""
    shapes = [[0, 1, 2, 3, 4, 5], [1, 4], [5]]
    queries = {i: (shapes[i % 3], v[shapes[i % 3]] + 0.01) for i, v in VALUES.items()}
    asked = cells.with_radii(series_of(VALUES), many.store_queries(queries_of(queries)), 3)
    found = {i: r for p in asked.packs() for i, r in zip(p.column(0).to_pylist(), p.column(3).to_pylist())}
    kth = {qid: d for qid, rn, _, d in nearest(VALUES, queries, 3) if rn == 3}
    assert found.keys() == kth.keys() and all(found[i] >= kth[i] for i in kth)
    assert np.isfinite([found[i] for i in kth]).mean() > 0.9
    assert np.mean([found[i] <= 2 * kth[i] for i in kth if i % 3 == 0]) > 0.5


def test_leaves_look_at_few_pairs(monkeypatch):
    """The kernel compares a small share of the pairs, and finds what a comparison of all finds."""
    stored = np.cumsum(RNG.normal(size=(8, 20000)), axis=0)
    asked = stored[:, :200] + 0.001
    seen = []
    compare = leaves._Group._compare
    monkeypatch.setattr(leaves._Group, "_compare", lambda self, q, leaf: (seen.append(len(q)), compare(self, q, leaf))[1])
    query, ids, dist = leaves.Leaves(np.arange(20000), stored).nearest(np.arange(8), asked, 5)
    for i in range(200):
        near, d = distances(stored, asked[:, i], np.inf)
        best = np.lexsort((near, d))[:5]
        assert ids[query == i].tolist() == near[best].tolist() and dist[query == i].tolist() == d[best].tolist()
    assert sum(seen) * leaves.LEAF_ROWS < 0.2 * 200 * 20000


def test_leaves_with_short_infinite_and_equal_series():
    stored = np.round(RNG.normal(size=(4, 500)))
    stored[3, ::7] = np.nan
    stored[0, ::11] = np.inf
    asked = np.round(RNG.normal(size=(4, 40)))
    query, ids, dist = leaves.Leaves(np.arange(500), stored).nearest(np.arange(4), asked, 450, skip=np.arange(40))
    for i in range(40):
        d = np.abs(stored - asked[:, [i]]).max(axis=0)
        d[i] = np.nan
        best = [j for j in np.lexsort((np.arange(500), d)) if not np.isnan(d[j])][:450]
        assert ids[query == i].tolist() == best and dist[query == i].tolist() == d[best].tolist()


def test_null_id_is_an_error(spark, queries_of):
    series = spark.createDataFrame([(1, [0.0, 1.0]), (None, [1.0, 2.0])], "id BIGINT, v ARRAY<DOUBLE>").coalesce(1)
    queries = queries_of({i: ([0, 1], [float(i), 1.0]) for i in range(9)})
    with pytest.raises(Exception, match="must not be null"):
        search.knn_scan(series, queries, 1).collect()


@pytest.mark.parametrize("few", [0, 10**6])
def test_few_series_are_compared_directly(monkeypatch, few):
    """Both ways give the same answers: ties, limits, own ids and series that are too short."""
    monkeypatch.setattr(leaves, "FEW_ROWS", few)
    stored = np.round(RNG.normal(size=(9, 600)) * 2)
    stored[8, ::7] = np.nan
    asked = np.round(RNG.normal(size=(9, 70)) * 2)
    limits = np.where(np.arange(70) % 3, 5.0, np.inf)
    rows = np.array([8, 0, 1, 2, 3, 4, 6, 7])
    query, ids, dist = leaves.Leaves(np.arange(600)[::-1].copy(), stored).nearest(rows, asked[rows], 12, limits, np.arange(70))
    for i in range(70):
        d = np.abs(stored[rows] - asked[rows][:, [i]]).max(axis=0)
        d[599 - i] = np.nan
        found = sorted((x, 599 - j) for j, x in enumerate(d.tolist()) if x <= limits[i])[:12]
        assert ids[query == i].tolist() == [j for _, j in found] and dist[query == i].tolist() == [x for x, _ in found]


def test_chunk_reads_only_cells_that_reach_it(series_of, queries_of):
    """Queries whose radius does not reach a chunk are not read for it; those that do are."""
    values = {100 * c + i: 1000.0 * c + np.cumsum(RNG.normal(size=6)) for c in range(6) for i in range(60)}
    queries = {i: ([0, 1, 2, 3, 4, 5], v) if i % 5 else ([2, 5], v[[2, 5]]) for i, v in values.items()}
    asked = cells.with_radii(series_of(values), many.store_queries(queries_of(queries)), 3)
    assert sorted(i for p in asked.packs() for i in p.column(0).to_pylist()) == sorted(queries)
    for c in range(6):
        own = {i: v for i, v in values.items() if i // 100 == c}
        near = asked.near(many.Chunk(np.array(list(own)), np.concatenate(list(own.values())), np.arange(0, 361, 6)), 0)
        read = {i for p in asked.packs(near) for i in p.column(0).to_pylist()}
        assert set(own) <= read and len(read) < 0.7 * len(queries)


def test_index_search_of_a_later_run(spark, series_of, queries_of):
    """Queries that begin in a later time block, through cells; answers are merged by query in one step."""
    series = series_of(VALUES)
    index = write_block_index(series, new_folder(spark, "cells-later"), 2, 2, sample_num=60)
    queries = {i: ([3, 5], v[[3, 5]]) for i, v in VALUES.items()}
    found = search.knn_index(index, queries_of(queries), 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1
    assert answers(found) == nearest(VALUES, queries, 3)


def test_unequal_length_is_an_error_however_far_away(series_of, queries_of):
    """Radii do not hide a query whose length is not that of the series."""
    queries = {i: (list(range(6)), v) for i, v in VALUES.items()} | {1000: ([0, 1, 2], [1e9] * 3)}
    with pytest.raises(Exception, match="differ in length"):
        search.knn_by_id_table(series_of(VALUES), queries_of(queries), 3).collect()
