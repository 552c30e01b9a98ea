"""Every search method against brute force, for all query shapes."""

import re

import numpy as np
import pytest

from tests.brute_force import answers, nearest
from nearwave.operators import ranges, scan
from nearwave.operators.radius import sample_radius
from nearwave.plans import join, search
from nearwave.sources.tables import write_block_index
from nearwave.workdir import new_folder

LENGTH = 27
RNG = np.random.default_rng(5)
WALKS = {i: np.cumsum(RNG.normal(size=LENGTH)) + RNG.normal() * 10 for i in range(200)}
# Exact copies, so that ranks are decided by id.
for i in range(200, 215):
    WALKS[i] = WALKS[3].copy()

SHAPES = {
    "full": list(range(LENGTH)),
    "whole blocks": list(range(16)),
    "partial block": list(range(10)),
    "offset": list(range(3, 15)),
    "gaps": list(range(0, LENGTH, 3)),
    "one point": [26],
}


def _queries(pos):
    return {i: (pos, WALKS[i][pos]) for i in (0, 3, 77, 214)}


@pytest.fixture(scope="module")
def series(series_of):
    return series_of(WALKS)


@pytest.fixture(scope="module", params=[(8, 4), (10, 3)], ids=str)
def index(request, spark, series):
    return write_block_index(series, new_folder(spark, "test"), *request.param, sample_num=60)


@pytest.mark.parametrize("shape, k", [*[(shape, 10) for shape in SHAPES], ("offset", 1)])
def test_index_equals_brute_force(index, queries_of, shape, k):
    queries = _queries(SHAPES[shape])
    expected = nearest(WALKS, queries, k)
    found = search.local_queries(queries_of(queries))
    assert answers(search.knn_index(index, found, k)) == expected
    assert answers(search.knn_index(index, found, k, block_filter=False)) == expected


@pytest.mark.parametrize("shape", SHAPES)
def test_scan_equals_brute_force(series, queries_of, shape):
    queries = _queries(SHAPES[shape])
    assert answers(search.knn_scan(series, queries_of(queries), 10)) == nearest(WALKS, queries, 10)


@pytest.mark.parametrize("shape", ["full", "partial block"])
def test_estimated_radius_is_checked(index, queries_of, shape):
    queries = _queries(SHAPES[shape])
    for sample_num in (1, 60):
        found = search.knn_index(index, queries_of(queries), 10, radius="estimate", sample_num=sample_num)
        assert answers(found) == nearest(WALKS, queries, 10)


def test_too_small_radius_is_replaced(index, queries_of):
    queries = search.local_queries(queries_of(_queries(SHAPES["full"])))
    radius = search.checked_radius(index, queries, 10, {q.qid: 0.0 for q in queries})
    truth = {qid: d for qid, rn, _, d in nearest(WALKS, _queries(SHAPES["full"]), 10) if rn == 10}
    assert all(radius[qid] >= truth[qid] for qid in truth)


def test_more_answers_than_series(index, series, queries_of):
    queries = _queries(SHAPES["full"])
    expected = nearest(WALKS, queries, 1000)
    assert answers(search.knn_index(index, queries_of(queries), 1000)) == expected
    assert answers(search.knn_scan(series, queries_of(queries), 1000)) == expected


def test_exclude_self(index, series, queries_of):
    queries = _queries(SHAPES["offset"])
    expected = nearest(WALKS, queries, 5, exclude_self=True)
    assert answers(search.knn_index(index, queries_of(queries), 5, exclude_self=True)) == expected
    assert answers(search.knn_scan(series, queries_of(queries), 5, exclude_self=True)) == expected


def test_auto_takes_both_ways(index, series, queries_of):
    queries = _queries(SHAPES["full"])
    expected = nearest(WALKS, queries, 10)
    found = search.knn(queries_of(queries), 10, "auto", series=series, index=index)
    assert answers(found) == expected
    with pytest.raises(ValueError, match="unknown method"):
        search.knn(queries_of(queries), 10, "other", series=series)


def test_ragged_series(spark, series_of, queries_of):
    values = {i: WALKS[i][: 10 + i % 18] for i in range(120)}
    queries = {i: (list(range(12)), WALKS[i][:12]) for i in (0, 5, 50)}
    series = series_of(values)
    index = write_block_index(series, new_folder(spark, "ragged"), 8, 4, sample_num=40)
    assert index.uniform_len is None
    expected = nearest(values, queries, 7)
    assert answers(search.knn_scan(series, queries_of(queries), 7)) == expected
    assert answers(search.knn_index(index, queries_of(queries), 7)) == expected
    long = {i: (list(range(20)), WALKS[i][:20]) for i in (0, 5)}
    assert answers(search.knn_index(index, queries_of(long), 7)) == nearest(values, long, 7)


def test_id_table_wants_equal_lengths(series, queries_of):
    with pytest.raises(Exception, match="differ in length"):
        search.knn_by_id_table(series, queries_of({0: ([0, 1], [1.0, 2.0])}), 3).collect()


def test_any_number_of_queries_in_packs(series, index, queries_of, monkeypatch):
    monkeypatch.setattr(scan, "PACK_POINTS", 40)
    queries = {i: (SHAPES["offset"], WALKS[i][SHAPES["offset"]]) for i in range(11)}
    want = nearest(WALKS, queries, 4)
    assert answers(search.knn_scan(series, queries_of(queries), 4)) == want
    assert answers(search.knn_index(index, queries_of(queries), 4)) == want
    assert answers(search.knn(queries_of(queries), 4, "auto", series=series, index=index, block_filter=False)) == want


def test_a_query_longer_than_a_pack(spark, series_of, queries_of, monkeypatch):
    monkeypatch.setattr(scan, "PACK_POINTS", 1000)
    values = {i: np.cumsum(np.random.default_rng(i).normal(size=17_000)) for i in range(6)}
    queries = {i: (list(range(17_000)), values[i]) for i in (0, 4)}
    assert answers(search.knn_scan(series_of(values), queries_of(queries), 3)) == nearest(values, queries, 3)


def test_query_ids_are_unique(series, index, queries_of):
    twice = queries_of({1: ([0], [1.0])}).unionAll(queries_of({1: ([1], [2.0])}))
    for run in (lambda: search.knn_scan(series, twice, 1), lambda: join.knn_join(series, twice, 1, index)):
        with pytest.raises(ValueError, match="unique"):
            run()


def test_empty_series_break_the_length_rule(series_of, queries_of):
    series = series_of({1: [1.0, 2.0], 2: []})
    with pytest.raises(Exception, match="differ in length"):
        search.knn_by_id_table(series, queries_of({0: ([0, 1], [1.0, 2.0])}), 1).collect()


def test_pairs_of_the_index_search_are_no_rows(index, queries_of):
    plan = _plan(search.knn_index(index, queries_of(_queries(SHAPES["full"])), 5))
    assert "MapInArrow" in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_sample_radius_is_never_too_small(index, queries_of):
    for shape in SHAPES.values():
        queries = search.local_queries(queries_of(_queries(shape)))
        radius = sample_radius(index.sample, queries, 10)
        truth = {qid: d for qid, rn, _, d in nearest(WALKS, _queries(shape), 10) if rn == 10}
        assert all(radius[qid] >= d for qid, d in truth.items())


def test_many_value_blocks_use_the_array_form(spark, series_of, queries_of):
    values = {i: np.cumsum(np.random.default_rng(i).normal(size=80)) for i in range(150)}
    index = write_block_index(series_of(values), new_folder(spark, "long"), 40, 2, sample_num=50)
    queries = {i: (list(range(5, 70)), values[i][5:70]) for i in (1, 2)}
    assert answers(search.knn_index(index, queries_of(queries), 6)) == nearest(values, queries, 6)


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_plan_prunes_and_pushes_down(index, queries_of):
    queries = search.local_queries(queries_of({0: (list(range(8)), WALKS[0][:8])}))
    rows = ranges.query_block_rows(queries, index, {0: 1.0})
    plan = _plan(ranges.block_candidates(index, rows, block_filter=True).select("id", "qid"))
    assert re.search(r"PartitionFilters: \[[^\]]*tb_dir", plan) and "GreaterThanOrEqual(tmax" in plan
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    # The values are not read where only bounds are needed.
    assert "seg" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("most", [1, 5])
def test_hulls_replace_ranges(index, queries_of, monkeypatch, most):
    monkeypatch.setattr(ranges, "MAX_RANGES", most)
    for shape in ("full", "partial block"):
        queries = _queries(SHAPES[shape])
        assert answers(search.knn_index(index, queries_of(queries), 10)) == nearest(WALKS, queries, 10)


def test_scan_plan_has_no_join(series, queries_of):
    plan = _plan(search.knn_scan(series, queries_of(_queries([0, 1])), 3))
    assert "Join" not in plan and "WindowGroupLimit" in plan
