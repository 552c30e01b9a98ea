"""The kNN join against brute force, with copies, crowded cells and mixed queries."""

import numpy as np
import pytest

from tests.brute_force import answers, nearest
from nearwave.operators.blocks import as_queries
from nearwave.plans import join
from nearwave.sources.tables import write_block_index
from nearwave.workdir import new_folder

RNG = np.random.default_rng(9)
# A third of the series are exact copies of one.
VALUES = {i: np.cumsum(RNG.normal(size=20)) for i in range(400)}
for i in range(400, 600):
    VALUES[i] = VALUES[7].copy()


@pytest.fixture(scope="module")
def series(series_of):
    return series_of(VALUES)


@pytest.fixture(scope="module")
def index(spark, series):
    return write_block_index(series, new_folder(spark, "join"), 8, 4, sample_num=120)


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("tile_values", [join.TILE_VALUES, 600])
def test_self_join(series, index, exclude_self, tile_values):
    queries = {i: (list(range(20)), v) for i, v in VALUES.items()}
    found = join.knn_join(series, as_queries(series), 4, index, exclude_self, tile_values)
    assert answers(found) == nearest(VALUES, queries, 4, exclude_self)


def test_copies_are_seen_in_the_sample(index):
    assert len(join._hot_vectors(index)) == 1


def test_collapse_keeps_what_can_be_an_answer(series, index):
    kept = join.collapse_copies(series, join._hot_vectors(index), 3)
    ids = {r.id for r in kept.select("id").collect()}
    assert ids == set(range(400)) - {7} | {7, 400, 401}


def test_mixed_query_shapes(series, index, queries_of):
    shapes = [list(range(20)), list(range(5)), [0, 4, 9], [19], list(range(6, 15))]
    queries = {i: (shapes[i % 5], VALUES[i][shapes[i % 5]] + 0.1) for i in range(60)}
    found = join.knn_join(series, queries_of(queries), 5, index, tile_values=2000)
    assert answers(found) == nearest(VALUES, queries, 5)


def test_more_answers_than_the_sample_holds(series, index, queries_of):
    queries = {i: (list(range(20)), VALUES[i]) for i in (0, 7, 500)}
    found = join.knn_join(series, queries_of(queries), 300, index, tile_values=2000)
    assert answers(found) == nearest(VALUES, queries, 300)


def test_ragged_series(spark, series_of, queries_of):
    values = {i: VALUES[i][: 6 + i % 15] for i in range(200)}
    ragged = series_of(values)
    index = write_block_index(ragged, new_folder(spark, "join-ragged"), 8, 4, sample_num=60)
    queries = {i: (list(range(i % 12 + 1)), VALUES[i][: i % 12 + 1]) for i in range(40)}
    found = join.knn_join(ragged, queries_of(queries), 5, index, tile_values=500)
    assert answers(found) == nearest(values, queries, 5)


def test_plan_has_no_cross_join(series, index):
    df = join.tile_join(series, as_queries(series), 3, index)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_chunks_do_not_depend_on_the_size_of_the_stored_sample(spark, series, monkeypatch):
    """Few chunks would lay out the same series for many parts of the queries."""
    few = write_block_index(series, new_folder(spark, "join-few"), 8, 4, sample_num=20)
    seen, reached = [], join.n_bounds_reached
    monkeypatch.setattr(join, "n_bounds_reached", lambda x, bounds: (seen.append(len(bounds)), reached(x, bounds))[1])
    queries = {i: (list(range(20)), v) for i, v in VALUES.items()}
    assert answers(join.knn_join(series, as_queries(series), 4, few)) == nearest(VALUES, queries, 4)
    assert seen and min(seen) >= 3 * spark.sparkContext.defaultParallelism
