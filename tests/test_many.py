"""Query tables beyond a pack: one scan, any shape, against brute force."""

import numpy as np
import pytest

from nearwave.operators import asked, many, scan
from nearwave.plans import search
from nearwave.sources.tables import write_block_index
from nearwave.workdir import new_folder
from tests.brute_force import answers, nearest

RNG = np.random.default_rng(12)
VALUES = {i: np.cumsum(RNG.normal(size=21)) * 10 for i in range(150)}
for i in range(150, 190):
    VALUES[i] = VALUES[5].copy()
SHAPES = [list(range(21)), list(range(6, 15)), [0, 4, 9], [20], list(range(3))]
QUERIES = {i: (SHAPES[i % 5], VALUES[i][SHAPES[i % 5]] + (i % 3) * 0.1) for i in range(60)}


@pytest.fixture(scope="module")
def series(series_of):
    return series_of(VALUES)


@pytest.fixture(scope="module")
def index(spark, series):
    return write_block_index(series, new_folder(spark, "many"), 8, 4, sample_num=50)


@pytest.fixture(params=["small", "large"])
def sizes(request, monkeypatch):
    """Packs, chunks and steps of a few rows, and as they are."""
    monkeypatch.setattr(scan, "PACK_QUERIES", 7)
    if request.param == "small":
        for module, name, value in (
            (many, "PACK_POINTS", 50),
            (many, "CHUNK_VALUES", 200),
            (asked, "PACK_POINTS", 40),
            (asked, "STEP_VALUES", 100),
            (asked, "STEP_PAIRS", 30),
            (asked, "POINTS_AT_ONCE", 2),
        ):
            monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_scan_and_index(series, index, queries_of, sizes, exclude_self):
    want = nearest(VALUES, QUERIES, 4, exclude_self)
    assert answers(search.knn_scan(series, queries_of(QUERIES), 4, exclude_self=exclude_self)) == want
    assert answers(search.knn_index(index, queries_of(QUERIES), 4, exclude_self=exclude_self)) == want


def test_more_answers_than_series(series, queries_of, sizes):
    some = {i: QUERIES[i] for i in range(10)}
    assert answers(search.knn_scan(series, queries_of(some), 500)) == nearest(VALUES, some, 500)


def test_ragged_series(spark, series_of, queries_of, sizes):
    values = {i: VALUES[i][: 5 + i % 17] for i in range(120)} | {500: np.empty(0)}
    ragged = series_of(values)
    index = write_block_index(ragged, new_folder(spark, "many-ragged"), 8, 4, sample_num=40)
    values.pop(500)
    queries = {i: (list(range(i % 14 + 1)), VALUES[i][: i % 14 + 1]) for i in range(30)} | {99: ([18, 20], np.array([1.0, 2.0]))}
    want = nearest(values, queries, 5)
    assert answers(search.knn_scan(ragged, queries_of(queries), 5)) == want
    assert answers(search.knn_index(index, queries_of(queries), 5)) == want


def test_id_table(series, queries_of, sizes):
    whole = {i: (SHAPES[0], VALUES[i]) for i in range(20)}
    assert answers(search.knn_by_id_table(series, queries_of(whole), 3)) == nearest(VALUES, whole, 3)
    with pytest.raises(Exception, match="differ in length"):
        search.knn_by_id_table(series, queries_of(QUERIES), 3).collect()


@pytest.mark.parametrize("block_filter", [False, True])
@pytest.mark.parametrize("given", [25.0, {i: 5.0 + i for i in QUERIES}])
def test_given_radii(index, queries_of, sizes, given, block_filter):
    """The same rows as from the plan for few queries."""
    few = search.local_queries(queries_of(QUERIES))
    want = answers(search.knn_within_radius(index, few, 6, given, block_filter))
    assert want and answers(search.knn_within_radius(index, queries_of(QUERIES), 6, given, block_filter)) == want
    if isinstance(given, dict):
        want = answers(search.knn_index(index, few, 6, block_filter, radius=given))
        assert answers(search.knn_index(index, queries_of(QUERIES), 6, block_filter, radius=given)) == want


def test_auto(series, index, queries_of, sizes):
    found = search.knn(queries_of(QUERIES), 4, "auto", series=series, index=index)
    assert answers(found) == nearest(VALUES, QUERIES, 4)


def test_one_scan_whatever_the_number_of_queries(series, queries_of, sizes, spark, tmp_path):
    series.write.parquet(str(tmp_path / "series"))
    stored = spark.read.parquet(str(tmp_path / "series"))
    plans = []
    for n in (8, 60):
        df = search.knn_scan(stored, queries_of({i: QUERIES[i] for i in range(n)}), 4)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert all(p.count("FileScan") == 1 and "NestedLoop" not in p and "Cartesian" not in p for p in plans)


def test_sample_radii_use_the_whole_sample(series, index, queries_of):
    """Also for more answers than any bounded matrix of the sample would hold."""
    n = index.sample.count()
    radii = many.sample_radii(index.sample, many.store_queries(queries_of(QUERIES)), n).collect()
    sample = {r.id: np.array(r.v) for r in index.sample.collect()}
    want = {qid: d for qid, rn, _, d in nearest(sample, QUERIES, n) if rn == n}
    assert {r.qid: r.radius for r in radii} == want
