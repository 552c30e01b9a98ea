"""Replacing writes: what a store holds after them, and what a stopped or late writer leaves."""

import numpy as np
import pytest

from nearwave.plans import search
from nearwave.sources import store as stores
from nearwave.sources.store import Conflict, SeriesStore
from nearwave.sources.tables import write_block_index
from nearwave.workdir import new_folder
from tests.brute_force import answers, nearest

RNG = np.random.default_rng(21)
FIRST = {i: np.cumsum(RNG.normal(size=20)) for i in range(80)}
SECOND = {i: np.cumsum(RNG.normal(size=20)) for i in range(60, 90)} | {3: FIRST[3][:9], 4: FIRST[4][:8]}
REMOVED = [5, 61, 85, 777]
AFTER = {i: v for i, v in (FIRST | SECOND).items() if i not in REMOVED}
QUERIES = {i: (pos, AFTER[i][pos] + 0.1) for i, pos in ((0, list(range(20))), (3, list(range(9))), (70, [2, 15]), (88, [19]))}


def held(df):
    return {r.id: list(r.v) for r in df.collect()}


def plain(values):
    return {i: list(v) for i, v in values.items()}


@pytest.fixture(scope="module")
def written(spark, series_of):
    ids = spark.createDataFrame([(i,) for i in REMOVED + REMOVED], "id BIGINT")
    store = SeriesStore.create(spark, new_folder(spark, "store"), 8, 4, sample_num=30)
    first = store.put(series_of(FIRST))
    second = first.put(series_of(SECOND))
    return first, second, second.remove(ids)


def test_newest_write_of_an_id_counts(written):
    first, second, third = written
    assert held(third.series()) == plain(AFTER)
    assert third.n_series == len(AFTER) and third.uniform_len is None and first.uniform_len == 20
    # Versions that were opened stay as they were.
    assert held(first.series()) == plain(FIRST) and held(second.series()) == plain(FIRST | SECOND)


def test_blocks_equal_a_rebuild(spark, series_of, written):
    rebuilt = write_block_index(series_of(AFTER), new_folder(spark, "rebuilt"), 8, 4, sample_num=30)
    columns = ["tb", "tmax", "tmin", "id", "n", "vb", "seg"]
    of = lambda index: sorted(map(str, index.blocks.select(*columns).collect()))
    assert of(written[-1]) == of(rebuilt)
    assert set(held(written[-1].sample)) <= set(AFTER)


@pytest.mark.parametrize("radius", ["sample", "estimate"])
@pytest.mark.parametrize("block_filter", [False, True])
def test_search(written, queries_of, radius, block_filter):
    found = search.knn_index(written[-1], queries_of(QUERIES), 6, block_filter, radius)
    assert answers(found) == nearest(AFTER, QUERIES, 6)


def test_search_of_many(written, queries_of, monkeypatch):
    monkeypatch.setattr("nearwave.operators.scan.PACK_QUERIES", 2)
    assert answers(search.knn_index(written[-1], queries_of(QUERIES), 6)) == nearest(AFTER, QUERIES, 6)


def test_opening(spark, written):
    first, _, third = written
    assert held(SeriesStore.open(spark, third.path).series()) == plain(AFTER)
    assert held(SeriesStore.open(spark, third.path, first.manifest.version).series()) == plain(FIRST)
    with pytest.raises(ValueError, match="no version 99"):
        SeriesStore.open(spark, third.path, 99)
    with pytest.raises(ValueError, match="no store"):
        SeriesStore.open(spark, new_folder(spark, "nowhere"))


def test_compacting(spark, series_of, queries_of, written):
    store = SeriesStore.create(spark, new_folder(spark, "compact"), 8, 4, sample_num=30)
    store = store.put(series_of(FIRST)).put(series_of(SECOND)).remove(spark.createDataFrame([(5,)], "id BIGINT"))
    small = store.compact()
    assert len(small.manifest.segments) == 1 and held(small.series()) == held(store.series())
    again = small.put(series_of({5: FIRST[5], 0: FIRST[1]}))
    assert held(again.series()) == held(store.series()) | plain({5: FIRST[5], 0: FIRST[1]})


def test_a_writer_that_is_stopped_changes_nothing(spark, series_of, monkeypatch):
    store = SeriesStore.create(spark, new_folder(spark, "stopped"), 8, 4).put(series_of(FIRST))

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(stores, "_commit", stop)
    with pytest.raises(KeyboardInterrupt):
        store.put(series_of(SECOND))
    monkeypatch.undo()
    assert held(SeriesStore.open(spark, store.path).series()) == plain(FIRST)
    assert held(store.put(series_of({1: FIRST[2]})).series()) == plain(FIRST | {1: FIRST[2]})


def test_of_two_writers_one_is_told(spark, series_of):
    store = SeriesStore.create(spark, new_folder(spark, "two"), 8, 4)
    store.put(series_of({1: FIRST[1]}))
    with pytest.raises(Conflict):
        store.put(series_of({2: FIRST[2]}))
    assert held(SeriesStore.open(spark, store.path).series()) == plain({1: FIRST[1]})
    with pytest.raises(Conflict):
        SeriesStore.create(spark, store.path, 8, 4)


def test_nothing_and_empty_series(spark, series_of, queries_of):
    store = SeriesStore.create(spark, new_folder(spark, "empty"), 8, 4)
    assert held(store.series()) == {} and store.n_series == 0
    assert search.knn_index(store, queries_of(QUERIES), 3).count() == 0
    full = store.put(series_of({1: FIRST[1], 2: []}))
    assert held(full.series()) == plain({1: FIRST[1]})
    assert full.put(series_of({})) is full
    gone = full.put(series_of({1: []}))
    assert held(gone.series()) == {} and held(gone.compact().series()) == {}


def test_ids_must_be_unique(spark, series_of):
    store = SeriesStore.create(spark, new_folder(spark, "twice"), 8, 4)
    twice = spark.createDataFrame([(1, [1.0], 1), (1, [2.0], 2)], "id BIGINT, v ARRAY<DOUBLE>, ord INT")
    with pytest.raises(ValueError, match="unique"):
        store.put(twice)
    assert held(store.put(twice, order="ord").series()) == {1: [2.0]}
