"""Counts at many radii in one scan, against the counts by joined block rows."""

import numpy as np
import pytest

from nearwave.operators import pruning, ranges, scan
from nearwave.plans import search, sweeps
from nearwave.sources.tables import UnstoredIndex, write_block_index
from nearwave.workdir import new_folder

RNG = np.random.default_rng(17)
VALUES = {i: np.cumsum(RNG.normal(size=27)) for i in range(120)}
QUERIES = {
    0: (list(range(27)), VALUES[0]),
    1: (list(range(5, 19)), VALUES[1][5:19] + 0.2),
    2: ([0, 3, 26], VALUES[2][[0, 3, 26]]),
    3: ([9], VALUES[3][[9]] - 1),
}
RADII = [0.0, 0.5, 1.5, 4.0, np.inf]
LENGTHS = [(4, 4), (8, 3), (27, 5), (40, 40), (1, 1)]


@pytest.mark.parametrize("ragged", [False, True])
@pytest.mark.parametrize("t_len,v_len", LENGTHS)
def test_against_joined_blocks(series_of, queries_of, monkeypatch, ragged, t_len, v_len):
    monkeypatch.setattr(scan, "VALUES_PER_STEP", 300)
    series = series_of({i: v[: 1 + i % 27] if ragged else v for i, v in VALUES.items()} | {500: []})
    index = UnstoredIndex(series, t_len, v_len, None if ragged else 27)
    queries = search.local_queries(queries_of(QUERIES))
    trials = [
        pruning.Trial(t_len, v_len, ranges.query_block_rows([q], index, {q.qid: 0.0}), [(10 * q.qid + i, r) for i, r in enumerate(RADII)])
        for q in queries
    ]
    found = {(r.key, r.n_range, r.n_filtered) for r in pruning.pruning_counts(series, trials).collect()}
    want = set()
    for i, r in enumerate(RADII):
        rows = ranges.query_block_rows(queries, index, {q.qid: r for q in queries})
        counted = {c.qid: (c.n_range, c.n_filtered) for c in ranges.candidate_counts(index, rows).collect()}
        want |= {(10 * q.qid + i, *counted.get(q.qid, (0, 0))) for q in queries}
    assert found == want


def test_one_scan_for_all_settings(spark, series_of, queries_of, tmp_path):
    series_of(VALUES).write.parquet(str(tmp_path / "series"))
    series = spark.read.parquet(str(tmp_path / "series"))
    queries = search.local_queries(queries_of(QUERIES))
    counts = sweeps.pruning_by_block_lengths(series, queries, {q.qid: 2.0 for q in queries}, LENGTHS, 27)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "hashpartitioning(id" not in plan
    assert {(r.t_len, r.v_len) for r in counts.collect()} == set(LENGTHS)


def test_series_from_the_index(spark, series_of, queries_of):
    series = series_of(VALUES)
    index = write_block_index(series, new_folder(spark, "pruning"), 8, 4, sample_num=40)
    queries = search.local_queries(queries_of({1: QUERIES[1]}))
    given, rebuilt = (sorted(map(tuple, sweeps.pruning_by_k(index, queries, [1, 5], s).collect())) for s in (series, None))
    assert given == rebuilt and all(n_range >= n_filtered >= k for k, _, _, n_range, n_filtered in given)
