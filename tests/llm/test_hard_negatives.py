"""Hard negatives against all pairs, and the curve and bounds they rest on."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearwave.llm import hard_negatives as hard

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"
RNG = np.random.default_rng(8)


def expected(rows, n_positives=5, n_negatives=10):
    first = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        q = [math.floor(float(np.float32(x)) * 256) for x in vector]
        first[vec_id] = min(first.get(vec_id, (label, q)), (label, q))
    out = []
    for anchor, (own, a) in first.items():
        if anchor % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i, label) for i, (label, b) in first.items() if i != anchor)
        for p, positive, _ in [s for s in scores if s[2] == own][:n_positives]:
            p = -p
            fits = [(i, -s) for s, i, label in scores if label != own and 30 * p <= -100 * s <= 90 * p]
            out += [(anchor, positive, r, i, p, s) for r, (i, s) in enumerate(fits[:n_negatives], 1)]
    return sorted(out)


def found(spark, rows, **options):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard.hard_negatives(vectors, **options).collect())


def clustered(n, dims=6):
    centres = RNG.normal(size=(7, dims))
    rows = [(i, [float(x) for x in centres[i % 7] + 0.3 * RNG.normal(size=dims)], int(RNG.integers(4))) for i in range(n)]
    # A third of the rows are one vector: ties are decided by vec_id.
    return rows + [(n + i, rows[0][1], int(i % 3)) for i in range(n // 2)]


@pytest.mark.parametrize("options", [{}, {"block_rows": 9}, {"block_rows": 9, "zone_bytes": 2000, "n_positives": 3, "n_negatives": 4}])
def test_against_all_pairs(spark, options):
    rows = clustered(600)
    names = {k: v for k, v in options.items() if k.startswith("n_")}
    answer = expected(rows, **names)
    assert len(answer) > 100 and found(spark, rows, **options) == answer


def test_odd_rows(spark):
    rows = [(i, [float(x) for x in RNG.normal(size=3)], i % 2) for i in range(0, 400, 10)]
    rows += [(None, [1.0, 0.0, 0.0], 1), (3, None, 1), (5, [1.0, None, 0.0], 1), (9, [math.nan, 0.0, 0.0], 1)]
    rows += [(11, [math.inf, 0.0, 0.0], 1), (12, [1.0, 1.0, 1.0], None), (13, [], 1), (15, [2.0], 0), (15, [1.0], 0), (100, [1.0, 2.0], 1)]
    rows += [(16, [-5.0, 0.0, 0.0], 0), (-200, [0.0, 0.0, 0.0], 5), (-201, [1.0], 5), (-100, [-1.0, -1.0, -1.0], 6), (-102, [1.0] * 3, 6)]
    assert found(spark, rows) == expected(rows)


def test_large_components(spark):
    """Inner products beyond 2^53 are whole numbers too."""
    rows = [(i, [float(x) * 1e5 for x in RNG.normal(size=3)], i % 2) for i in range(0, 700, 10)]
    assert found(spark, rows) == expected(rows)


def test_empty_tables_and_other_columns(spark):
    rows = clustered(210)
    vectors = spark.createDataFrame(rows, SCHEMA)
    extra = vectors.select("*", *[F.lit("x").alias(c) for c in ("q", "key", "rank", "score", "anchor_id", "file", "block", "low")])
    assert sorted(tuple(r) for r in hard.hard_negatives(extra).collect()) == expected(rows)
    assert hard.hard_negatives(vectors.limit(0)).count() == 0
    assert hard.hard_negatives(vectors.filter("vec_id % 100 <> 0")).count() == 0


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (5, 2)])
def test_curve_takes_single_steps(axes, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hard.hilbert_keys(points, bits)
    assert sorted(keys) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_blocks_that_cannot_matter_are_not_read():
    """Three blocks far apart: only the anchor's own is read."""
    centres = np.array([[0, 50], [900, 0], [-900, 0]])
    data = [c + RNG.integers(-9, 9, size=(20, 2)) for c in centres]
    space = hard.Space(2, 1000, np.float64, np.zeros((2, 8)), np.zeros(8), np.ones(8))
    ends = [np.array([f(d, axis=0) for d in data], float) for f in (np.min, np.max)]
    zones = hard.ZoneMaps("", space, ["f"] * 3, np.arange(3), np.arange(3) * 20, np.zeros(3), np.ones(3), *ends)
    labels = np.arange(20) % 2
    reads = []

    def read(at):
        reads.append(int(at))
        return np.arange(20) + 20 * at, labels, data[at].astype(float)

    best = hard.nearest_of_label(zones, read, np.array([20]), np.array([0]), data[1][:1].astype(float), 5)
    assert reads == [1] and set(best.id[0]) <= set(range(20, 40))
    low, high = hard.windows(best.score.astype(np.int64))
    reads.clear()
    hard.best_in_windows(zones, read, np.array([0]), data[1][:1].astype(float), low, high, 10)
    assert 2 not in reads


def test_windows():
    scores = np.array([-7, 0, 1, 99, 101, 2**62 - 1])
    low, high = hard.windows(scores)
    assert low.tolist() == [-(-30 * int(s) // 100) for s in scores]
    assert high.tolist() == [90 * int(s) // 100 for s in scores]


def test_shorter_vectors_end_in_zeros():
    space = hard.Space(3, 10, np.float64, np.zeros((3, 8)), np.zeros(8), np.ones(8))
    assert space.matrix(pa.array([[1, 20], [], [1, 2, -30]], pa.list_(pa.int64()))).tolist() == [[1, 10, 0], [0, 0, 0], [1, 2, -10]]
