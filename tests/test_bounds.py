"""Bounds stay on their side of the distance, and samples do not depend on the layout."""

import numpy as np
from pyspark.sql import functions as F

from nearwave.functions import distance
from nearwave.functions.hashing import hash32, hash32_np
from nearwave.functions.noise import unit_normal
from nearwave.operators import blocks, sampling
from nearwave.operators.scan import envelope_bound
from nearwave.operators.topk import top_k


def test_order_of_bounds(spark):
    rng = np.random.default_rng(4)
    rows = [(list(map(float, rng.normal(size=12))), list(map(float, rng.normal(size=12)))) for _ in range(500)]
    pairs = spark.createDataFrame(rows, "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    ends = [f(c) for c in ("a", "b") for f in (F.array_max, F.array_min)]
    ends = [ends[0], ends[1], ends[2], ends[3]]
    cut = [blocks.value_envelopes(F.col(c), 5) for c in ("a", "b")]
    full = distance.covered_bound(*ends[:2], F.lit(12), *ends[2:], F.lit(12))
    partly = distance.covered_bound(*ends[:2], F.lit(13), *ends[2:], F.lit(12))
    found = pairs.select(
        distance.block_lower_bound(*ends).alias("lower"),
        distance.multi_block_lower_bound(*cut).alias("multi"),
        full.alias("full"),
        partly.alias("partly"),
        distance.chebyshev(F.col("a"), F.col("b")).alias("dist"),
        distance.block_upper_bound(*ends).alias("upper"),
        "a",
        "b",
    ).collect()
    for r in found:
        assert r.lower <= r.full <= r.dist <= r.upper
        assert 0 <= r.partly <= r.dist and r.multi <= r.dist
        a, b = np.array(r.a), np.array(r.b)
        assert r.dist == np.abs(a - b).max()
        assert r.lower == envelope_bound(a.max(keepdims=True), a.min(keepdims=True), b.max(), b.min())[0]


def test_unequal_lengths_fail(spark):
    pair = spark.createDataFrame([([1.0, 2.0], [1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    for f in (distance.chebyshev,):
        try:
            pair.select(f(F.col("a"), F.col("b"))).collect()
        except Exception as error:
            assert "lengths differ" in str(error)
        else:
            raise AssertionError("no error")


def test_hash_forms_agree(spark):
    ids = [0, 1, -1, 5, 1 << 40, -(1 << 50)]
    df = spark.createDataFrame([(i,) for i in ids], "id BIGINT").select("id", hash32(9, F.col("id"), 3).alias("h"))
    assert {r.id: r.h for r in df.collect()} == dict(zip(ids, hash32_np(9, np.array(ids), 3).tolist()))


def test_samples_do_not_depend_on_partitions(series_of):
    values = {i: [i, i + 1.0] for i in range(500)}
    picks = []
    for partitions in (1, 7):
        series = series_of(values, partitions)
        sampled = sampling.bernoulli_sample(series, 0.2, 3)
        queries = sampling.sample_queries(series, 9, 3)
        picks.append(
            ({r.id for r in sampled.collect()}, [(r.qid, tuple(r.q)) for r in queries.orderBy("qid").collect()])
        )
    assert picks[0] == picks[1]
    assert 60 < len(picks[0][0]) < 140 and len(picks[0][1]) == 9


def test_noise_is_a_normal_between_0_and_1():
    g = unit_normal((np.arange(200_000) + 0.5) / 200_000)
    assert 0 < g.min() and g.max() <= 1.0
    assert abs(g.mean() - 0.4599) < 1e-3 and abs(g.std() - 0.2817) < 2e-3


def test_blocks_of_ragged_series(series_of):
    values = {1: [3.0, 1.0, 2.0, 9.0, 8.0], 2: [5.0], 3: [1.0, 1.0, 4.0]}
    cut = {(r.id, r.tb): r for r in blocks.time_blocks(series_of(values), 3, 2).collect()}
    assert set(cut) == {(1, 0), (1, 1), (2, 0), (3, 0)}
    assert [tuple(e) for e in cut[1, 0].vb] == [(3.0, 1.0), (2.0, 2.0)]
    assert (cut[1, 1].tmax, cut[1, 1].tmin, cut[1, 1].n, cut[1, 1].seg) == (9.0, 8.0, 2, [9.0, 8.0])
    assert [tuple(e) for e in cut[3, 0].vb] == [(1.0, 1.0), (4.0, 4.0)]


def test_top_k_in_pieces(spark):
    rng = np.random.default_rng(1)
    rows = [(int(q), int(i), float(d)) for q in (1, 2) for i, d in enumerate(rng.integers(0, 50, size=400))]
    pairs = spark.createDataFrame(rows, "qid BIGINT, id BIGINT, dist DOUBLE").repartition(5)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    plain = sorted(map(tuple, top_k(pairs, 30).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted(map(tuple, top_k(pairs, 30).collect())) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    for qid in (1, 2):
        nearest = sorted((d, i) for q, i, d in rows if q == qid)[:30]
        assert [(r[3], r[2]) for r in plain if r[0] == qid] == nearest
