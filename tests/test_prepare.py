import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwave.operators import prepare

# Hand-made series for every branch of the interpolation.
GAPS = {
    1: [0, 2, 0, 0, 8, 0],
    2: [0, 0, 5, 0, 0, 0],
    3: [0, 0, 0, 0, 0, 0],
    4: [1, 2, 3, 4, 5, 6],
    5: [3, 0, 0, 1, 0, 0],
    6: [0, 0, 0, 7, 1, 4],
}
REPAIRED = {
    1: [0, 2, 4, 6, 8, 10],
    2: [5] * 6,
    4: [1, 2, 3, 4, 5, 6],
    6: [25, 19, 13, 7, 1, 4],
}


def _dict(df):
    return {r.id: list(r.v) for r in df.collect()}


def test_clean(series_of):
    cleaned = _dict(prepare.clean_series(series_of(GAPS)))
    assert set(cleaned) == {1, 2, 4, 5, 6}
    for i, v in REPAIRED.items():
        assert cleaned[i] == pytest.approx(v)
    slope = (1 - 3) / 3
    assert cleaned[5] == pytest.approx([3 + slope * i for i in range(6)])


def test_other_marker_fills_with_the_observed_value(series_of):
    cleaned = _dict(prepare.clean_series(series_of({1: [-1, 0, -1], 2: [-1, -1, -1], 3: [-1, 4, 6]}), missing=-1.0))
    assert cleaned == {1: [0, 0, 0], 3: [2, 4, 6]}


def _plain(v):
    """Point by point restatement of the rules."""
    seen = [i for i, x in enumerate(v) if x != 0]
    if len(seen) == 1:
        return [v[seen[0]]] * len(v)
    out = []
    for i, x in enumerate(v):
        if x != 0 or not seen:
            out.append(x)
            continue
        left, right = [s for s in seen if s < i], [s for s in seen if s > i]
        if left and right:
            a, b = left[-1], right[0]
        elif right:
            a, b = right[0], right[1]
        else:
            a, b = left[-2], left[-1]
        out.append(((v[b] - v[a]) / (b - a)) * (i - a) + v[a])
    return out


def test_random_gaps(series_of):
    rng = np.random.default_rng(2)
    values = {i: rng.integers(0, 3, size=rng.integers(1, 12)).astype(float) for i in range(300)}
    filled = _dict(prepare.interpolate_missing(series_of(values)))
    for i, v in values.items():
        assert filled[i] == _plain(list(v)), v


WAVES = {i: np.round(np.sin(np.arange(9) + i) * 10 + 12, 3) for i in (5, -3, 1 << 40)}


@pytest.mark.parametrize("partitions", [1, 3])
def test_jitter_stays_within_its_range(series_of, partitions):
    noisy = _dict(prepare.jitter_series(series_of(WAVES, partitions), rate=0.4, seed=3))
    again = _dict(prepare.jitter_series(series_of(WAVES, 2), rate=0.4, seed=3))
    other = _dict(prepare.jitter_series(series_of(WAVES, 2), rate=0.4, seed=4))
    assert noisy == again and noisy != other
    for i, v in WAVES.items():
        assert np.abs(np.array(noisy[i]) - v).max() <= 0.5 * (v.max() - v.min()) / 2 * 0.4 + 1e-5


def test_jitter_floor(series_of):
    noisy = _dict(prepare.jitter_series(series_of({1: [-5.0, 0.0, 5.0]}), rate=1.0))
    assert min(noisy[1]) == 0.0


def test_augment(series_of):
    series = series_of(WAVES)
    grown = prepare.augment_dense(series, size=3, dim=2, seed=1)
    rows = _dict(grown)
    assert sorted(rows) == list(range(1, 13))
    assert {len(v) for v in rows.values()} == {27}
    # In id order, copies first: every fourth row starts with the series itself.
    for rank, i in enumerate(sorted(WAVES), 1):
        assert rows[rank * 4][:9] == list(WAVES[i])
        assert rows[rank * 4 - 1][:9] != list(WAVES[i])
    profile = prepare.augment_profile(grown, "waves").first()
    assert (profile.n_rows, profile.dim, profile.name) == (12, 27, "waves_12_27")


def test_augment_by_nothing_renumbers(series_of):
    rows = _dict(prepare.augment_dense(series_of(WAVES)))
    assert rows == {n: list(WAVES[i]) for n, i in enumerate(sorted(WAVES), 1)}


@pytest.mark.parametrize("n", [1, 5, 5000])
def test_ranks_are_dense(spark, n):
    ids = spark.range(n).select((F.col("id") * F.col("id") * 3 - 50).alias("id")).distinct()
    ranked = prepare.dense_rank_of_ids(ids, buckets=16).orderBy("id").collect()
    assert [r.rank for r in ranked] == list(range(1, len(ranked) + 1))
