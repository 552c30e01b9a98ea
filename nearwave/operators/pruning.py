"""How many series the index's filters let through, at many radii and block lengths, in one scan of the series.

Whether a series passes depends on the radius alone: there is a least radius at which it does.  A task works
out these thresholds for its series, query and block lengths by numpy, and counts how many lie within each radius.  No
(setting, query, series) row exists, nothing is shuffled but the counts, and blocks are cut once for all settings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwave.functions.arrow import at_positions, flat_lists
from nearwave.operators.scan import row_steps

COUNTS = "key BIGINT, n_range BIGINT, n_filtered BIGINT"


@dataclass(frozen=True)
class Trial:
    """One query under one pair of block lengths, with the radii at which series are counted."""

    t_len: int
    v_len: int
    rows: list[dict]
    """Its query blocks, as from ``ranges.query_block_rows``."""
    radii: list[tuple[int, float]]
    """Keys of the counts, and the radius of each."""


class _Envelopes:
    """Envelopes of the series of a batch, each block cut once whichever setting asks for it."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.cut: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest and least value at the positions, NaN where there is none, and the number of values."""
        key = start, min(stop, len(self.matrix))
        if key not in self.cut:
            part = self.matrix[slice(*key)]
            self.cut[key] = np.fmax.reduce(part, axis=0), np.fmin.reduce(part, axis=0), (~np.isnan(part)).sum(axis=0)
        return self.cut[key]


def _beyond(env: dict, mx: np.ndarray, mn: np.ndarray) -> np.ndarray:
    """Least radius at which a stored envelope meets a query's: one-sided unless the block is fully queried."""
    apart = np.fmax(env["mx"] - mx, mn - env["mn"])
    if env["fmx"] is not None:
        apart = np.fmax(apart, np.fmax(mx - env["fmx"], env["fmn"] - mn))
    return apart


def thresholds(envelopes: _Envelopes, trial: Trial) -> tuple[np.ndarray, np.ndarray]:
    """Per series the least radii for the range test and for both filters; NaN if it is too short."""
    n = envelopes.matrix.shape[1]
    in_range, bound, long_enough = np.full(n, -np.inf), np.zeros(n), np.ones(n, bool)
    for row in trial.rows:
        first = row["tb"] * trial.t_len
        mx, mn, size = envelopes.of(first, first + trial.t_len)
        long_enough &= size > row["last"]
        in_range = np.fmax(in_range, _beyond(row["env"], mx, mn))
        for j, env in enumerate(row["qvb"]):
            if env is not None:
                start = first + j * trial.v_len
                mx, mn, _ = envelopes.of(start, min(start + trial.v_len, first + trial.t_len))
                bound = np.fmax(bound, _beyond(env, mx, mn))
    in_range[~long_enough] = np.nan
    return in_range, np.maximum(in_range, bound)


def pruning_counts(series: DataFrame, trials: list[Trial]) -> DataFrame:
    """``(key, n_range, n_filtered)`` of every radius: series left by the range test, and by the block bound on top."""
    if not trials:
        return series.sparkSession.createDataFrame([], COUNTS)
    width = 1 + max(row["tb"] * t.t_len + t.t_len for t in trials for row in t.rows)
    keys = np.array([key for t in trials for key, _ in t.radii], np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_range, n_filtered = np.zeros((2, len(keys)), np.int64)
        for batch in batches:
            flat, offsets = flat_lists(batch.column(0))
            longest = min(width, int(np.diff(offsets).max(initial=0)))
            for rows in row_steps(len(offsets) - 1, longest):
                ends = offsets[rows.start : rows.stop + 1]
                matrix = at_positions(flat[ends[0] : ends[-1]], ends - ends[0], np.arange(longest))
                envelopes = _Envelopes(matrix)
                at = 0
                for trial in trials:
                    radii = [r for _, r in trial.radii]
                    for counts, found in zip((n_range, n_filtered), thresholds(envelopes, trial)):
                        # NaN sorts last and is never counted.
                        found = np.sort(found[~np.isnan(found)])
                        counts[at : at + len(radii)] += np.searchsorted(found, radii, side="right")
                    at += len(radii)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (keys, n_range, n_filtered)], names=["key", "n_range", "n_filtered"]
        )

    counted = series.filter(F.size("v") > 0).select(F.slice("v", 1, width).alias("v")).mapInArrow(kernel, COUNTS)
    return counted.groupBy("key").agg(F.sum("n_range").alias("n_range"), F.sum("n_filtered").alias("n_filtered"))
