"""Repairing and augmenting series.

All of these work series by series, so they run as Arrow kernels over the array form:
no series is exploded into points and nothing is shuffled, except the narrow id ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearwave.functions.arrow import flat_lists, list_column, row_of_value
from nearwave.functions.hashing import uniform_np
from nearwave.functions.noise import unit_normal
from nearwave.workdir import new_folder

# Fixed values of the noise: decimals kept, and the floor of every value.
DECIMAL_SCALE = 100000.0
FLOOR = 0.0
DEFAULT_RATE = 0.1

# Streams of random numbers that must not repeat each other.
POINT_STREAM = 0
RATE_STREAM = 1
# Ids are ranked side by side in buckets of about this size.
IDS_PER_BUCKET = 1_000_000


def _fill(flat: np.ndarray, offsets: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated values, and the number of observed values per row."""
    observed = flat != missing
    where = np.flatnonzero(observed)
    first = np.searchsorted(where, offsets[:-1])
    end = np.searchsorted(where, offsets[1:])
    count = end - first
    row = row_of_value(offsets)
    out = flat.copy()

    single = np.flatnonzero(count == 1)
    lone = np.zeros(len(count))
    lone[single] = flat[where[first[single]]]
    spread = ~observed & (count == 1)[row]
    out[spread] = lone[row[spread]]

    gap = np.flatnonzero(~observed & (count >= 2)[row])
    if len(gap):
        r = row[gap]
        # Neighbouring observed values, moved inwards where one side has none: the line
        # then goes through the first two or the last two.
        right = np.searchsorted(where, gap)
        right = np.clip(right, first[r] + 1, end[r] - 1)
        x2, x1 = where[right], where[right - 1]
        y2, y1 = flat[x2], flat[x1]
        out[gap] = ((y2 - y1) / (x2 - x1)) * (gap - x1) + y1
    return out, count


def interpolate_missing(series: DataFrame, missing: float = 0.0) -> DataFrame:
    """``(id, v, n_observed)`` with missing values on the line of their neighbours.

    One observed value fills the whole series; without any the series is left as it is.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_lists(batch.column(1))
            filled, count = _fill(flat, offsets, missing)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_column(filled, offsets), pa.array(count.astype(np.int32))],
                names=["id", "v", "n_observed"],
            )

    return series.select("id", "v").mapInArrow(kernel, "id BIGINT, v ARRAY<DOUBLE>, n_observed INT")


def clean_series(series: DataFrame, missing: float = 0.0) -> DataFrame:
    """Repaired series; those without any observed value are dropped."""
    return interpolate_missing(series, missing).filter(F.col("n_observed") > 0).select("id", "v")


def _jitter(
    flat: np.ndarray,
    offsets: np.ndarray,
    ids: np.ndarray,
    copy: tuple[int, int],
    seed: int,
    rate: np.ndarray,
) -> np.ndarray:
    """One noisy copy of every series, at ``rate`` of half its own range."""
    row = row_of_value(offsets)
    pos = np.arange(len(flat)) - offsets[:-1][row]
    hi = np.maximum.reduceat(flat, offsets[:-1])[row]
    lo = np.minimum.reduceat(flat, offsets[:-1])[row]
    noise = unit_normal(uniform_np(seed, POINT_STREAM, ids[row], *copy, pos))
    moved = np.maximum(flat + (noise - 0.5) * ((hi - lo) / 2) * rate[row], FLOOR)
    return np.floor(moved * DECIMAL_SCALE + 0.5) / DECIMAL_SCALE


def _drawn_rates(ids: np.ndarray, copy: tuple[int, int], seed: int) -> np.ndarray:
    return unit_normal(uniform_np(seed, RATE_STREAM, ids, *copy, 0))


def jitter_series(series: DataFrame, rate: float = DEFAULT_RATE, seed: int = 0) -> DataFrame:
    """``(id, v)`` with noise on every point, floored at zero, at 5 decimals."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat, offsets = flat_lists(batch.column(1))
            if not len(flat):
                continue
            noisy = _jitter(flat, offsets, ids, (0, 0), seed, np.full(len(ids), rate))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_column(noisy, offsets)], names=["id", "v"]
            )

    return series.filter(F.size("v") > 0).select("id", "v").mapInArrow(
        kernel, "id BIGINT, v ARRAY<DOUBLE>"
    )


def _appended(parts: list[np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of several equally shaped lists put one behind the other, row by row."""
    lengths = np.diff(offsets)
    out_offsets = np.concatenate([[0], np.cumsum(lengths * len(parts))])
    row = row_of_value(offsets)
    pos = np.arange(len(parts[0])) - offsets[:-1][row]
    out = np.empty(out_offsets[-1])
    for i, part in enumerate(parts):
        out[out_offsets[:-1][row] + i * lengths[row] + pos] = part
    return out, out_offsets


def augment(series: DataFrame, size: int = 0, dim: int = 0, seed: int = 0) -> DataFrame:
    """``(id, copy, v)``: ``size`` noisy copies of each series, then the series itself.

    Every such row is then followed, within its array, by ``dim`` noisy copies of itself.
    Copies count from 0 and the original has ``copy = size``.  Each copy draws its own
    noise rate.  A column ``rank`` of the input is kept.
    """
    kept = ["id", *(["rank"] if "rank" in series.columns else [])]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat, offsets = flat_lists(batch.column(len(kept)))
            if not len(flat):
                continue
            for copy in range(size + 1):
                base = flat
                if copy < size:
                    key = (copy + 1, 0)
                    base = _jitter(flat, offsets, ids, key, seed, _drawn_rates(ids, key, seed))
                parts = [base]
                for extra in range(1, dim + 1):
                    key = (copy + 1, extra)
                    parts.append(_jitter(base, offsets, ids, key, seed, _drawn_rates(ids, key, seed)))
                values, ends = _appended(parts, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: len(kept)],
                        pa.array(np.full(len(ids), copy, dtype=np.int32)),
                        list_column(values, ends),
                    ],
                    names=[*kept, "copy", "v"],
                )

    schema = ", ".join(f"{name} BIGINT" for name in kept) + ", copy INT, v ARRAY<DOUBLE>"
    return series.filter(F.size("v") > 0).select(*kept, "v").mapInArrow(kernel, schema)


def dense_rank_of_ids(ids: DataFrame, buckets: int | None = None) -> DataFrame:
    """``(id, rank)`` with ranks 1 .. N in id order, for unique ids.

    Ids are range-partitioned into buckets of bounded size and stored with their bucket, ranked
    inside each, and shifted by the counts of the buckets before.  Reading the stored buckets,
    both steps and any re-run task agree on them.
    """
    spark = ids.sparkSession
    ids = ids.select("id")
    if buckets is None:
        buckets = 1 + ids.count() // IDS_PER_BUCKET
    folder = new_folder(spark, "ranks")
    ids.repartitionByRange(buckets, "id").withColumn("bucket", F.spark_partition_id()).write.parquet(folder)
    placed = spark.read.schema("id BIGINT, bucket INT").parquet(folder)
    # One row for each bucket.
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", F.coalesce(before, F.lit(0)).alias("base")
    )
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
    return placed.withColumn("inside", inside).join(offsets, "bucket").select(
        "id", (F.col("base") + F.col("inside")).alias("rank")
    )


def augment_dense(series: DataFrame, size: int = 0, dim: int = 0, seed: int = 0) -> DataFrame:
    """``augment`` under new ids 1 .. N: copies of a series first, then the series, in id order.

    Only ids are ranked; the series meet their rank in one join before they multiply.
    Noise depends on the old ids, so a series gets the same copies whatever its rank.
    Empty series are left out before ranking; repeated ids are an error.
    """
    usable = series.filter(F.size("v") > 0).select("id", "v")
    if usable.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("series ids must be unique")
    ranked = usable.join(dense_rank_of_ids(usable), "id")
    new_id = (F.col("rank") - 1) * (size + 1) + F.col("copy") + 1
    return augment(ranked, size, dim, seed).select(new_id.alias("id"), "v")


def augment_profile(augmented: DataFrame, prefix: str) -> DataFrame:
    """Rows, length of the first row, and the data set name ``prefix_rows_length``."""
    return augmented.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min_by(F.size("v"), F.col("id")).alias("dim")
    ).select("n_rows", "dim", F.concat_ws("_", F.lit(prefix), "n_rows", "dim").alias("name"))
