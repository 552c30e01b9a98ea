"""Cutting series and queries into time blocks and value blocks.

``t_len`` is the length of a time block, ``v_len`` of a value block inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwave.functions.arrow import flat_lists, list_column


def _chunks(v: Column, length: int) -> Column:
    """Array of consecutive slices; the last one may be short."""
    return F.transform(
        F.sequence(F.lit(0), F.size(v) - 1, F.lit(length)),
        lambda start: F.slice(v, start + 1, F.lit(length)),
    )


def points(series: DataFrame) -> DataFrame:
    """Long form ``(id, pos, v)``."""
    return series.select("id", F.posexplode("v").alias("pos", "v"))


def query_points(queries: DataFrame) -> DataFrame:
    """Long form ``(qid, pos, v)`` of packed queries ``(qid, pos, q)``."""
    return queries.select(
        "qid", F.explode(F.arrays_zip("pos", "q")).alias("p")
    ).select("qid", F.col("p.pos").alias("pos"), F.col("p.q").alias("v"))


def as_queries(series: DataFrame) -> DataFrame:
    """Whole series as packed queries at positions 0 .. L-1."""
    return series.select(
        F.col("id").alias("qid"),
        F.sequence(F.lit(0), F.size("v") - 1).alias("pos"),
        F.col("v").alias("q"),
    )


def slice_queries(queries: DataFrame, first: int, last: int) -> DataFrame:
    """The points of each query at positions ``first`` to ``last``, both kept."""
    inside = F.filter(
        F.arrays_zip("pos", "q"), lambda p: p.getField("pos").between(first, last)
    )
    cut = queries.select("qid", inside.alias("p"))
    return cut.select("qid", F.col("p.pos").alias("pos"), F.col("p.q").alias("q"))


def series_envelope(series: DataFrame) -> DataFrame:
    return series.select("id", F.array_max("v").alias("smax"), F.array_min("v").alias("smin"))


def value_envelopes(seg: Column, v_len: int) -> Column:
    """``array<struct(mx, mn)>``, one per value block of ``seg``."""
    return F.transform(
        _chunks(seg, v_len),
        lambda c: F.struct(F.array_max(c).alias("mx"), F.array_min(c).alias("mn")),
    )


BLOCK_SCHEMA = "tb INT, tmax DOUBLE, tmin DOUBLE, id BIGINT, n INT, vb ARRAY<STRUCT<mx: DOUBLE, mn: DOUBLE>>"


def _starts(begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut each run ``begin .. end`` every ``length`` values: starts, and pieces per run."""
    pieces = -(-(end - begin) // length)
    run = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return begin[run] + nth * length, pieces


def time_blocks(series: DataFrame, t_len: int, v_len: int, values: bool = True) -> DataFrame:
    """One row per series and time block: ``(tb, tmax, tmin, id, n, vb, seg)``.

    ``values=False`` leaves out ``seg`` where only bounds are compared.

    Blocks lie one behind the other in a batch's values, so all envelopes of a batch are
    two segmented reductions and the segments are the values themselves, re-labelled.
    """
    names = ["tb", "tmax", "tmin", "id", "n", "vb", *(["seg"] if values else [])]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat, offsets = flat_lists(batch.column(1))
            if not len(flat):
                continue
            start, per_series = _starts(offsets[:-1], offsets[1:], t_len)
            end = np.append(start[1:], len(flat))
            v_start, per_block = _starts(start, end, v_len)
            row = np.repeat(np.arange(len(ids)), per_series)
            envelopes = pa.StructArray.from_arrays(
                [pa.array(f.reduceat(flat, v_start)) for f in (np.maximum, np.minimum)], names=["mx", "mn"]
            )
            segments = [list_column(flat, np.append(start, len(flat)))] if values else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(((start - offsets[row]) // t_len).astype(np.int32)),
                    pa.array(np.maximum.reduceat(flat, start)),
                    pa.array(np.minimum.reduceat(flat, start)),
                    pa.array(ids[row]),
                    pa.array((end - start).astype(np.int32)),
                    list_column(envelopes, np.append(0, np.cumsum(per_block))),
                    *segments,
                ],
                names=names,
            )

    usable = series.filter(F.size("v") > 0).select("id", "v")
    return usable.mapInArrow(kernel, f"{BLOCK_SCHEMA}, seg ARRAY<DOUBLE>" if values else BLOCK_SCHEMA)


def value_blocks(blocks: DataFrame) -> DataFrame:
    """Long form of the value-block envelopes: ``(id, tb, vblk, mx, mn)``."""
    return blocks.select("id", "tb", F.posexplode("vb").alias("vblk", "e")).select(
        "id", "tb", "vblk", F.col("e.mx").alias("mx"), F.col("e.mn").alias("mn")
    )


def query_blocks(queries: DataFrame, t_len: int, v_len: int) -> DataFrame:
    """Envelopes of the queried points per value block.

    Returns ``(qid, tb, vblk, qmax, qmin, n_points)``; only touched blocks appear.
    """
    return (
        query_points(queries)
        .groupBy(
            "qid",
            F.floor(F.col("pos") / t_len).cast("int").alias("tb"),
            F.floor(F.col("pos") % t_len / v_len).cast("int").alias("vblk"),
        )
        .agg(F.max("v").alias("qmax"), F.min("v").alias("qmin"), F.count("v").alias("n_points"))
    )
