"""Distances and bounds as column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chebyshev(a: Column, b: Column) -> Column:
    """Largest absolute difference of two equally long arrays; unequal lengths raise."""
    return F.when(
        F.size(a) == F.size(b),
        F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    ).otherwise(F.raise_error(F.lit("series lengths differ")).cast("double"))


def block_lower_bound(amax: Column, amin: Column, bmax: Column, bmin: Column) -> Column:
    """Envelope-to-envelope lower bound of the distance of two blocks over the same positions."""
    ends_a = [
        F.least(F.abs(end - bmax), F.abs(end - bmin)) for end in (amax, amin)
    ]
    ends_b = [
        F.least(F.abs(end - amax), F.abs(end - amin)) for end in (bmax, bmin)
    ]
    return F.greatest(*ends_a, *ends_b)


def multi_block_lower_bound(a: Column, b: Column) -> Column:
    """Largest :func:`block_lower_bound` over aligned arrays of ``struct(mx, mn)``."""
    return F.when(
        F.size(a) == F.size(b),
        F.array_max(
            F.zip_with(
                a,
                b,
                lambda x, y: block_lower_bound(
                    x.getField("mx"), x.getField("mn"), y.getField("mx"), y.getField("mn")
                ),
            )
        ),
    ).otherwise(F.raise_error(F.lit("block counts differ")).cast("double"))


def block_upper_bound(smax: Column, smin: Column, qmax: Column, qmin: Column) -> Column:
    """Never below the distance of two series with these envelopes."""
    return F.greatest(F.abs(smax - qmin), F.abs(smin - qmax))


def covered_bound(mx, mn, stored, qmx, qmn, queried) -> Column:
    """Lower bound that also holds when only some positions of a block are queried.

    A fully queried block must match both envelope ends.  A partly queried one
    only tells that its values lie inside the stored envelope.
    """
    return F.when(
        queried == stored, F.greatest(F.abs(mx - qmx), F.abs(mn - qmn))
    ).otherwise(F.greatest(qmx - mx, mn - qmn, F.lit(0.0)))


# Up to this many value blocks the bound is one flat expression that Spark compiles.
MAX_UNROLLED_BLOCKS = 16


def value_blocks_bound(vb: Column, qvb: Column, n_blocks: int) -> Column:
    """Largest :func:`covered_bound` over the value blocks a query touches.

    ``vb`` holds the stored ``struct(mx, mn)`` per value block.  ``qvb`` is aligned with it
    and holds the query's ``struct(mx, mn, fmx, fmn)``: null for a block without queried
    points, ``fmx``/``fmn`` null for one that is only partly queried.  Null terms drop out
    of ``greatest``.
    """

    def terms(stored: Column, asked: Column) -> list[Column]:
        mx, mn = stored.getField("mx"), stored.getField("mn")
        return [
            asked.getField("mx") - mx,
            mn - asked.getField("mn"),
            mx - asked.getField("fmx"),
            asked.getField("fmn") - mn,
        ]

    zero = F.lit(0.0)
    if n_blocks <= MAX_UNROLLED_BLOCKS:
        flat = [t for i in range(n_blocks) for t in terms(F.get(vb, F.lit(i)), F.get(qvb, F.lit(i)))]
        return F.greatest(*flat, zero)
    return F.array_max(F.zip_with(vb, qvb, lambda s, a: F.greatest(*terms(s, a), zero)))
