"""Checks on a series table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_series(series: DataFrame) -> DataFrame:
    """Rows, length of the first row (smallest id), length range, value range."""
    return series.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by(F.size("v"), F.col("id")).alias("n_dims"),
        F.min(F.size("v")).alias("min_len"),
        F.max(F.size("v")).alias("max_len"),
        F.max(F.array_max("v")).alias("gmax"),
        F.min(F.array_min("v")).alias("gmin"),
    )


def length_violations(series: DataFrame, expected: int | None = None, strict: bool = False) -> DataFrame:
    """Series whose length differs from ``expected`` (default: that of the smallest id).

    ``strict=True`` raises on the first one when the frame is evaluated.
    """
    if expected is None:
        expected = series.agg(F.min_by(F.size("v"), F.col("id"))).first()[0] or 0
    bad = series.select("id", F.size("v").alias("n"), F.lit(expected).alias("expected")).filter(
        F.col("n") != F.col("expected")
    )
    if not strict:
        return bad
    message = F.format_string("series %s has %s values, expected %s", "id", "n", "expected")
    return bad.filter(F.raise_error(message).cast("boolean"))
