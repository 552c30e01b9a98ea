"""Whole jobs from stored input to stored output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwave.operators.prepare import augment_dense, clean_series
from nearwave.operators.profile import profile_series
from nearwave.operators.sampling import envelope_sample, sample_fraction
from nearwave.sources.text import read_series_text, write_envelopes, write_series_text


def clean_text(spark: SparkSession, source: str, target: str, missing: float = 0.0, mode: str = "errorifexists") -> int:
    """Read series text, repair missing points, drop what cannot be repaired, write text.

    Lines that are no series are written to ``target`` + ``.rejects``; returns their number.
    """
    series, rejects = read_series_text(spark, source)
    write_series_text(clean_series(series, missing), target, mode)
    rejects.select("value").write.mode(mode).text(f"{target}.rejects")
    return spark.read.text(f"{target}.rejects").count()


def augment_text(
    series: DataFrame, prefix: str, size: int, dim: int, seed: int = 0, mode: str = "errorifexists"
) -> str:
    """Write the augmented series as text to ``prefix_rows_length`` and return that path.

    Rows and length follow from the input, so the output is computed and written once.
    """
    shape = profile_series(series.filter(F.size("v") > 0)).first()
    path = f"{prefix}_{shape.n_rows * (size + 1)}_{(shape.n_dims or 0) * (dim + 1)}"
    write_series_text(augment_dense(series, size, dim, seed), path, mode)
    return path


def sample_envelopes(
    series: DataFrame, path: str, sample_num: int, seed: int = 0, mode: str = "errorifexists", text: bool = False
) -> float:
    """Store the envelopes of about ``sample_num`` series; returns the sampled fraction."""
    fraction = sample_fraction(sample_num, series.count())
    write_envelopes(envelope_sample(series, fraction, seed), path, mode, text)
    return fraction
