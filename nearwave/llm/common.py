"""Helpers shared by the operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and \x09-\x0D, nothing beyond ASCII.
BLANKS = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_runs(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cuts rows of the given sizes into runs [i, j) of ``limit`` at most, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def per_process(name: str, make: Callable[[], object]) -> object:
    """The object ``make`` gives, made once in a Python worker and kept for its later tasks.

    Functions reach workers by value, so a module's own variables do not last from task to task.
    """
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def full_text(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has as columns already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
