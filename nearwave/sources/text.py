"""Text forms of series, query points and envelopes.

* series:    ``id <tab> v1,v2,...``
* query:     ``pos,v#pos,v`` (separators can be changed)
* envelope:  ``max min``
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed format values.
ID_SEPARATOR = "\t"
VALUE_SEPARATOR = ","
POINT_SEPARATOR = "#"
POINT_VALUE_SEPARATOR = ","
ENVELOPE_SEPARATOR = " "

ENVELOPE_SCHEMA = "smax DOUBLE, smin DOUBLE"


def _try_doubles(text: Column) -> Column:
    return F.split(text, VALUE_SEPARATOR, -1).try_cast("array<double>")


def _usable(values: Column) -> Column:
    """No value failed to parse, all are finite, and there is at least one."""
    infinite = F.exists(values, lambda x: F.abs(x) == float("inf"))
    return (
        (F.size(values) > 0)
        & (F.size(F.array_compact(values)) == F.size(values))
        & ~F.isnan(F.array_max(values))
        & ~infinite
    )


def parse_series(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Text lines to ``(series(id, v, ord), rejects(value, ord))``.

    ``ord`` orders the lines, so that a later one can replace an earlier one with the same id
    (``sources.tables.last_per_id``).  It is a column of ``lines``, or else their number in
    the order of the input's partitions.
    """
    order = F.col("ord") if "ord" in lines.columns else F.monotonically_increasing_id()
    head = F.split(F.col(column), ID_SEPARATOR, 2)
    parsed = lines.select(
        F.col(column).alias("value"),
        F.get(head, F.lit(0)).try_cast("bigint").alias("id"),
        _try_doubles(F.get(head, F.lit(1))).alias("v"),
        order.alias("ord"),
    )
    good = F.coalesce(F.col("id").isNotNull() & _usable(F.col("v")), F.lit(False))
    return (
        parsed.filter(good).select("id", "v", "ord"),
        parsed.filter(~good).select("value", "ord"),
    )


def read_series_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Series and rejects of text files; lines count by file path, then by their place in the file."""
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),  # ascends within a block
        ).alias("ord"),
    )
    return parse_series(lines)


def format_series(series: DataFrame) -> DataFrame:
    return series.select(
        F.concat_ws(
            ID_SEPARATOR,
            F.col("id").cast("string"),
            F.array_join(F.col("v").cast("array<string>"), VALUE_SEPARATOR),
        ).alias("value")
    )


def write_series_text(series: DataFrame, path: str, mode: str = "errorifexists") -> None:
    format_series(series).write.mode(mode).text(path)


def parse_query_points(
    texts: DataFrame,
    column: str = "points",
    sep: str = POINT_SEPARATOR,
    value_sep: str = POINT_VALUE_SEPARATOR,
) -> tuple[DataFrame, DataFrame]:
    """A table ``(qid, points)`` of query strings to ``(queries(qid, pos, q), rejects(qid, points))``.

    Rejected are strings with a point that is not a position from 0 on and a finite value.
    """
    # ``split`` takes patterns; separators are meant as they stand.
    point, value = re.escape(sep), re.escape(value_sep)
    pairs = F.transform(F.split(F.col(column), point, -1), lambda t: F.split(t, value, 2))
    parsed = texts.select("qid", F.col(column).alias("points"), pairs.alias("pairs")).select(
        "qid",
        "points",
        F.transform("pairs", lambda p: F.get(p, F.lit(0)).try_cast("int")).alias("pos"),
        F.transform("pairs", lambda p: F.get(p, F.lit(1)).try_cast("double")).alias("q"),
    )
    placed = (F.size(F.array_compact("pos")) == F.size("pos")) & (F.array_min("pos") >= 0)
    good = F.coalesce(placed & _usable(F.col("q")), F.lit(False))
    return parsed.filter(good).select("qid", "pos", "q"), parsed.filter(~good).select("qid", "points")


def format_query_points(
    queries: DataFrame, sep: str = POINT_SEPARATOR, value_sep: str = POINT_VALUE_SEPARATOR
) -> DataFrame:
    """Packed queries back to ``(qid, points)`` strings."""
    return queries.select(
        "qid",
        F.array_join(
            F.zip_with(
                "pos",
                "q",
                lambda p, x: F.concat(p.cast("string"), F.lit(value_sep), x.cast("string")),
            ),
            sep,
        ).alias("points"),
    )


def write_envelopes(envelopes: DataFrame, path: str, mode: str = "errorifexists", text: bool = False) -> None:
    """Parquet by default; ``text=True`` writes ``max min`` lines (ids are not kept)."""
    if text:
        envelopes.select("smax", "smin").write.mode(mode).csv(path, sep=ENVELOPE_SEPARATOR)
    else:
        envelopes.write.mode(mode).parquet(path)


def read_envelopes_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=ENVELOPE_SEPARATOR, schema=ENVELOPE_SCHEMA)
