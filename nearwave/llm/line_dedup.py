"""Boilerplate lines by how many pages of their site hold them.

Lines are counted once per page and site.  A line is boilerplate of a site, and goes from its
pages, if the share of the site's pages that hold it surely exceeds ``max_ratio``: the count less ``CERTAINTY``
times its square root (the one-sided 95 % bound of a count) must do so.  Elsewhere the line stays.
It is one rule for sites of any size: few pages tell little about a share, so a line needs all of 3 pages, 4 of up to 14,
5 of up to 26, 35 of 500, and hardly more than the ratio of many.  A line on one or two pages never
goes: it cannot be told from a pair of near copies.  Everything is DataFrame functions.

Lines are identified by two independent 64-bit hashes, so the counting shuffle carries no
text.  A site with P pages of L lines on average has fewer than L / max_ratio boilerplate lines, however
large P is: they travel to the pages as one array per site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwave.llm.common import unused_names
from nearwave.workdir import new_folder

MAX_RATIO = 0.05
CERTAINTY = 1.645
#: White space at the ends of a line that does not make it another line.
LINE_BLANKS = " \t\v\f\r"


def _line_key(line: Column) -> Column:
    """128 bits of the line without surrounding blanks; null if nothing is left."""
    bare = F.btrim(line, F.lit(LINE_BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(
    docs: DataFrame, site: str = "source", max_ratio: float = MAX_RATIO, copies: bool = True
) -> DataFrame:
    """(site, h1, h2, pages) of each boilerplate line; without ``copies`` equal texts of a site are one page."""
    keys = F.array_distinct(F.transform(_lines(F.col("text")), _line_key)).alias("keys")
    if copies:
        pages = docs.select(F.col(site).alias("site"), keys)
    else:
        # The hashes stand for the texts, so that these are not shuffled.
        hashes = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
        pages = docs.select(F.col(site).alias("site"), *hashes, keys).dropDuplicates(["site", "t1", "t2"])
    totals = pages.groupBy("site").agg(F.count("*").alias("site_pages"))
    counts = (
        pages.select("site", F.explode("keys").alias("key"))
        .filter("key is not null")
        .groupBy("site", "key.h1", "key.h2")
        .agg(F.count("*").alias("pages"))
        .filter(F.col("pages") > 1)
    )
    return (
        counts.alias("c")
        .join(totals.alias("t"), F.expr("c.site <=> t.site"))
        .filter(F.col("pages") - F.lit(CERTAINTY) * F.sqrt("pages") > F.lit(float(max_ratio)) * F.col("site_pages"))
        .select("c.site", "h1", "h2", "pages")
    )


def without_boilerplate(
    docs: DataFrame, site: str = "source", max_ratio: float = MAX_RATIO, copies: bool = True
) -> DataFrame:
    """``docs`` with the remaining text in ``text``, and ``_n_dropped`` last: the lines that went.

    If ``docs`` has a column of that name, the new one has more underscores.

    Pages without a site form a site of their own.  A null text stays null and counts as a page
    without lines; an empty one stays empty.  Blank lines are never counted or dropped, a page
    whose lines all go keeps its row with an empty text.  Repeated rows are pages each, without ``copies`` equal
    texts of a site are one.  An empty table gives no rows.  All other columns stay as they are.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "boilerplate")
    own_site, boilerplate, left, n_dropped = unused_names(docs, "_site", "_boilerplate", "_kept", "_n_dropped")
    # Written, so that the planner knows its true size and broadcasts it only below Spark's limit.
    boilerplate_lines(docs, site, max_ratio, copies).groupBy("site").agg(
        F.collect_list(F.struct("h1", "h2")).alias(boilerplate)
    ).withColumnRenamed("site", own_site).write.parquet(folder)
    by_site = spark.read.parquet(folder)
    dropped = F.col(boilerplate).isNotNull() & F.col("text").isNotNull()
    marked = docs.join(by_site, F.col(f"`{site}`").eqNullSafe(F.col(own_site)), "left")
    kept = F.filter(
        _lines(F.col("text")),
        lambda line: ~F.coalesce(F.array_contains(F.col(boilerplate), _line_key(line)), F.lit(False)),
    )
    return (
        marked.withColumn(left, F.when(dropped, kept))
        .withColumn(n_dropped, F.coalesce(F.size(_lines(F.col("text"))) - F.size(left), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col(n_dropped) > 0, F.array_join(left, "\n")).otherwise(F.col("text")))
        .drop(own_site, boilerplate, left)
    )


def line_report(docs: DataFrame, site: str = "source", **options: float) -> DataFrame:
    """Per row of ``docs``: doc_id, the site, n_lines before, n_dropped, and the remaining text."""
    narrow = docs.select("doc_id", F.col(site).alias("source"), "text")
    return without_boilerplate(narrow, "source", **options).select(
        "doc_id",
        "source",
        (F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long")).alias("n_lines_left"),
        F.col("_n_dropped").alias("n_dropped"),
        "text",
    )


def without_site_boilerplate(docs: DataFrame, site: str = "source", **options: float) -> DataFrame:
    """``docs`` with boilerplate lines gone and ``n_chars`` (if there is one) counted anew."""
    names = docs.columns
    cleaned = without_boilerplate(docs, site, **options)
    if "n_chars" in names:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        n_dropped = cleaned.columns[-1]
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(n_dropped) > 0, n).otherwise(F.col("n_chars")))
    return cleaned.select(*[F.col(f"`{c}`") for c in names])
