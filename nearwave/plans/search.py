"""k-nearest-series search: by full scan, by id table, and by block index."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from itertools import chain
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwave.operators import ranges
from nearwave.operators.asked import measured, query_parts, store_parts, within_radius
from nearwave.operators.cells import with_radii
from nearwave.operators.many import StoredQueries, scan_many, store_queries
from nearwave.operators.radius import (
    collect_radius,
    estimated_radius,
    sample_radius,
    sample_rank,
)
from nearwave.operators.scan import Query, n_packs, query_packs, scan, scan_pairs
from nearwave.operators.topk import top_k
from nearwave.sources.tables import BlockIndex, UnstoredIndex, read_series_table
from nearwave.workdir import new_folder


def by_packs(search: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets ``search`` take its ``queries`` as a table: for comparisons, whose settings are per query on the driver.

    Larger tables come a pack at a time, and each pack is one run of the same plan.
    Answers of several packs are gathered in a table in the shared folder.
    """
    signature = inspect.signature(search)

    @functools.wraps(search)
    def run(*args, **options) -> DataFrame:
        call = signature.bind(*args, **options)
        queries = call.arguments["queries"]
        if isinstance(queries, list):
            return search(*args, **options)

        def answers(pack: list[Query]) -> DataFrame:
            call.arguments["queries"] = pack
            return search(*call.args, **call.kwargs)

        packs = query_packs(queries)
        first, second = next(packs, []), next(packs, None)
        if second is None:
            return answers(first)
        folder = new_folder(queries.sparkSession, "answers")
        for pack in chain([first, second], packs):
            answers(pack).write.mode("append").parquet(folder)
        return queries.sparkSession.read.parquet(folder)

    return run


def local_queries(queries: DataFrame | list[Query]) -> list[Query]:
    """All queries as objects on the driver, for sets the caller knows to be small."""
    return queries if isinstance(queries, list) else [q for pack in query_packs(queries) for q in pack]


def _few(queries: DataFrame | list[Query]) -> list[Query] | None:
    """The queries as objects if they are one pack at most, else None."""
    if isinstance(queries, list):
        return queries
    return local_queries(queries) if n_packs(queries) <= 1 else None


def knn_scan(
    series: DataFrame, queries: DataFrame | list[Query], k: int, exclude_self: bool = False
) -> DataFrame:
    """Brute force over every series; positions of the query are honoured, gaps included.

    One scan of the series for query tables of any size.
    """
    few = _few(queries)
    if few is None:
        asked = with_radii(series, store_queries(queries), k, exclude_self=exclude_self)
        return top_k(scan_many(series, asked, k, exclude_self=exclude_self), k, ways=1)
    return top_k(scan_pairs(scan(series, few, k, exclude_self=exclude_self)), k)


def knn_by_id_table(
    table: DataFrame, queries: DataFrame | list[Query], k: int, exclude_self: bool = False
) -> DataFrame:
    """Brute force over a stored id table; series and query must have one length."""
    few = _few(queries)
    if few is None:
        asked = with_radii(table, store_queries(queries), k, exclude_self=exclude_self)
        return top_k(scan_many(table, asked, k, full_length=True, exclude_self=exclude_self), k, ways=1)
    scanned = scan(table, few, k, full_length=True, exclude_self=exclude_self)
    return top_k(scan_pairs(scanned), k)


@by_packs
def knn_filtered_scan(
    series: DataFrame,
    queries: DataFrame | list[Query],
    k: int,
    radius: dict[int, float] | None,
) -> DataFrame:
    """Full scan of full-length queries that skips series by whole-series envelope.

    ``radius=None`` turns the filter off.  One pass: with an estimated radius the answer
    is what lies among the series kept.
    """
    scanned = scan(series, queries, k, bounds=radius, full_length=True)
    return top_k(scan_pairs(scanned), k)


def search_within(
    index: BlockIndex,
    queries: list[Query],
    radius: dict[int, float],
    block_filter: bool = True,
    prune_distance: bool = False,
    exclude_self: bool = False,
) -> DataFrame:
    """Complete candidates ``(qid, id, dist)`` of one pass at the given radii.

    ``prune_distance=True`` also drops blocks farther than the radius, so only series
    truly within it are regrouped and shuffled; right whenever the radius is not below
    the answer's.
    """
    rows = ranges.query_block_rows(queries, index, radius)
    return ranges.complete_candidates(ranges.near_blocks(index, rows, block_filter, prune_distance, exclude_self))


def knn_within_radius(
    index: BlockIndex,
    queries: DataFrame | list[Query],
    k: int,
    radius: float | dict[int, float],
    block_filter: bool = True,
) -> DataFrame:
    """One pass at a given radius: the k nearest among the complete candidates."""
    few = _few(queries)
    if few is None:
        return top_k(search_many(index, store_queries(queries), _given(index, radius), block_filter, False), k)
    radii = radius if isinstance(radius, dict) else {q.qid: float(radius) for q in few}
    return top_k(search_within(index, few, radii, block_filter), k)


def envelope_radius(
    index: BlockIndex, queries: list[Query], k: int, sample_num: int | None = None
) -> dict[int, float]:
    """Estimated radius from the index's own sample, at the rank that its size gives (or another one)."""
    rank = sample_rank(k, index.sample_num if sample_num is None else sample_num, index.n_series)
    return collect_radius(estimated_radius(index.envelopes, queries, rank))


def checked_radius(
    index: BlockIndex,
    queries: list[Query],
    k: int,
    radius: dict[int, float],
    block_filter: bool = True,
    exclude_self: bool = False,
) -> dict[int, float]:
    """Replace radii that a first pass shows to be too small.

    With at least k candidates the k-th distance among them is a safe radius; with fewer
    nothing is known and the radius becomes infinite.
    """
    first = search_within(index, queries, radius, block_filter, exclude_self=exclude_self)
    kth = {r.qid: r.dist for r in top_k(first, k).filter(F.col("rn") == k).collect()}
    out = {}
    for q in queries:
        reached = kth.get(q.qid, inf)
        out[q.qid] = radius[q.qid] if reached <= radius[q.qid] else reached
    return out


def _given(index: BlockIndex, radius: float | dict[int, float]) -> Column | DataFrame:
    if isinstance(radius, dict):
        return index.spark.createDataFrame([(q, float(r)) for q, r in radius.items()], "qid BIGINT, radius DOUBLE")
    return F.lit(float(radius))


def _with_radius(index: BlockIndex, asked: StoredQueries, radius: Column | DataFrame) -> DataFrame:
    """The stored queries with their radius, infinite where none is given."""
    queries = asked.table(index.blocks)
    if isinstance(radius, Column):
        return queries.withColumn("radius", radius)
    return queries.join(radius, "qid", "left").withColumn("radius", F.coalesce("radius", F.lit(inf)))


def search_many(
    index: BlockIndex,
    asked: StoredQueries,
    radius: Column | DataFrame,
    block_filter: bool = True,
    prune: bool = True,
    exclude_self: bool = False,
) -> DataFrame:
    """:func:`search_within` for stored queries; ``radius`` is a column or a table ``(qid, radius)``."""
    parts = store_parts(query_parts(_with_radius(index, asked, radius), index.t_len), index)
    return ranges.complete_candidates(measured(index, parts, within_radius(block_filter, prune, exclude_self)))


def knn_index(
    index: BlockIndex,
    queries: DataFrame | list[Query],
    k: int,
    block_filter: bool = True,
    radius: str | dict[int, float] = "sample",
    sample_num: int | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """Exact search through a block index.

    ``radius="sample"`` takes true distances to the index's sample: always large enough,
    so one pass is exact.  ``radius="estimate"`` takes the envelope estimate, checks it
    with a first pass, and searches with what the check leaves.  Given radii are taken as they are.
    Query tables beyond a pack need neither: see the comment.
    """
    if isinstance(radius, str) and radius not in ("sample", "estimate"):
        raise ValueError(f"unknown radius {radius!r}")
    few = _few(queries)
    if few is None:
        asked = store_queries(queries)
        if isinstance(radius, str):
            # A time block alone lets too many pairs through: queries meet the series whole, put together
            # from the time blocks they touch, and no pair leaves a task that is not among its k nearest.
            first = asked.first // index.t_len
            folder = new_folder(index.spark, "series")
            index.series(first, asked.last // index.t_len).write.parquet(folder)
            series, start = read_series_table(index.spark, folder), first * index.t_len
            asked = with_radii(series, asked, k, start, exclude_self)
            return top_k(scan_many(series, asked, k, start=start, exclude_self=exclude_self), k, ways=1)
        return top_k(search_many(index, asked, _given(index, radius), block_filter, True, exclude_self), k)
    if isinstance(radius, dict):
        radii = radius
    elif radius == "sample":
        radii = sample_radius(index.sample, few, k, exclude_self)
    else:
        guess = envelope_radius(index, few, k, sample_num)
        guess = {q.qid: guess.get(q.qid, inf) for q in few}
        radii = checked_radius(index, few, k, guess, block_filter, exclude_self)
    return top_k(search_within(index, few, radii, block_filter, True, exclude_self), k)


# Share of a sample left by the index's filters above which a full scan is cheaper.
SCAN_ABOVE_SHARE = 0.5


def candidate_share(index: BlockIndex, queries: list[Query], radius: dict[int, float]) -> float:
    """Mean share of the index's sample that its filters would let through."""
    n = index.sample.count()
    if not n or not queries:
        return 1.0
    trial = UnstoredIndex(index.sample, index.t_len, index.v_len, index.uniform_len)
    rows = ranges.query_block_rows(queries, trial, radius)
    kept = ranges.candidate_counts(trial, rows).agg(F.sum("n_filtered")).first()[0] or 0
    return kept / (n * len(queries))


def knn(
    queries: DataFrame | list[Query],
    k: int,
    method: str,
    *,
    series: DataFrame | None = None,
    index: BlockIndex | None = None,
    **options,
) -> DataFrame:
    """One entry point: ``method`` is ``scan``, ``id_table``, ``index`` or ``auto``.

    ``auto`` searches through the index unless its sample says that it would let most
    series through, and then scans.  Both ways are exact.  Options of the index search
    (``block_filter``, ``radius``, ``sample_num``) are fine with ``auto`` whichever way it takes.
    """
    if method == "auto":
        exclude_self = options.get("exclude_self", False)
        few = _few(queries)
        # Of a large table one pack, chosen by a hash of the ids, speaks for all.
        some = next(query_packs(queries), []) if few is None else few
        radii = sample_radius(index.sample, some, k, exclude_self)
        if candidate_share(index, some, radii) > SCAN_ABOVE_SHARE:
            return knn_scan(series, queries if few is None else few, k, exclude_self=exclude_self)
        if few is None:
            return knn_index(index, queries, k, **options)
        return knn_index(index, few, k, **{"radius": radii} | options)
    if method == "scan":
        return knn_scan(series, queries, k, **options)
    if method == "id_table":
        return knn_by_id_table(series, queries, k, **options)
    if method == "index":
        return knn_index(index, queries, k, **options)
    raise ValueError(f"unknown method {method!r}")
