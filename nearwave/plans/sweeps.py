"""Comparisons over one varied setting: answers and pruning counts as tables.

All settings of a comparison share one pass where they can: a query under each setting is
one more query of the same job.
"""

from __future__ import annotations

from functools import reduce
from math import inf

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwave.operators import ranges
from nearwave.operators.pruning import Trial, pruning_counts
from nearwave.operators.radius import (
    collect_radius,
    estimated_radius,
    sample_rank,
)
from nearwave.operators.sampling import bernoulli_sample, envelope_sample, sample_fraction
from nearwave.operators.scan import Query, scan, scan_counts, scan_pairs
from nearwave.operators.topk import top_k
from nearwave.plans.search import by_packs, knn_index, knn_scan
from nearwave.sources.tables import BlockIndex, UnstoredIndex
from nearwave.workdir import new_folder


class _Labelled:
    """Queries renumbered so that each (setting, query) has its own id."""

    def __init__(self, schema: str):
        self.schema = schema
        self.queries: list[Query] = []
        self.labels: list[tuple] = []

    def add(self, label: tuple, pos, q) -> int:
        key = len(self.labels)
        self.labels.append((key, *label))
        self.queries.append(Query(key, pos, q))
        return key

    def restore(self, result: DataFrame) -> DataFrame:
        """Replace the own ids of a result by their labels."""
        spark = result.sparkSession
        names = [c.split()[0] for c in self.schema.split(", ")]
        labels = spark.createDataFrame(self.labels, f"_key BIGINT, {self.schema}")
        kept = [c for c in result.columns if c != "qid"]
        joined = F.broadcast(labels).join(result.withColumnRenamed("qid", "_key"), "_key", "left")
        return joined.select(*names, *kept)


@by_packs
def compare_methods(series: DataFrame, index: BlockIndex, queries: DataFrame | list[Query], k: int) -> DataFrame:
    """Answers of scan, index and index without block filter side by side, per rank."""
    answers = {
        "scan": knn_scan(series, queries, k),
        "index": knn_index(index, queries, k),
        "plain": knn_index(index, queries, k, block_filter=False),
    }
    renamed = [
        a.select("qid", "rn", F.col("id").alias(f"{name}_id"), F.col("dist").alias(f"{name}_dist"))
        for name, a in answers.items()
    ]
    side_by_side = reduce(lambda a, b: a.join(b, ["qid", "rn"], "full"), renamed)
    agree = reduce(
        lambda a, b: a & b,
        [
            F.col(f"scan_{part}").eqNullSafe(F.col(f"{name}_{part}"))
            for name in ("index", "plain")
            for part in ("id", "dist")
        ],
    )
    return side_by_side.withColumn("agree", agree)


def recall(compared: DataFrame) -> DataFrame:
    """Per query: ranks compared, ranks that agree, and the share that does."""
    agreed = F.sum(F.col("agree").cast("bigint"))
    return compared.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_ranks"),
        agreed.alias("n_agree"),
        (agreed / F.count(F.lit(1))).alias("recall"),
    )


@by_packs
def knn_multi_k(index: BlockIndex, queries: DataFrame | list[Query], ks: list[int], **options) -> DataFrame:
    """``(k, qid, rn, id, dist)`` for several k from one search at the largest."""
    answers = knn_index(index, queries, max(ks), **options)
    return (
        answers.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
        .filter(F.col("rn") <= F.col("k"))
        .select("k", "qid", "rn", "id", "dist")
    )


class _Counts:
    """Settings of a count and their labels, for one scan of the series."""

    def __init__(self, schema: str):
        self.schema = schema
        self.labels: list[tuple] = []
        self.trials: list[Trial] = []

    def add(self, query: Query, index: BlockIndex | UnstoredIndex, radii: list[tuple[tuple, float]]) -> None:
        """``radii``: labels, and the radius of each."""
        rows = ranges.query_block_rows([query], index, {query.qid: inf})
        first = len(self.labels)
        self.labels += [(first + i, *label) for i, (label, _) in enumerate(radii)]
        keyed = [(first + i, float(r)) for i, (_, r) in enumerate(radii)]
        self.trials.append(Trial(index.t_len, index.v_len, rows, keyed))

    def over(self, series: DataFrame) -> DataFrame:
        names = [c.split()[0] for c in self.schema.split(", ")]
        labels = series.sparkSession.createDataFrame(self.labels, f"key BIGINT, {self.schema}")
        counts = pruning_counts(series, self.trials)
        return F.broadcast(labels).join(counts, "key", "left").select(*names, "n_range", "n_filtered").na.fill(0, ["n_range", "n_filtered"])


@by_packs
def pruning_by_k(
    index: BlockIndex, queries: DataFrame | list[Query], ks: list[int], series: DataFrame | None = None
) -> DataFrame:
    """``(k, qid, radius, n_range, n_filtered)``: series left without and with block filter.

    Without ``series`` they are put together from the index's blocks, which shuffles these.
    """
    nearest = top_k(scan_pairs(scan(index.sample, queries, max(ks))), max(ks))
    dist = {(r.qid, r.rn): r.dist for r in nearest.filter(F.col("rn").isin(ks)).collect()}
    counts = _Counts("k INT, qid BIGINT, radius DOUBLE")
    for q in queries:
        radii = {k: dist.get((q.qid, k), inf) for k in ks}
        counts.add(q, index, [((k, q.qid, r), r) for k, r in radii.items()])
    return counts.over(series if series is not None else index.series(0, max(int(q.pos.max()) for q in queries) // index.t_len))


@by_packs
def knn_multi_prefix(
    index: BlockIndex, queries: DataFrame | list[Query], dims: list[int], k: int, **options
) -> DataFrame:
    """``(dim, qid, rn, id, dist)`` for each query cut to its first ``dim`` points."""
    each = _Labelled("dim INT, qid BIGINT")
    for q in queries:
        for dim in dims:
            each.add((dim, q.qid), q.pos[:dim], q.q[:dim])
    return each.restore(knn_index(index, each.queries, k, **options)).filter("rn IS NOT NULL")


@by_packs
def radius_by_sample_size(
    series: DataFrame,
    index: BlockIndex,
    queries: DataFrame | list[Query],
    k: int,
    sample_nums: list[int],
    seed: int = 0,
) -> DataFrame:
    """``(sample_num, qid, radius, n_range, n_filtered)`` for envelope samples of several sizes."""
    total = index.n_series
    # Samples of one seed are nested: the largest holds them all and is taken once.
    folder = new_folder(series.sparkSession, "envelopes")
    envelope_sample(series, sample_fraction(max(sample_nums), total), seed).write.parquet(folder)
    largest = series.sparkSession.read.parquet(folder)
    radii: dict[int, list[tuple[tuple, float]]] = {q.qid: [] for q in queries}
    for n in sample_nums:
        sample = bernoulli_sample(largest, sample_fraction(n, total), seed)
        estimate = collect_radius(estimated_radius(sample, queries, sample_rank(k, n, total)))
        for q in queries:
            r = estimate.get(q.qid, inf)
            radii[q.qid].append(((n, q.qid, r), r))
    counts = _Counts("sample_num INT, qid BIGINT, radius DOUBLE")
    for q in queries:
        counts.add(q, index, radii[q.qid])
    return counts.over(series)


@by_packs
def pruning_by_block_lengths(
    series: DataFrame,
    queries: DataFrame | list[Query],
    radius: dict[int, float],
    lengths: list[tuple[int, int]],
    uniform_len: int | None,
) -> DataFrame:
    """``(t_len, v_len, qid, n_range, n_filtered)`` for several block lengths at given radii."""
    counts = _Counts("t_len INT, v_len INT, qid BIGINT")
    for t_len, v_len in lengths:
        trial = UnstoredIndex(series, t_len, v_len, uniform_len)
        for q in queries:
            counts.add(q, trial, [((t_len, v_len, q.qid), radius[q.qid])])
    return counts.over(series)


@by_packs
def pruning_on_off(
    series: DataFrame, queries: DataFrame | list[Query], k: int, radius: dict[int, float]
) -> DataFrame:
    """``(qid, n_total, n_kept, same_answer)`` of a full scan with and without envelope filter."""
    runs = {
        "kept": scan(series, queries, k, bounds=radius, full_length=True),
        "total": scan(series, queries, k, full_length=True),
    }
    counts = reduce(
        lambda a, b: a.join(b, "qid"),
        [scan_counts(r).withColumnRenamed("n_kept", f"n_{name}") for name, r in runs.items()],
    )
    kept, total = (
        top_k(scan_pairs(runs[name]), k).withColumnRenamed("dist", f"{name}_dist") for name in ("kept", "total")
    )
    same = (
        total.join(kept, ["qid", "rn", "id"], "full")
        .groupBy("qid")
        .agg(F.bool_and(F.col("kept_dist").eqNullSafe(F.col("total_dist"))).alias("same_answer"))
    )
    return counts.join(same, "qid").select("qid", "n_total", "n_kept", "same_answer")
