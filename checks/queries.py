"""The registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import parameters as P
from nearwave import fixtures
from nearwave.functions.distance import (
    block_lower_bound,
    block_upper_bound,
    chebyshev,
    multi_block_lower_bound,
)
from nearwave.operators import blocks, prepare, profile, ranges, sampling
from nearwave.operators.radius import estimated_radius, sample_radius, sample_rank
from nearwave.operators.topk import answer_radius
from nearwave.plans import jobs, search, sweeps
from nearwave.plans.join import knn_join as join_all
from nearwave.sources import tables, text
from nearwave.sources.store import SeriesStore
from nearwave.workdir import new_folder

_indexes: dict[tuple, tables.BlockIndex] = {}


_series: dict[tuple, str] = {}


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer series as a stored id table, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _series:
        path = new_folder(spark, "spend-by-id")
        tables.write_series_table(fixtures.cumulative_spend(spark, sf_dir), path, order=None)
        _series[key] = path
    return tables.read_series_table(spark, _series[key])


def spend_index(spark: SparkSession, sf_dir: str) -> tables.BlockIndex:
    """Block index over the customer series, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, "spend")
    if key not in _indexes:
        _indexes[key] = tables.write_block_index(
            spend(spark, sf_dir),
            new_folder(spark, "spend"),
            P.SPEND_T,
            P.SPEND_V,
            P.SAMPLE_NUM,
            P.SAMPLE_SEED,
        )
    return _indexes[key]


def vector_index(spark: SparkSession, sf_dir: str) -> tables.BlockIndex:
    key = (spark.sparkContext.applicationId, sf_dir, "vectors")
    if key not in _indexes:
        _indexes[key] = tables.write_block_index(
            fixtures.vectors(spark, sf_dir),
            new_folder(spark, "vectors"),
            P.VECTOR_T,
            P.VECTOR_V,
            P.SAMPLE_NUM,
            P.SAMPLE_SEED,
        )
    return _indexes[key]


def _sampled(series: DataFrame) -> DataFrame:
    return sampling.sample_queries(series, P.N_QUERIES, P.QUERY_SEED)


def _spend_queries(spark: SparkSession, sf_dir: str) -> list:
    return search.local_queries(_sampled(spend(spark, sf_dir)))


def _offset_queries(spark: SparkSession, sf_dir: str) -> list:
    sampled = _sampled(spend(spark, sf_dir))
    return search.local_queries(blocks.slice_queries(sampled, P.OFFSET_FIRST, P.OFFSET_LAST))


def _growth_points(queries: DataFrame) -> DataFrame:
    """Only the positions at which a running value grew: queries with gaps."""
    grew = F.filter("pos", lambda p: F.get("q", p) > F.coalesce(F.get("q", p - 1), F.lit(0.0)))
    return queries.select("qid", grew.alias("pos"), "q").select(
        "qid", "pos", F.transform("pos", lambda p: F.get("q", p)).alias("q")
    )


def _next_to(series: DataFrame) -> DataFrame:
    """Each series beside the one with the next id: ``(a, b, va, vb)``."""
    left = series.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.col("v").alias("va"))
    right = series.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    return left.join(right, "b").select("a", "b", "va", "vb")


def _next_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _next_to(spend(spark, sf_dir))
    return pairs.select(
        "a",
        "b",
        *[
            f(c).alias(f"{c}_{name}")
            for c in ("va", "vb")
            for name, f in (("max", F.array_max), ("min", F.array_min))
        ],
    )


# Sources and sinks


def series_text_roundtrip(spark, sf_dir):
    path = new_folder(spark, "text")
    text.write_series_text(spend(spark, sf_dir), path)
    series, _ = text.read_series_text(spark, path)
    return blocks.points(series)


def query_points(spark, sf_dir):
    queries = _growth_points(blocks.as_queries(spend(spark, sf_dir)))
    parsed, _ = text.parse_query_points(text.format_query_points(queries))
    return blocks.query_points(parsed)


def damaged_text(spark, sf_dir):
    """Series text in which one line in seven is damaged, parsed: good points and rejected lines alike."""
    path = new_folder(spark, "damaged")
    lines = text.format_series(spend(spark, sf_dir)).select(
        F.split("value", "\t")[0].cast("bigint").alias("id"), "value"
    )
    kind = F.col("id") % 7
    damaged = (
        F.when(kind == 0, F.concat("value", F.lit(",x")))
        .when(kind == 1, F.concat("value", F.lit(",Infinity")))
        .when(kind == 2, F.concat(F.lit("n"), "value"))
        .otherwise(F.col("value"))
    )
    lines.select(damaged.alias("value")).write.text(path)
    series, rejects = text.read_series_text(spark, path)
    good = blocks.points(series).select("id", "pos", "v", F.lit(True).alias("good"))
    bad = rejects.select(
        F.regexp_extract("value", "[0-9]+", 0).cast("bigint").alias("id"),
        F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("double").alias("v"),
        F.lit(False).alias("good"),
    )
    return good.unionByName(bad)


def envelope_text_roundtrip(spark, sf_dir):
    path = new_folder(spark, "envelopes-text")
    jobs.sample_envelopes(spend(spark, sf_dir), path, P.SAMPLE_NUM, P.SAMPLE_SEED, text=True)
    return text.read_envelopes_text(spark, path)


def clean_text_job(spark, sf_dir):
    folder = new_folder(spark, "clean-job")
    text.write_series_text(fixtures.daily_values(spark, sf_dir, P.OBSERVED_ABOVE), f"{folder}/in")
    jobs.clean_text(spark, f"{folder}/in", f"{folder}/out")
    cleaned, _ = text.read_series_text(spark, f"{folder}/out")
    return blocks.points(cleaned)


def augment_text_job(spark, sf_dir):
    prefix = f"{new_folder(spark, 'augment-job')}/spend"
    path = jobs.augment_text(spend(spark, sf_dir), prefix, P.AUGMENT_SIZE, 0, P.NOISE_SEED)
    grown, _ = text.read_series_text(spark, path)
    return blocks.points(grown)


def series_by_id(spark, sf_dir):
    older = fixtures.cumulative_orders(spark, sf_dir).withColumn("ord", F.lit(1))
    newer = fixtures.cumulative_spend(spark, sf_dir).withColumn("ord", F.lit(2))
    path = new_folder(spark, "series")
    tables.write_series_table(older.unionByName(newer), path)
    return blocks.points(tables.read_series_table(spark, path))


def block_index(spark, sf_dir):
    stored = spend_index(spark, sf_dir).blocks
    return stored.select("tb", "tmax", "tmin", "id", "n", F.size("vb").alias("n_vb"))


def block_contents(spark, sf_dir):
    """Stored values and value-block envelopes of the index, one row each."""
    stored = spend_index(spark, sf_dir).blocks
    values = stored.select("id", "tb", F.posexplode("seg").alias("at", "hi"))
    values = values.select("id", "tb", F.lit("value").alias("kind"), "at", "hi", F.col("hi").alias("lo"))
    envelopes = stored.select("id", "tb", F.posexplode("vb").alias("at", "e"))
    return values.unionAll(envelopes.select("id", "tb", F.lit("envelope"), "at", "e.mx", "e.mn"))


def _store_after_writes(spark, sf_dir) -> SeriesStore:
    """The customer series after a second write (changed, shortened and new ids) and a removal."""
    first, orders = spend(spark, sf_dir), fixtures.cumulative_orders(spark, sf_dir)
    changed = orders.filter("id % 5 = 0 AND id % 7 <> 0").select("id", F.col("v").cast("array<double>").alias("v"))
    shorter = first.filter("id % 7 = 0").select("id", F.slice("v", 1, P.SHORTER).alias("v"))
    added = first.filter("id % 11 = 0").select(
        (F.col("id") + P.NEW_IDS).alias("id"), F.transform("v", lambda x: x + 100).alias("v")
    )
    store = SeriesStore.create(
        spark, new_folder(spark, "store"), P.SPEND_T, P.SPEND_V, P.SAMPLE_NUM, P.SAMPLE_SEED
    ).put(first)
    return store.put(changed.unionAll(shorter).unionAll(added)).remove(first.filter("id % 13 = 0").select("id"))


def replaced_series(spark, sf_dir):
    return blocks.points(_store_after_writes(spark, sf_dir).series())


def knn_replaced(spark, sf_dir):
    """Index search of a store after writes that replace, shorten, add and remove series."""
    return search.knn_index(_store_after_writes(spark, sf_dir), _spend_queries(spark, sf_dir), P.K)


# Blocks and bounds


def time_blocks(spark, sf_dir):
    cut = blocks.time_blocks(spend(spark, sf_dir), P.SPEND_T, P.SPEND_V)
    return cut.select("id", "tb", "tmax", "tmin", "n")


def value_blocks(spark, sf_dir):
    return blocks.value_blocks(blocks.time_blocks(fixtures.vectors(spark, sf_dir), P.VECTOR_T, P.VECTOR_V))


def series_envelope(spark, sf_dir):
    return blocks.series_envelope(fixtures.vectors(spark, sf_dir))


def query_blocks(spark, sf_dir):
    queries = _growth_points(blocks.as_queries(spend(spark, sf_dir)))
    return blocks.query_blocks(queries, P.SPEND_T, P.SPEND_V)


def chebyshev_pairs(spark, sf_dir):
    return _next_to(fixtures.vectors(spark, sf_dir)).select(
        "a", "b", chebyshev(F.col("va"), F.col("vb")).alias("dist")
    )


def block_lower_bounds(spark, sf_dir):
    bound = block_lower_bound(*map(F.col, ("va_max", "va_min", "vb_max", "vb_min")))
    return _next_envelopes(spark, sf_dir).select("a", "b", bound.alias("lb"))


def multi_block_lower_bounds(spark, sf_dir):
    pairs = _next_to(spend(spark, sf_dir))
    cut = [blocks.value_envelopes(F.col(c), P.SPEND_V) for c in ("va", "vb")]
    return pairs.select("a", "b", multi_block_lower_bound(*cut).alias("lb"))


def block_upper_bounds(spark, sf_dir):
    bound = block_upper_bound(*map(F.col, ("va_max", "va_min", "vb_max", "vb_min")))
    return _next_envelopes(spark, sf_dir).select("a", "b", bound.alias("ub"))


# Checks and samples


def profile_series(spark, sf_dir):
    return profile.profile_series(spend(spark, sf_dir))


def length_violations(spark, sf_dir):
    return profile.length_violations(fixtures.spend_since_first_order(spark, sf_dir))


def envelope_sample(spark, sf_dir):
    series = spend(spark, sf_dir)
    fraction = sampling.sample_fraction(P.SAMPLE_NUM, series.count())
    return sampling.envelope_sample(series, fraction, P.SAMPLE_SEED)


def sample_queries(spark, sf_dir):
    return blocks.query_points(_sampled(spend(spark, sf_dir)))


# Search


def knn_brute_force(spark, sf_dir):
    vectors = fixtures.vectors(spark, sf_dir)
    return search.knn(_sampled(vectors), P.K, "scan", series=vectors)


def knn_by_id_table(spark, sf_dir):
    path = new_folder(spark, "vectors-by-id")
    tables.write_series_table(fixtures.vectors(spark, sf_dir), path, order=None)
    stored = tables.read_series_table(spark, path)
    return search.knn(_sampled(stored), P.K, "id_table", series=stored)


def knn_auto(spark, sf_dir):
    vectors = fixtures.vectors(spark, sf_dir)
    return search.knn(_sampled(vectors), P.K, "auto", series=vectors, index=vector_index(spark, sf_dir))


def knn_index(spark, sf_dir):
    return search.knn(_spend_queries(spark, sf_dir), P.K, "index", index=spend_index(spark, sf_dir))


def knn_index_no_block_filter(spark, sf_dir):
    return search.knn_index(spend_index(spark, sf_dir), _spend_queries(spark, sf_dir), P.K, block_filter=False)


def knn_index_estimated_radius(spark, sf_dir):
    return search.knn_index(
        spend_index(spark, sf_dir),
        _spend_queries(spark, sf_dir),
        P.K,
        radius="estimate",
    )


def knn_index_vectors(spark, sf_dir):
    return search.knn_index(
        vector_index(spark, sf_dir), _sampled(fixtures.vectors(spark, sf_dir)), P.K, exclude_self=True
    )


def knn_sparse_positions(spark, sf_dir):
    queries = _growth_points(_sampled(spend(spark, sf_dir)))
    return search.knn_index(spend_index(spark, sf_dir), queries, P.K)


def knn_within_radius(spark, sf_dir):
    index, queries = spend_index(spark, sf_dir), _spend_queries(spark, sf_dir)
    radius = search.envelope_radius(index, queries, P.K)
    return search.knn_within_radius(index, queries, P.K, radius)


def knn_join(spark, sf_dir):
    series = spend(spark, sf_dir)
    return join_all(series, blocks.as_queries(series), P.K, spend_index(spark, sf_dir))


def knn_scan_many(spark, sf_dir):
    """Every series as a query of the full scan."""
    series = spend(spark, sf_dir)
    return search.knn_scan(series, blocks.as_queries(series), P.K)


def knn_index_many(spark, sf_dir):
    """Every series as a query of the index search."""
    return search.knn_index(spend_index(spark, sf_dir), blocks.as_queries(spend(spark, sf_dir)), P.K)


def knn_filtered_scan(spark, sf_dir):
    index, queries = spend_index(spark, sf_dir), _spend_queries(spark, sf_dir)
    radius = search.envelope_radius(index, queries, P.K)
    return search.knn_filtered_scan(spend(spark, sf_dir), queries, P.K, radius)


def knn_unfiltered_scan(spark, sf_dir):
    queries = _spend_queries(spark, sf_dir)
    return search.knn_filtered_scan(spend(spark, sf_dir), queries, P.K, None)


def knn_radius(spark, sf_dir):
    return answer_radius(knn_brute_force(spark, sf_dir))


def estimate_radius(spark, sf_dir):
    index = spend_index(spark, sf_dir)
    rank = sample_rank(P.K, P.SAMPLE_NUM, index.n_series)
    return estimated_radius(index.envelopes, _spend_queries(spark, sf_dir), rank)


# Stages of an index search


def _rows(index, queries, radius=None):
    radius = radius or sample_radius(index.sample, queries, P.K)
    return ranges.query_block_rows(queries, index, radius)


def index_range_scan(spark, sf_dir):
    index, queries = spend_index(spark, sf_dir), _spend_queries(spark, sf_dir)
    radius = search.envelope_radius(index, queries, P.K)
    found = ranges.block_candidates(index, _rows(index, queries, radius), per_block=False)
    return found.select("qid", "tb", "id", "tmax", "tmin")


def index_range_join(spark, sf_dir):
    index = spend_index(spark, sf_dir)
    found = ranges.block_candidates(index, _rows(index, _offset_queries(spark, sf_dir)))
    return found.select("qid", "tb", "id", "tmax", "tmin")


def block_filter(spark, sf_dir):
    index = spend_index(spark, sf_dir)
    rows = _rows(index, _offset_queries(spark, sf_dir))
    found = ranges.block_candidates(index, rows, block_filter=True)
    return found.select("qid", "tb", "id", ranges.block_bound(index).alias("lb"))


def complete_candidates(spark, sf_dir):
    index, queries = spend_index(spark, sf_dir), _offset_queries(spark, sf_dir)
    return search.search_within(index, queries, sample_radius(index.sample, queries, P.K))


# Preparation


def interpolate_missing(spark, sf_dir):
    filled = prepare.interpolate_missing(fixtures.daily_values(spark, sf_dir))
    return filled.select("id", F.posexplode("v").alias("pos", "v"), "n_observed")


def clean_series(spark, sf_dir):
    return blocks.points(prepare.clean_series(fixtures.daily_values(spark, sf_dir, P.OBSERVED_ABOVE)))


def jitter_series(spark, sf_dir):
    series = spend(spark, sf_dir)
    return blocks.points(prepare.jitter_series(series, P.JITTER_RATE, P.NOISE_SEED))


def augment_rows(spark, sf_dir):
    series = spend(spark, sf_dir)
    return blocks.points(prepare.augment_dense(series, P.AUGMENT_SIZE, 0, P.NOISE_SEED))


def augment_length(spark, sf_dir):
    series = spend(spark, sf_dir)
    return blocks.points(prepare.augment(series, 0, P.AUGMENT_DIM, P.NOISE_SEED).select("id", "v"))


def augment_profile(spark, sf_dir):
    series = spend(spark, sf_dir)
    grown = prepare.augment_dense(series, P.AUGMENT_SIZE, P.AUGMENT_DIM, P.NOISE_SEED)
    return prepare.augment_profile(grown, "spend")


# Comparisons


def compare_methods(spark, sf_dir):
    return sweeps.compare_methods(
        spend(spark, sf_dir),
        spend_index(spark, sf_dir),
        _spend_queries(spark, sf_dir),
        P.K,
    )


def method_recall(spark, sf_dir):
    return sweeps.recall(compare_methods(spark, sf_dir))


def knn_multi_k(spark, sf_dir):
    return sweeps.knn_multi_k(spend_index(spark, sf_dir), _spend_queries(spark, sf_dir), P.KS)


def pruning_by_k(spark, sf_dir):
    return sweeps.pruning_by_k(
        spend_index(spark, sf_dir), _spend_queries(spark, sf_dir), P.KS, series=spend(spark, sf_dir)
    )


def knn_multi_prefix(spark, sf_dir):
    return sweeps.knn_multi_prefix(spend_index(spark, sf_dir), _spend_queries(spark, sf_dir), P.DIMS, P.K)


def radius_by_sample_size(spark, sf_dir):
    return sweeps.radius_by_sample_size(
        spend(spark, sf_dir),
        spend_index(spark, sf_dir),
        _spend_queries(spark, sf_dir),
        P.K,
        P.SAMPLE_NUMS,
        P.SAMPLE_SEED,
    )


def _pruning_by_lengths(spark, sf_dir, lengths):
    index, queries = spend_index(spark, sf_dir), _spend_queries(spark, sf_dir)
    return sweeps.pruning_by_block_lengths(
        spend(spark, sf_dir),
        queries,
        sample_radius(index.sample, queries, P.K),
        lengths,
        index.uniform_len,
    )


def pruning_by_time_block(spark, sf_dir):
    return _pruning_by_lengths(spark, sf_dir, P.TIME_BLOCKS)


def pruning_by_value_block(spark, sf_dir):
    return _pruning_by_lengths(spark, sf_dir, P.VALUE_BLOCKS)


def pruning_on_off(spark, sf_dir):
    index, queries = spend_index(spark, sf_dir), _spend_queries(spark, sf_dir)
    radius = search.envelope_radius(index, queries, P.K)
    return sweeps.pruning_on_off(spend(spark, sf_dir), queries, P.K, radius)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "series_text_roundtrip": series_text_roundtrip,
        "query_points": query_points,
        "damaged_text": damaged_text,
        "envelope_text_roundtrip": envelope_text_roundtrip,
        "clean_text_job": clean_text_job,
        "augment_text_job": augment_text_job,
        "series_by_id": series_by_id,
        "block_index": block_index,
        "block_contents": block_contents,
        "replaced_series": replaced_series,
        "knn_replaced": knn_replaced,
        "time_blocks": time_blocks,
        "value_blocks": value_blocks,
        "series_envelope": series_envelope,
        "query_blocks": query_blocks,
        "chebyshev_pairs": chebyshev_pairs,
        "block_lower_bound": block_lower_bounds,
        "multi_block_lower_bound": multi_block_lower_bounds,
        "block_upper_bound": block_upper_bounds,
        "profile_series": profile_series,
        "length_violations": length_violations,
        "envelope_sample": envelope_sample,
        "sample_queries": sample_queries,
        "knn_brute_force": knn_brute_force,
        "knn_by_id_table": knn_by_id_table,
        "knn_auto": knn_auto,
        "knn_index": knn_index,
        "knn_index_no_block_filter": knn_index_no_block_filter,
        "knn_index_estimated_radius": knn_index_estimated_radius,
        "knn_index_vectors": knn_index_vectors,
        "knn_sparse_positions": knn_sparse_positions,
        "knn_within_radius": knn_within_radius,
        "knn_join": knn_join,
        "knn_scan_many": knn_scan_many,
        "knn_index_many": knn_index_many,
        "knn_filtered_scan": knn_filtered_scan,
        "knn_unfiltered_scan": knn_unfiltered_scan,
        "knn_radius": knn_radius,
        "estimate_radius": estimate_radius,
        "index_range_scan": index_range_scan,
        "index_range_join": index_range_join,
        "block_filter": block_filter,
        "complete_candidates": complete_candidates,
        "interpolate_missing": interpolate_missing,
        "clean_series": clean_series,
        "jitter_series": jitter_series,
        "augment_rows": augment_rows,
        "augment_length": augment_length,
        "augment_profile": augment_profile,
        "compare_methods": compare_methods,
        "method_recall": method_recall,
        "knn_multi_k": knn_multi_k,
        "pruning_by_k": pruning_by_k,
        "knn_multi_prefix": knn_multi_prefix,
        "radius_by_sample_size": radius_by_sample_size,
        "pruning_by_time_block": pruning_by_time_block,
        "pruning_by_value_block": pruning_by_value_block,
        "pruning_on_off": pruning_on_off,
    }
