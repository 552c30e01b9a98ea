"""Ranked lexical search: the best documents of each query text, term at a time.

Documents become rows of (term, count) for the terms that any query has; corpus counts are sums over
these rows.  A task then takes its documents a chunk at a time, turns them into posting lists, and goes
through the terms of a query from the rarest to the most frequent, adding to accumulators:

* while the terms still to come could lift a new document to the k-th best partial score, every
  posting may create an accumulator;
* from the term on at which their bounds together cannot, none is created any more.  Survivors go on
  to be updated exactly, and leave as soon as they cannot reach the k-th score either.

Partial scores only grow, so the k-th best of them is never above the final one, and nothing that
belongs to the answer is lost.  A task sends on k rows a query at most; answers are merged in pieces.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwave.workdir import new_folder

TOP = 50
#: Terms of queries that travel with the tasks at a time, about; more are searched in blocks of queries.
BLOCK_TERMS = 1 << 18
#: Postings and documents that a task inverts at a time.
CHUNK_POSTINGS, CHUNK_DOCS = 1 << 21, 1 << 16
#: Bytes of a text that are split into terms at a time.
RUN_BYTES = 1 << 20
#: Pieces in which the rows of one query are merged before the last step.
MERGE_WAYS = 16
#: What the weights and the length norm are scaled by.
SCALE, TF_SCALE, LEAST_NORM, NORM_RANGE, NORM_WEIGHT = 1_000_000_000, 1000, 50, 50, 20

# Letters and digits of ASCII and every byte beyond it are parts of terms; A-Z are lowered.
_PARTS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def term_runs(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of bounded size."""
    data = data.translate(_PARTS)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + RUN_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term: binary), each once; rows that share an item_id are one query."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                terms = {t for run in term_runs(text) for t in run}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(terms), pa.int64()), pa.array(list(terms), pa.binary())], names=["item_id", "term"]
                )

    rows = queries.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    return rows.mapInArrow(split, "item_id long, term binary").distinct()


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): the length of each document in terms, and the counts of those listed."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, ends, found, tfs = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                seen: Counter = Counter()
                n = 0
                for run in term_runs(text.as_py() or b""):
                    n += len(run)
                    seen.update(map(number, run))
                seen.pop(None, None)
                found += seen.keys()
                tfs += seen.values()
                sizes.append(n)
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


@dataclass
class Query:
    """A query's terms by number, rarest first, and their weights."""

    item_id: int | None
    terms: np.ndarray
    weights: np.ndarray


class Best:
    """The k best (score, doc_id) so far: highest score first, then smallest doc_id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def limit(self) -> int:
        """The k-th score; nothing below it can be an answer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(c) for c in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Postings:
    """Posting lists of a chunk of documents: per term ascending places of documents, and impacts."""

    def __init__(self, n_docs: int, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts = docs[order], impacts[order]
        counts = np.bincount(terms, minlength=n_terms)
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        self.largest = np.zeros(n_terms, np.int64)
        present = np.flatnonzero(counts)
        if len(present):
            self.largest[present] = np.maximum.reduceat(self.impacts, self.ends[present])
        self.sums = np.zeros(n_docs, np.int64)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.ends[term], self.ends[term + 1])
        return self.docs[span], self.impacts[span]

    def scores(self, query: Query, k: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that may be among the k best.

        ``limit``: a score that k documents elsewhere are known to reach, 0 if none is.
        """
        sums = self.sums
        sums[:] = 0
        bounds = query.weights * self.largest[query.terms]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        alive = None
        for j, (term, weight) in enumerate(zip(query.terms.tolist(), query.weights.tolist())):
            if not bounds[j]:
                continue
            if alive is None and rest[j] < limit:
                alive = np.flatnonzero(sums)
            docs, impacts = self.of(term)
            if alive is None:
                sums[docs] += weight * impacts
                held = sums[sums > 0]
            else:
                alive = alive[sums[alive] + rest[j] >= limit]
                at = np.searchsorted(docs, alive)
                at[at == len(docs)] = 0
                met = docs[at] == alive
                sums[alive[met]] += weight * impacts[at[met]]
                held = sums[alive]
            if len(held) >= k:
                limit = max(limit, int(np.partition(held, len(held) - k)[len(held) - k]))
        alive = np.flatnonzero(sums) if alive is None else alive
        alive = alive[(sums[alive] >= limit) & (sums[alive] > 0)]
        return alive, sums[alive]


def best_rows(counts: DataFrame, queries: list[Query], n_terms: int, n_docs: int, length: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): per task the k best of its documents for each query.

    ``n_docs`` documents have a term, and ``length`` terms with repeats.
    """
    shared = counts.sparkSession.sparkContext.broadcast(queries)

    def inverted(batches: list[pa.RecordBatch]) -> tuple[Postings, np.ndarray, np.ndarray]:
        chunk = pa.Table.from_batches(batches).combine_chunks()
        keys, sizes, terms, tfs = (c.combine_chunks() for c in chunk.columns)
        norm = 100 - NORM_RANGE + NORM_RANGE * sizes.to_numpy() * n_docs // max(1, length)
        rows = np.repeat(np.arange(len(sizes)), np.diff(np.asarray(terms.offsets)))
        tf = tfs.flatten().to_numpy()
        impacts = SCALE * tf // (TF_SCALE * tf + NORM_WEIGHT * norm[rows])
        null = np.asarray(keys.is_null())
        postings = Postings(len(sizes), terms.flatten().to_numpy(), rows, impacts, n_terms)
        return postings, keys.fill_null(0).to_numpy(), null

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, n_rows, n_postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            n_rows += batch.num_rows
            n_postings += len(batch.column(2).flatten())
            if n_rows >= CHUNK_DOCS or n_postings >= CHUNK_POSTINGS:
                yield held
                held, n_rows, n_postings = [], 0, 0
        if held:
            yield held

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in shared.value]
        for held in chunks(batches):
            postings, keys, null = inverted(held)
            for query, found in zip(shared.value, best):
                at, scores = postings.scores(query, k, found.limit)
                if len(at):
                    found.add(scores, keys[at], null[at])
        for query, found in zip(shared.value, best):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([query.item_id] * len(found.score), pa.int64()),
                    pa.array(found.doc, mask=found.null),
                    pa.array(found.score),
                ],
                names=["item_id", "doc_id", "score"],
            )

    return counts.filter("size(terms) > 0").mapInArrow(search, "item_id long, doc_id long, score long")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best rows of each item, merged in pieces first."""

    def first(df: DataFrame, *by: str | Column) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    piece = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_WAYS))
    merged = first(rows.withColumn("piece", piece), "item_id", "piece").drop("piece", "rank")
    return first(merged, "item_id").select("item_id", "rank", "doc_id", "score")


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_block(docs: DataFrame, block: list, folder: str, k: int) -> DataFrame:
    """Answers of the queries whose (item_id, term) rows are given."""
    spark = docs.sparkSession
    terms = sorted({bytes(r.term) for r in block})
    term_counts(docs, terms).write.parquet(folder)
    counts = spark.read.parquet(folder)
    size = counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, 1)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A row for each listed term at most.
    df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    number = {t: i for i, t in enumerate(terms)}
    of_item: dict[int | None, list[int]] = {}
    for r in block:
        of_item.setdefault(r.item_id, []).append(number[bytes(r.term)])
    queries = []
    for item_id, numbers in of_item.items():
        rarest = sorted((df[t], t) for t in numbers if t in df)
        weights = [_weight(size[0], n) for n, _ in rarest]
        queries.append(Query(item_id, np.array([t for _, t in rarest], np.int64), np.array(weights, np.int64)))
    return best_rows(counts, queries, len(terms), size[0], size[1], k)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each query.

    A null or empty text has no term: such documents are never found and count in no statistic, such
    queries have no answer.  Queries that share an item_id are one query of all their terms; a null
    item_id is one of its own.  Every row of ``docs`` is a document, repeated ones too; equal scores
    are ordered by doc_id, null last.  Long texts are split a megabyte at a time.  Empty tables give
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "ranked")
    query_terms(queries).write.parquet(f"{folder}/terms")
    asked = spark.read.parquet(f"{folder}/terms")
    n_blocks = max(1, math.ceil(asked.count() / block_terms))
    found = []
    for i in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).collect()  # about ``block_terms`` rows
        if block:
            found.append(_search_block(docs, block, f"{folder}/counts-{i}", k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return ranked(reduce(DataFrame.unionAll, found), k)
