"""Ranked search against scores of all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwave.llm import ranked_search as ranked
from tests.llm.odd_texts import ODD_TEXTS

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def expected(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, Counter(b), len(b)) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in terms(text) if t in df}
        scores = []
        for doc, bag, n in bags:
            m = 50 + 50 * n * n_docs // length
            parts = [
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in asked & bag.keys()
            ]
            if sum(parts) > 0:
                scores.append((-sum(parts), doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(docs_of, items, spark, docs, k, **options):
    asked = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    rows = ranked.ranked_search(docs_of(docs), asked, k, **options).collect()
    return sorted([tuple(r) for r in rows], key=str)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["Äpfel", "日本", "x_y"]
    p = 1 / np.arange(1, len(words) + 1)
    draw = lambda size: " ".join(rng.choice(words, size, p=p / p.sum()))
    docs = [(i, draw(rng.integers(1, 80))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1].upper()) for i in range(n // 3)]  # ties
    return docs, [(i, draw(25)) for i in range(12)]


@pytest.mark.parametrize("chunk", [20, 1 << 16])
@pytest.mark.parametrize("block_terms", [15, 1 << 18])
def test_against_brute_force(spark, docs_of, monkeypatch, chunk, block_terms):
    docs, items = corpus(400, 3)
    monkeypatch.setattr(ranked, "CHUNK_DOCS", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert found(docs_of, items, spark, docs, 7, block_terms=block_terms) == expected(docs, items, 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_accumulators_end():
    """Once the terms left cannot reach the limit, documents that have only them get no accumulator."""
    lists = ranked.Postings(4, np.array([0, 1, 1, 1]), np.array([0, 0, 1, 2]), np.array([100, 10, 10, 10]), 2)
    query = ranked.Query(1, np.array([0, 1]), np.array([5, 1]))
    at, scores = lists.scores(query, 1, 0)
    assert (at.tolist(), scores.tolist()) == ([0], [510])
    assert lists.sums.tolist() == [510, 0, 0, 0]


def test_odd_rows(spark, docs_of):
    docs = list(enumerate(ODD_TEXTS)) + [(None, "same text"), (3, "one one two"), (3, "one one two")]
    items = [(1, "same TEXT"), (1, "word"), (None, "one"), (2, None), (3, ""), (4, "unheard"), (5, "x" * 30_000)]
    assert found(docs_of, items, spark, docs, 4) == expected(docs, items, 4)


def test_long_text_in_runs(monkeypatch):
    text = ("ab cd," * 1000 + "e" * 500 + " f").encode()
    whole = [t for run in ranked.term_runs(text) for t in run]
    monkeypatch.setattr(ranked, "RUN_BYTES", 7)
    assert [t for run in ranked.term_runs(text) for t in run] == whole == [t.encode() for t in terms(text.decode())]


def test_empty_tables_and_other_columns(spark, docs_of):
    asked = spark.createDataFrame([(1, "one")], "item_id BIGINT, text STRING")
    names = ["n", "terms", "tfs", "piece", "rank", "score", "item_id"]
    docs = docs_of([(1, "one two"), (2, "two")]).select("*", *[F.lit("x").alias(c) for c in names])
    assert [tuple(r)[:3] for r in ranked.ranked_search(docs, asked.withColumn("term", F.lit(1))).collect()] == [(1, 1, 1)]
    assert ranked.ranked_search(docs.limit(0), asked).count() == 0
    assert ranked.ranked_search(docs, asked.limit(0)).count() == 0
