import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from nearwave.llm import decontaminate
from nearwave.llm.decontaminate import contaminated, leaks, without_leaks
from nearwave.llm.queries import OP1_SQL
from tests.llm.odd_texts import ODD_TEXTS

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 7))) for _ in range(400)]


def some_words(n, rng):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingle_counts(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(docs, items):
    """{(doc, item): best similarity} over every window of the item's length, at 0.8 or more."""
    found = {}
    for d, text in docs.items():
        words = tokens(text)
        for i, item in items.items():
            want = tokens(item)
            n = len(want)
            b = shingle_counts(want)
            if n < 5:
                continue
            for start in range(len(words) - n + 1):
                a = shingle_counts(words[start : start + n])
                similarity = sum((a & b).values()) / sum((a | b).values())
                if similarity >= 0.8:
                    found[d, i] = max(found.get((d, i), 0), similarity)
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    items = {i: " ".join(some_words(n, rng)) for i, n in enumerate([5, 9, 15, 20, 33, 47, 59, 60, 60, 4, 2])}
    items[11] = items[5]
    docs = {}
    for d in range(60):
        words = some_words(rng.randint(0, 150), rng)
        item = tokens(items[rng.randrange(12)])
        kind = d % 6
        if kind == 1:
            words[10:10] = item
        elif kind == 2 and len(item) > 10:  # one word in the middle differs
            item[len(item) // 2] = "other"
            words[7:7] = item
        elif kind == 3 and len(item) > 10:  # the last word differs
            words[3:3] = item[:-1] + ["other"]
        elif kind == 4:  # half of an item is no leak
            words += item[: len(item) // 2]
        text = " ".join(words)
        docs[d] = text.upper() + "!" if kind == 5 else text.replace(" ", ", ", 3)
    docs[60] = items[4]
    return docs, items


@pytest.fixture(scope="module")
def benchmark_of(spark):
    return lambda items: spark.createDataFrame(list(items.items()), "item_id BIGINT, text STRING")


def test_against_brute_force(docs_of, benchmark_of, corpus):
    docs, items = corpus
    rows = leaks(docs_of(list(docs.items())), benchmark_of(items)).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    assert got == pytest.approx(brute_force(docs, items))
    assert len(rows) == len(got)


def test_places_in_parts_give_the_same(docs_of, benchmark_of, corpus, monkeypatch):
    docs, items = corpus
    want = {tuple(r) for r in leaks(docs_of(list(docs.items())), benchmark_of(items)).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 60)
    assert {tuple(r) for r in leaks(docs_of(list(docs.items())), benchmark_of(items)).collect()} == want


def test_no_python_on_the_main_path(docs_of, benchmark_of, corpus):
    docs, items = corpus
    plan = contaminated(docs_of(list(docs.items())), benchmark_of(items))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows(docs_of, benchmark_of):
    item = "a b c d e f g h i j k l"
    rows = [(1, item), (1, item), (1, "clean text"), (None, item)] + [(10 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = docs_of(rows).selectExpr("*", "1 AS words", "2 AS n", "3 AS item_id", "4 AS row")
    benchmark = benchmark_of({0: item, 1: None, 2: "", None: item})
    found = leaks(docs, benchmark).collect()
    assert sorted((r.doc_id or -1, r.item_id if r.item_id is not None else -1) for r in found) == [(-1, -1), (-1, 0), (1, -1), (1, 0)]
    kept = without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, *range(10, 10 + len(ODD_TEXTS))]
    assert leaks(docs.limit(0), benchmark).count() == 0
    assert leaks(docs, benchmark.limit(0)).count() == 0
    assert without_leaks(docs, benchmark.limit(0)).count() == len(rows)


def sql_rows(docs, items):
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", list(rows.items()))
    return sorted(con.execute(OP1_SQL).fetchall())


def test_items_cut_at_the_edges(docs_of, benchmark_of):
    rng = random.Random(3)
    items = {i: " ".join(some_words(n, rng)) for i, n in enumerate([20, 39, 59])}
    docs = {}
    for i, item in items.items():
        words, more = tokens(item), some_words(80, rng)
        cut = len(words) // 20
        docs[10 * i] = " ".join(words[cut:] + more)
        docs[10 * i + 1] = " ".join(more + words[:-cut])
        docs[10 * i + 2] = " ".join(more[:40] + words[cut:] + more[40:])
    rows = sorted(tuple(r) for r in leaks(docs_of(list(docs.items())), benchmark_of(items)).collect())
    assert rows == sql_rows(docs, items) and len(rows) == len(docs)


def test_document_shorter_than_the_item(docs_of, benchmark_of):
    words = some_words(39, random.Random(4))
    docs = docs_of([(1, " ".join(words[:-1])), (2, " ".join(words[4:])), (3, " ".join(words[8:]))])
    rows = sorted(tuple(r) for r in leaks(docs, benchmark_of({7: " ".join(words)})).collect())
    assert rows == [(1, 7, 0, 38, 34 / 35), (2, 7, 0, 35, 31 / 35)]


def test_windows_just_above_the_similarity(docs_of, benchmark_of):
    rng = random.Random(12)
    items, docs = {}, {}
    for k in range(60):
        n = [13, 30, 39, 50, 59, 150][k % 6]
        words = some_words(n, rng)
        m = n - 4
        # The words at one end differ: the most that leave 0.8.
        changed = max(c for c in range(1, n) if (m - c) / (m + c) >= 0.8)
        items[k] = " ".join(words)
        docs[k] = " ".join(some_words(60, rng) + words[:-changed] + ["other"] * changed + some_words(60, rng))
    rows = sorted(tuple(r) for r in leaks(docs_of(list(docs.items())), benchmark_of(items)).collect())
    assert rows == sql_rows(docs, items) and {(r[0], r[1]) for r in rows} >= {(k, k) for k in items}


def test_inserted_and_deleted_words(docs_of, benchmark_of):
    rng = random.Random(13)
    items = {i: " ".join(some_words(n, rng)) for i, n in enumerate([100, 140, 160])}
    docs = {}
    for i, item in items.items():
        words, third = tokens(item), len(tokens(item)) // 3
        before, after = some_words(30, rng), some_words(30, rng)
        longer = words[:third] + ["new"] + words[third : 2 * third] + ["new"] + words[2 * third :]
        shorter = words[:third] + words[third + 1 : 2 * third] + words[2 * third + 1 :]
        docs[10 * i] = " ".join(before + longer + after)
        docs[10 * i + 1] = " ".join(before + shorter + after)
    rows = sorted(tuple(r) for r in leaks(docs_of(list(docs.items())), benchmark_of(items)).collect())
    assert rows == sql_rows(docs, items) and len(rows) == len(docs)


def _prints(spark, arrays):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i INT, a ARRAY<BIGINT>")
    return [r.p for r in rows.select("i", decontaminate.fingerprint(F.col("a")).alias("p")).orderBy("i").collect()]


def _apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b))


def test_fingerprint_against_a_loop(spark):
    rng = random.Random(5)
    arrays = [[rng.getrandbits(63) for _ in range(n)] for n in (1, 2, 7, 30)]
    again = [
        r.h for r in spark.createDataFrame([(a,) for a in arrays], "a ARRAY<BIGINT>").selectExpr("transform(a, x -> xxhash64(2, x)) h").collect()
    ]
    for found, one, two in zip(_prints(spark, arrays), arrays, again):
        bits = [int(2 * sum(h >> b & 1 for h in hashes) > len(hashes)) for hashes in (one, two) for b in range(64)]
        ends = decontaminate._block_ends()
        assert found == [int("".join(map(str, bits[a:b])), 2) for a, b in zip(ends, ends[1:])]


def test_pairs_within_the_radius_meet(spark):
    rng = random.Random(6)
    ends = decontaminate._block_ends()
    widths = [b - a for a, b in zip(ends, ends[1:])]
    item = [rng.getrandbits(w) for w in widths]
    prints = spark.createDataFrame([(1, 20, item)], "item BIGINT, n INT, print ARRAY<INT>")
    keys = {(r.block, r.value) for r in decontaminate._item_keys(prints).collect()}
    places = [(j, b) for j, w in enumerate(widths) for b in range(w)]
    for _ in range(500):
        other = list(item)
        for j, b in rng.sample(places, decontaminate.RADIUS):
            other[j] ^= 1 << b
        assert any((j, v) in keys for j, v in enumerate(other))


def test_windows_at_the_limit_are_within_the_radius(spark):
    """A ninth of the shingles lost is a similarity of 0.8: recall over items of 13 to 150 words."""
    rng = random.Random(7)
    pairs = []
    for n_words in (13, 14, 22, 31, 39, 50, 59, 100, 150):
        m = n_words - 4
        for _ in range(60):
            hashes = [rng.getrandbits(63) for _ in range(m)]
            pairs.append((hashes, hashes[m // 9 :]))
    prints = _prints(spark, [a for pair in pairs for a in pair])
    met = [_apart(a, b) <= decontaminate.RADIUS for a, b in zip(prints[::2], prints[1::2])]
    assert sum(met) >= 0.99 * len(met)


def test_common_counts_repeats(spark):
    rng = random.Random(8)
    rows = [tuple(sorted(rng.choices(range(6), k=rng.randint(0, 12))) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a ARRAY<BIGINT>, b ARRAY<BIGINT>")
    for r in df.select("a", "b", decontaminate._common(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == sum((Counter(r.a) & Counter(r.b)).values())


def test_clashing_names(docs_of, benchmark_of, corpus):
    documents, items = corpus
    docs = docs_of(list(documents.items()))
    kept = {r.doc_id for r in without_leaks(docs, benchmark_of(items)).collect()}
    for name in ("leak_id", "_leak_hash", "text_hash"):
        found = without_leaks(docs.withColumn(name, F.lit("mine")), benchmark_of(items))
        assert name in found.columns and {r.doc_id for r in found.filter(F.col(name) == "mine").collect()} == kept
