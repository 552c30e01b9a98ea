"""Toxicity: n-grams against a plain loop, held-out accuracy, what labels may be used."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwave.llm import toxicity as tox
from tests.llm.odd_texts import ODD_TEXTS

SF_DIR = "/root/testdata/sf0.1"
RNG = np.random.default_rng(4)
CLEAN = ["".join(RNG.choice(list("abdeghilmnorstu"), RNG.integers(2, 9))) for _ in range(400)]
INSULTS = ["wrackfitz", "blaggart", "snozzler"]


def text_of(words, n=60):
    return " ".join(RNG.choice(words, n))


def examples(n):
    texts, toxic = [], []
    for i in range(n):
        words = text_of(CLEAN, int(RNG.integers(5, 120))).split()
        if i % 3 == 0:
            words[RNG.integers(len(words))] = INSULTS[i // 3 % len(INSULTS)]
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    return texts, np.array(toxic)


def plain_passages(text):
    """Words of each passage, by a loop."""
    words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.lower()).split(" ")
    words = [w for w in words if w]
    cuts = [i for i in range(0, len(words), tox.PASSAGE) if i == 0 or len(words) - i >= tox.PASSAGE // 2]
    return [words[a:b] for a, b in zip(cuts, [*cuts[1:], len(words)])]


def plain_grams(word):
    word = f" {word} "
    return [word[i : i + n] for n in tox.NGRAMS for i in range(len(word) - n + 1)]


def test_grams_against_a_loop():
    texts = [t or "" for t in ODD_TEXTS[:5]] + ["One two, THREE-four five six seven eight nine ten eleven", "straße über é"]
    g = tox.grams(texts)
    number = {}
    at = 0
    for i, text in enumerate(texts):
        for words in plain_passages(text):
            assert g.text_of[at] == i
            found = g.gram[g.ends[at] : g.ends[at + 1]]
            wanted = [x for w in words for x in plain_grams(w)]
            assert len(found) == len(wanted)
            alone = np.concatenate([tox.grams([w]).gram for w in words])
            assert sorted(found) == sorted(alone)
            for w in words:
                number.setdefault(w, set()).update(tox.grams([w]).gram)
            at += 1
    assert at == len(g.text_of)
    assert len(number["three"] & set(tox.grams(["threes"]).gram)) == len(
        set(plain_grams("three")) & set(plain_grams("threes"))
    )


def test_learns_single_words_and_their_misspellings():
    model = tox.fit(*examples(600))
    texts, toxic = examples(300)
    assert ((model.scores(texts) >= 0.5) == toxic).mean() > 0.97
    misspelt = ["wrackfits", "wrackfittz", "blagart", "blagggart", "snozler", "snozzlers"]
    padded = [" ".join([*text_of(CLEAN).split(), w, *text_of(CLEAN).split()]) for w in misspelt]
    unseen = ["".join(RNG.permutation(list("abdeghilmnorstu"))[:7]) for _ in range(200)]
    clean = model.scores([text_of(unseen, 120) for _ in range(100)])
    assert (clean >= 0.5).mean() <= 0.06
    assert (model.scores(padded) >= 0.5).mean() >= 0.5


def test_pieces_hold_whole_texts(monkeypatch):
    texts = ["", "one two three", "x" * 50, "a b " * 30]
    monkeypatch.setattr(tox, "RUN_CHARS", 16)
    parts = {}
    for owner, run in tox.pieces(texts):
        assert sum(map(len, run)) <= 16
        for i, piece in zip(owner, run):
            parts[i] = parts.get(i, "") + piece
    assert parts == {i: t for i, t in enumerate(texts) if t}


def test_one_class_and_nothing():
    assert tox.fit([], np.zeros(0)).scores(["a", ""]).tolist() == [0.5, 0.5]
    low = tox.fit(["some text", "more"], np.array([0, 0])).scores(["some text", ""])
    assert (low < 0.5).all() and low[0] == low[1]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_held_out_rows(spark, tables):
    docs, labels = tables
    rows = tox.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    caught = np.mean([r.predicted for r in rows if r.toxic == 1])
    wrong = np.mean([r.predicted for r in rows if r.toxic == 0])
    # Some labelled rows are junk without a toxic word.
    assert caught >= 0.9 and wrong <= 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (tox.fit_on(docs, table, sample=20) for table in (labels, flipped))
    assert (one.weights == other.weights).all() and one.bias == other.bias


def test_odd_rows_and_columns(spark, docs_of, tables):
    _, labels = tables
    docs = docs_of(list(enumerate(ODD_TEXTS)) + [(None, "some text")])
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("y", "h", "nth", "rated", "_rated", "score", "toxic", "held_out")])
    odd = labels.limit(3).unionAll(spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, None, 0), (3, 0, 1)], labels.schema))
    rows = tox.toxicity(docs, odd).collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    assert all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[0] == scores[1] == scores[2]
    assert tox.toxicity(docs.limit(0), odd).count() == 0
    assert tox.toxicity(docs, odd.limit(0)).filter("score = 0.5").count() == len(rows)
