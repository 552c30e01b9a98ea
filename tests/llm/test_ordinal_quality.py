import random

import numpy as np
import pytest

from nearwave.llm.ordinal_quality import OrdinalModel, features, fit, graded, quality_classifier
from tests.llm.odd_texts import ODD_TEXTS

MARKS = {0: ["awful", "nasty"], 1: ["### $$$", "&&& ***"], 2: []}


def text_of(grade, rng):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(30, 300))]
    for _ in range(3 if grade < 2 else 0):
        words.insert(rng.randrange(len(words)), rng.choice(MARKS[grade]))
    return " ".join(words)


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(3)
    grades = [rng.choices([0, 1, 2], [1, 1, 5])[0] for _ in range(2400)]
    return grades, [text_of(g, rng) for g in grades]


def test_held_out_accuracy(rated):
    grades, texts = rated
    rows = [features(t) for t in texts]
    model = fit(rows[:1600], np.array(grades[:1600]), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    p = model.probabilities(model.scores(rows[1600:]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    right = (p[:, 2] >= 0.5) == (np.array(grades[1600:]) == 2)
    assert right.mean() > 0.97
    expected = p @ np.arange(3)
    by_grade = [expected[np.array(grades[1600:]) == g].mean() for g in range(3)]
    assert by_grade[0] < by_grade[1] < by_grade[2]


def test_probabilities_are_cumulative_links():
    model = OrdinalModel(np.zeros(4), np.array([-1.0, 2.0]))
    p = model.probabilities(np.array([0.5]))[0]
    below = 1 / (1 + np.exp(-(np.array([-1.0, 2.0]) - 0.5)))
    assert np.allclose(p, [below[0], below[1] - below[0], 1 - below[1]])


def test_nothing_to_fit():
    for rows, grades in (([], []), ([features("a b")] * 3, [2, 2, 2])):
        model = fit(rows, np.array(grades, np.int64), 3)
        assert not model.weights.any() and (np.diff(model.thresholds) >= 0).all()


def test_query(spark, docs_of, rated):
    grades, texts = rated
    docs = docs_of(list(zip(range(600), texts)) + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, texts[0])])
    docs = docs.selectExpr("*", "1 AS grade", "2 AS h", "3 AS kept")
    labels = spark.createDataFrame(
        [(i, None if g == 0 else int(g > 1), int(g == 0)) for i, g in enumerate(grades[:400])]
        + [(None, 1, 0), (7_000_000, 1, 0), (5, None, None)],
        "doc_id BIGINT, quality INT, toxic INT",
    )
    assert graded(labels).count() == 401
    rows = quality_classifier(docs, labels).collect()
    assert len(rows) == 600 + len(ODD_TEXTS) + 1
    kept = {r.doc_id: r.kept for r in rows}
    assert np.mean([kept[i] == (grades[i] == 2) for i in range(600)]) > 0.9
    again = {(r.doc_id, r.p_tail) for r in quality_classifier(docs.repartition(5), labels).collect()}
    assert again == {(r.doc_id, r.p_tail) for r in rows}
    assert quality_classifier(docs.limit(0), labels).count() == 0
    assert quality_classifier(docs, labels.limit(0)).count() == len(rows)
