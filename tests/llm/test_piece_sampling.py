import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from nearwave.llm.piece_sampling import MODEL_FILE, THETA, Pieces, decode, encode, piece_digest, with_pieces, with_text
from tests.llm.odd_texts import ODD_TEXTS

PATH = public_tokenizers.path(MODEL_FILE)
TEXTS = [t or "" for t in ODD_TEXTS] + ["  two  spaces and\n\nlines \n end ", "Größe: 10 €, naïve — 漢字かな", "a▁b ▁▁", "\n"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH, THETA)


def test_decoding_is_lossless(pieces):
    ids = encode(TEXTS, np.arange(len(TEXTS)), pieces, 1)
    assert [decode(x, pieces) for x in ids] == TEXTS
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [model.decode(x.tolist()) for x, t in zip(ids, TEXTS) if "\x00" not in t] == [t for t in TEXTS if "\x00" not in t]


def test_draws_follow_key_and_seed_alone(pieces):
    text = "The quick brown fox jumps over the lazy dog, again and again."
    together = encode(["other words", text, text], np.array([1, 2, 3]), pieces, 7)
    assert (together[1] == encode([text], np.array([2]), pieces, 7)[0]).all()
    many = encode([text] * 50, np.arange(50), pieces, 7)
    assert len({tuple(x) for x in many}) > 10
    assert tuple(encode([text], np.array([2]), pieces, 8)[0]) != tuple(together[1])


def test_sampled_in_proportion_to_all_segmentations(pieces):
    """Against every segmentation of one word, listed by brute force."""
    word = " there"
    weight = {s.decode(): pieces.weights[i] for i, s in pieces.strings.items() if len(s) > 1 or s.isalpha() or s == b" "}
    number = {s.decode(): i for i, s in pieces.strings.items() if s.decode("utf-8", "ignore") in weight and i > 258}

    def paths(start):
        if start == len(word):
            yield (), 0.0
        for end in range(start + 1, len(word) + 1):
            if (piece := word[start:end]) in number:
                for rest, total in paths(end):
                    yield (number[piece], *rest), total + pieces.weights[number[piece]]

    listed = {ids: math.exp(total) for ids, total in paths(0)}
    whole = sum(listed.values())
    n = 40_000
    seen = Counter(map(tuple, encode([word[1:]] * n, np.arange(n), pieces, 3)))
    assert set(seen) <= set(listed)
    for ids, w in listed.items():
        p = w / whole
        assert abs(seen[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_columns(spark, docs_of):
    docs = docs_of(ODD_TEXTS).selectExpr("*", "1 AS piece_ids", "2 AS _n", "3 AS decoded")
    rows = {r.doc_id: r for r in with_text(with_pieces(docs)).collect()}
    for i, text in enumerate(ODD_TEXTS):
        assert rows[i].decoded == text and rows[i].text == text and rows[i]["_n"] == 2
    assert rows[1].piece_ids == [] and rows[0].piece_ids is None
    digest = {r.doc_id: r for r in piece_digest(docs_of(ODD_TEXTS)).collect()}
    assert all(r.lossless for r in digest.values())
    assert all(digest[i].n_pieces == len(rows[i].piece_ids or []) for i in rows)
    assert with_pieces(docs.limit(0)).count() == 0 and piece_digest(docs.limit(0)).count() == 0


def test_same_ids_on_any_partitioning(docs_of):
    texts = [f"some text number {i} with words of all kinds" for i in range(40)] + [None, ""]
    a = {tuple(r) for r in piece_digest(docs_of(texts, partitions=1)).collect()}
    assert a == {tuple(r) for r in piece_digest(docs_of(texts, partitions=7)).collect()}
    null_keys = docs_of([(None, "text"), (None, "text")])
    assert len({tuple(r) for r in piece_digest(null_keys).collect()}) == 1
