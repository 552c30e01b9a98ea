import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearwave.llm.token_file import END_ID, TOKENIZER_FILE, EliasFano, TokenFile, WordEncoder, token_digest, write_token_files
from tests.llm.odd_texts import ODD_TEXTS

PATH = public_tokenizers.path(TOKENIZER_FILE)
TEXTS = [t or "" for t in ODD_TEXTS] + [
    "It's don't WE'LL 12,5 (x). <|endoftext|> and <|ENDOFTEXT|>, then<|startoftext|>The End.",
    "Ünïcode ΟΔΥΣΣΕΥΣ Σ İstanbul ﬁne ①② é ́x\x1fy a b c\u0085d",
    "end. end, end; 7. a.b.c. ... !? word!? 'll ' 's",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.integers(-(1 << 40), 1 << 40))
def test_elias_fano_round_trip(values, base):
    values = np.array(sorted(v + base for v in values), np.int64)
    coded = EliasFano.from_bytes(EliasFano.of(values, base).to_bytes())
    assert (coded.all() == values).all()
    assert [coded[i] for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(EliasFano.of(ends).to_bytes()) * 8 < 100_000 * (2.2 + np.log2(ends[-1] / 100_000) + 1)


def ids_of(encoder, data):
    return np.frombuffer(data, encoder.type).tolist()


def test_words_give_the_ids_of_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    want = [e.ids for e in tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    encoder = WordEncoder(PATH)
    assert [ids_of(encoder, x) for x in encoder.encode(TEXTS)] == want
    encoder.MAX_WORDS = 0
    assert [[ids_of(encoder, x) for x in encoder.encode([t])] for t in TEXTS] == [[w] for w in want]


def test_digest_against_plain_encoding(docs_of):
    tokenizer = Tokenizer.from_file(PATH)
    docs = [(i * 7 - 20, t) for i, t in enumerate(ODD_TEXTS + TEXTS)]
    start = 0
    want = set()
    for doc_id, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]
        want.add((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_digest(docs_of(docs, partitions=4).selectExpr("*", "1 AS tie", "2 AS start"))
    assert {tuple(r) for r in got.collect()} == want


def test_nulls_ties_and_nothing(docs_of):
    rows = token_digest(docs_of([(None, "a"), (3, "b b"), (3, "b b"), (None, None)])).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 3, 3] and [r.n_tokens for r in rows][2:] == [3, 3]
    assert token_digest(docs_of(["a"]).limit(0)).count() == 0


def test_random_access(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text number {i} " * (i % 5)) for i in range(600)], partitions=2)
    files = write_token_files(docs, f"file://{tmp_path}/ids", PATH).collect()
    files.sort(key=lambda r: r.part)
    encoder = WordEncoder(PATH)
    at = 0
    for row in files:
        file = TokenFile(f"{tmp_path}/ids", row.file)
        assert len(file) == row.n_docs
        for i in range(len(file)):
            n = at + i
            assert file.keys[i] == n
            assert file.ids(i).tolist() == ids_of(encoder, encoder.encode([f"text number {n} " * (n % 5)])[0]) + [END_ID]
        at += len(file)
    assert at == 600
    with pytest.raises(IndexError):
        file.ends[len(file)]
