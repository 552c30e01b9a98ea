import random
import re
from collections import Counter

import pytest
import zstandard

from nearwave.llm.compression_rules import Bands, keep_good, measure, quality_rules
from tests.llm.odd_texts import ODD_TEXTS


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered), base


def prose(n, seed=1):
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)) + "."


TEXTS = ODD_TEXTS + [prose(300), prose(60) + "\n" + prose(60), "a b c d\n" * 40, prose(5000) + "\na line\n\na line\r\na line"]


def test_counts_are_the_contract(docs_of):
    rows = {r.doc_id: r for r in quality_rules(docs_of(TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        if len(text or "") < 40_000:
            assert got == plain(text), i
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("n", [60, 200, 1000, 5000, 30000])
def test_prose_of_any_length_is_kept(n):
    assert measure(prose(n), Bands(), zstandard.ZstdCompressor(level=3))[-1]


def test_junk_goes():
    compressor = zstandard.ZstdCompressor(level=3)
    rng = random.Random(2)
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(8)) for _ in range(800))
    # No window of three words repeats, the characters do.
    counting = " ".join(f"item{k:05d}item{k:05d}item{k:05d}" for k in range(800))
    half = prose(3000) + " " + " ".join(f"row-{k // 7}-{k:06d}-row-{k // 7}" for k in range(1500))
    for text in (noise, counting, half):
        row = measure(text, Bands(), compressor)
        assert not row[-2] and not row[-1]


def test_filter_keeps_rows_as_they_are(docs_of):
    docs = docs_of(TEXTS).selectExpr("*", "7 AS kept", "8 AS n_words")
    kept = {r.doc_id: r for r in keep_good(docs).collect()}
    want = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    assert set(kept) == want and want
    assert all((r.kept, r.n_words, r.text) == (7, 8, TEXTS[r.doc_id]) for r in kept.values())
    assert keep_good(docs.limit(0)).count() == 0
