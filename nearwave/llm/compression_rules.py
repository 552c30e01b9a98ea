"""Quality rules: word counts and zstandard compression bands.

Text that repeats itself compresses too well, random strings hardly at all.  How well plain
prose compresses depends on its length, so the limits on the ratio (UTF-8 bytes by compressed
bytes) are given by length.  They hold for the whole text, and for fixed chunks of it: a long
text of which only a part is junk has a usual ratio as a whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from nearwave.llm.common import BLANKS

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio.

    ``limits`` holds (bytes from, least ratio, largest ratio) in ascending order: a text obeys
    the last row whose first number it reaches.  ``chunk_bytes`` is the length of a chunk and
    ``bad_share`` the largest share of bytes that chunks outside their limits may have.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.4, 2.4),
        (300, 1.2, 2.6),
        (1_000, 1.45, 3.0),
        (3_000, 1.6, 3.4),
        (10_000, 1.7, 4.2),
        (100_000, 1.7, 5.0),
    )
    chunk_bytes: int = 4096
    bad_share: float = 0.4
    level: int = 3

    def hold(self, n_bytes: int, ratio: float) -> bool:
        _, least, most = self.limits[bisect_right(self.limits, n_bytes, key=lambda row: row[0]) - 1]
        return least <= ratio <= most


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, bad_chunk_share double, base_failed boolean, kept boolean"
)


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at two places or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        if k > 1:  # renumbers, so that no product overflows
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[k : k + n]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[where] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= again
    return int(covered.sum())


def measure(text: str | None, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()  # splits bytes at ASCII white space only
    n_words = len(words)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    n_repeat = repeated_window_words(words)
    base_failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    ratio = len(data) / len(compressor.compress(data)) if data else 0.0
    bad = 0
    if len(data) > bands.chunk_bytes:
        for start in range(0, len(data), bands.chunk_bytes):
            chunk = data[start : start + bands.chunk_bytes]
            if not bands.hold(len(chunk), len(chunk) / len(compressor.compress(chunk))):
                bad += len(chunk)
    bad_share = bad / len(data) if data else 0.0
    kept = not base_failed and bands.hold(len(data), ratio) and bad_share <= bands.bad_share
    return (
        n_words,
        len(text) - sum(text.count(c) for c in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        n_repeat,
        ratio,
        bad_share,
        base_failed,
        kept,
    )


def measures(text: Column, bands: Bands = Bands()) -> Column:
    """The measures of one text and the verdict ``kept``, as a struct of ``MEASURES``."""
    names = [field.split()[0] for field in MEASURES.split(", ")]

    @pandas_udf(MEASURES)
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            yield pd.DataFrame([measure(t, bands, compressor) for t in texts], columns=names)

    return of_batches(text)


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per row of ``docs``: doc_id and the measures.

    A null text counts as empty: no words, so ``base_failed``.  A null doc_id stays null, rows
    that repeat are measured each, other columns are not read, an empty table gives no rows.
    """
    return docs.select("doc_id", measures(F.col("text"), bands).alias("m")).select("doc_id", "m.*")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    return docs.filter(measures(F.col("text"), bands)["kept"])
