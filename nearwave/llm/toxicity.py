"""Toxicity: embeddings of character n-grams, averaged, into a linear softmax.

A text is cut into passages of a few words.  A passage is the mean of the embeddings of its words'
character n-grams (a word's edges count as characters), hashed to a fixed number of rows; a softmax over a
linear map of that mean tells the two classes apart.  Misspelt words that were never seen share most n-grams
with those that were.  A text is as toxic as its worst passage, so one insult is not averaged away.

Embeddings and map are learned together in numpy (AdaGrad) on the driver, from a bounded sample of the
labelled rows.  Labels are of whole texts: a first round takes every passage of a toxic text for toxic,
later ones only the worst, next to the worst and some other passages of clean texts.

Scoring is linear, so it needs one number for each row of embeddings, and is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from nearwave.llm.common import full_text, row_runs

#: Toxic rows to learn from at most, clean ones for each of them, and characters of all.
SAMPLE, CLEAN_FOR_EACH, SAMPLE_CHARS = 2_000, 3, 6_000_000
BITS, DIM = 18, 8
NGRAMS = (3, 4, 5, 6)
#: Words of a passage; a text's last one also has what would be less than half of one more.
PASSAGE = 8
#: Zero rows in every mean, so that a passage of one or two n-grams says little.
PADDING = 32
#: Texts of the sample that an n-gram has to be in; fewer if the sample is very small.
LEAST_TEXTS = 3
#: What a mean is multiplied by before the softmax: n-grams of a passage are many, and few of them tell.
GAIN = 32.0
ROUNDS, EPOCHS, BATCH, RATE = 6, 4, 512, 0.03
#: Characters that are hashed at a time.  A longer text is cut between words; its pieces have passages of their own.
RUN_CHARS = 1 << 19
FOLDS, HELD_OUT = 5, 0

_MASK = (1 << BITS) - 1
_FACTOR = np.uint32(2654435761)
_SPACE = np.array([not chr(c).isalnum() for c in range(128)])


@dataclass
class Grams:
    """Rows of embeddings (``gram``) that occur in passages, and which passages each text has.

    Occurrences are ordered by passage: those of passage p are ``ends[p]`` to ``ends[p + 1]``.
    """

    gram: np.ndarray
    ends: np.ndarray
    text_of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends)

    def means(self, sums: np.ndarray) -> np.ndarray:
        return GAIN * sums / (self.counts + PADDING)

    def take(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the given passages back to back, and how many each has."""
        n = self.counts[passages]
        starts = np.repeat(self.ends[passages] - np.append(0, np.cumsum(n)[:-1]), n)
        return self.gram[starts + np.arange(int(n.sum()))], n


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Runs of pieces of texts of ``RUN_CHARS`` characters at most, with the place of each piece's text.

    A word longer than that is cut.
    """
    owner, run, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            end = start + RUN_CHARS
            if end < len(text):
                gap = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))
                end = gap if gap > 0 else end
            piece = text[start:end]
            if run and size + len(piece) > RUN_CHARS:
                yield np.array(owner), run
                owner, run, size = [], [], 0
            owner.append(i)
            run.append(piece)
            size += len(piece)
            start = end
    if run:
        yield np.array(owner), run


def all_grams(texts: list[str]) -> Grams:
    """:func:`grams` of texts of any size, put together piece by piece."""
    parts = [(owner, grams(run)) for owner, run in pieces(texts)]
    if not parts:
        return Grams(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    counts = np.concatenate([g.counts for _, g in parts])
    return Grams(
        np.concatenate([g.gram for _, g in parts]),
        np.append(0, np.cumsum(counts)),
        np.concatenate([owner[g.text_of] for owner, g in parts]),
    )


def grams(texts: list[str]) -> Grams:
    """N-grams of all words of the texts, by passage; ASCII signs and white space part words."""
    joined = "\n".join(["", *(t.lower() for t in texts), ""])
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) for t in texts], np.int64) + 1
    space = np.zeros(len(chars), bool)
    ascii_ = chars < 128
    space[ascii_] = _SPACE[chars[ascii_]]
    # Of a run of signs one place is left, which ends one word and begins the next.
    kept = ~space
    kept[1:] |= ~space[:-1]
    kept[0] = True
    text_of = np.append(np.repeat(np.arange(len(texts)), lengths), max(0, len(texts) - 1))[kept]
    chars = np.where(space, np.uint32(32), chars)[kept]
    space = space[kept]
    # Words are numbered from 0 in each text; a passage is a run of them.
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    word = np.zeros(len(chars), np.int64)
    word[first] = 1
    word = np.cumsum(word) - 1
    owner = text_of[first]
    nth = np.arange(len(first)) - np.searchsorted(owner, owner)
    left = np.searchsorted(owner, owner, "right") - np.arange(len(first))
    new = (nth == 0) | ((nth % PASSAGE == 0) & (left >= PASSAGE // 2))
    passage_of_word = np.cumsum(new) - 1
    inner = np.concatenate([[0], np.cumsum(space)])
    found, owners = [], []
    mixed = chars * _FACTOR
    hashed = mixed.copy()
    for n in range(2, max(NGRAMS) + 1):
        # The first n characters from each place on, hashed one after the other.
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * _FACTOR + mixed[n - 1 :]
        if n in NGRAMS:
            start = np.arange(len(hashed))
            whole = inner[start + n - 1] == inner[start + 1]  # no word ends inside
            start = start[whole]
            mix = hashed[whole]
            found.append(((mix ^ (mix >> np.uint32(13))) & np.uint32(_MASK)).astype(np.int32))
            owners.append(passage_of_word[word[start + 1]] if len(first) else start)
    gram, passage = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(passage, kind="stable")
    n_passages = int(new.sum()) if len(first) else 0
    counts = np.bincount(passage, minlength=n_passages)[:n_passages]
    return Grams(gram[order], np.append(0, np.cumsum(counts)), owner[new])


@dataclass
class ToxicityModel:
    """Per row of embeddings what one occurrence adds to the log-odds, before the mean; and the bias."""

    weights: np.ndarray
    bias: float

    def log_odds(self, g: Grams) -> np.ndarray:
        """Of each passage."""
        sums = np.zeros(len(g.counts))
        for i, j in row_runs(g.counts.tolist(), RUN_CHARS):
            weights = np.append(self.weights[g.gram[g.ends[i] : g.ends[j]]], 0.0)
            sums[i:j] = np.add.reduceat(weights, g.ends[i:j] - g.ends[i])
        return self.bias + g.means(np.where(g.counts > 0, sums, 0.0))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each text; a text without words has that of the bias alone."""
        worst = np.full(len(texts), -np.inf)
        for owner, run in pieces(texts):
            g = grams(run)
            np.maximum.at(worst, owner[g.text_of], self.log_odds(g))
        return 1 / (1 + np.exp(-np.clip(np.where(np.isinf(worst), self.bias, worst), -40, 40)))


class _Learner:
    """Embeddings and softmax map under AdaGrad; the map's two columns start opposite, so both learn."""

    def __init__(self, seed: int, known: np.ndarray):
        """``known``: rows that learn; the others stay zero and say nothing."""
        self.rng = np.random.default_rng(seed)
        self.known = known
        self.table = self.rng.normal(0, 0.01, (1 << BITS, DIM)) * known[:, None]
        self.table_sq = np.full(1 << BITS, 1e-6)
        self.map = self.rng.normal(0, 0.5, (DIM, 2))
        self.map_sq = np.full((DIM, 2), 1e-3)
        self.bias, self.bias_sq = np.zeros(2), np.full(2, 1e-3)

    def model(self) -> ToxicityModel:
        difference = self.map[:, 1] - self.map[:, 0]
        return ToxicityModel(self.table @ difference, float(self.bias[1] - self.bias[0]))

    def step(self, gram: np.ndarray, n: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """One step of AdaGrad on passages with ``n`` occurrences each."""
        starts = np.append(0, np.cumsum(n)[:-1])
        scale = GAIN / (n + PADDING)[:, None]
        means = np.add.reduceat(self.table[gram], starts, axis=0) * scale
        logits = means @ self.map + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        slope = p * (weights / weights.sum())[:, None]
        by_passage = slope @ self.map.T * scale
        rows, inverse = np.unique(gram, return_inverse=True)
        each = np.repeat(np.arange(len(n)), n)
        gradient = np.stack([np.bincount(inverse, by_passage[each, d], len(rows)) for d in range(DIM)], axis=1)
        gradient *= self.known[rows, None]
        self.table_sq[rows] += (gradient**2).mean(axis=1)
        self.table[rows] -= RATE * gradient / np.sqrt(self.table_sq[rows])[:, None]
        for value, squares, g in ((self.map, self.map_sq, means.T @ slope), (self.bias, self.bias_sq, slope.sum(axis=0))):
            squares += g**2
            value -= RATE * g / np.sqrt(squares)

    def epoch(self, g: Grams, passages: np.ndarray, labels: np.ndarray) -> None:
        """All given passages once, in random order; both classes weigh alike in sum."""
        share = np.bincount(labels, minlength=2) / max(1, len(labels))
        weight = 0.5 / np.maximum(share, 1e-9)
        for part in np.array_split(self.rng.permutation(len(passages)), -(-len(passages) // BATCH)):
            gram, n = g.take(passages[part])
            self.step(gram, n, labels[part], weight[labels[part]])


def _worst(odds: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """The passage of highest log-odds of each text."""
    order = np.lexsort((-odds, text_of))
    return order[np.append(True, text_of[order][1:] != text_of[order][:-1])] if len(order) else order


def fit(texts: list[str], toxic: np.ndarray, seed: int = 3) -> ToxicityModel:
    """The model of labelled texts.  With one class or no words it says that class's share for every text."""
    g = all_grams(texts)
    usable = np.flatnonzero(g.counts > 0)
    labels = np.asarray(toxic, np.int64)[g.text_of] if len(usable) else np.zeros(0, np.int64)
    if len(np.unique(labels[usable])) < 2:
        share = (np.sum(toxic) + 0.5) / (len(texts) + 1.0)
        return ToxicityModel(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    # An n-gram of one or two texts would only tell these texts from others.
    in_texts = np.zeros(1 << BITS, np.int64)
    for i, j in zip(*(np.searchsorted(g.text_of, range(k, len(texts) + k)) for k in (0, 1))):
        in_texts[np.unique(g.gram[g.ends[i] : g.ends[j]])] += 1
    learner = _Learner(seed, in_texts >= min(LEAST_TEXTS, len(texts) // 20))
    bad, clean = usable[labels[usable] == 1], usable[labels[usable] == 0]
    learner.epoch(g, usable, labels[usable])
    for _ in range(ROUNDS):
        odds = learner.model().log_odds(g)
        worst_bad = bad[_worst(odds[bad], g.text_of[bad])]
        worst_clean = clean[_worst(odds[clean], g.text_of[clean])]
        others = learner.rng.choice(clean, min(len(clean), 2 * len(worst_bad)), replace=False)
        # Every passage of a clean text that looks toxic is a mistake, not only the worst.
        chosen = np.unique(np.concatenate([worst_bad, bad[odds[bad] > 2], worst_clean, clean[odds[clean] > 0], others]))
        for _ in range(EPOCHS):
            learner.epoch(g, chosen, labels[chosen])
    return learner.model()


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose labels are not learned from; rows without doc_id are not held out."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """The model of at most ``sample`` toxic and ``CLEAN_FOR_EACH`` times as many clean rows, those whose ids hash lowest.

    Held-out rows take no part.  Texts are taken whole, as many as stay below ``sample_chars``
    characters in all, one toxic text and its clean ones at a time.  Rows without text, or without a label of 0 or 1, are left out.
    """
    rated = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(
        F.col("doc_id").alias("rated"), F.col("toxic").alias("y"), F.xxhash64("doc_id").alias("h")
    )
    parts = []
    for y, each in ((1, 1), (0, CLEAN_FOR_EACH)):
        first = rated.filter(F.col("y") == y).orderBy("h", "rated").limit(sample * each)
        place = F.row_number().over(Window.orderBy("h", "rated")) - 1  # of the bounded rows
        parts.append(first.withColumn("nth", F.floor(place / each)))
    chosen = parts[0].unionAll(parts[1])
    rows = (
        docs.filter("text IS NOT NULL")
        .select(F.col("doc_id").alias("_rated"), "text")
        .join(F.broadcast(chosen), F.col("_rated") == F.col("rated"))  # at most four times ``sample`` rows of four numbers
        .select("y", "nth", "rated", F.xxhash64("text").alias("t"), F.length("text").alias("n"), "text")
    )
    # The sizes of the sample's rows, not their texts, are summed up in order.
    order = ("nth", "y", "rated", "t")
    so_far = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sizes = rows.select(*order, "n").withColumn("so_far", so_far).filter(F.col("so_far") <= sample_chars)
    last = sizes.agg(F.max(F.struct(*order)).alias("m")).first().m
    if last is None:
        return fit([], np.zeros(0))
    bound = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, last)])
    found = rows.filter(F.struct(*order) <= bound).orderBy(*order).select("y", "text").collect()
    return fit([r.text for r in found], np.array([r.y for r in found], np.int64))


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null text counts as empty, and an empty one has the score of a text without words.  Rows without
    doc_id stay and are not held out, repeated rows are scored each, an empty table gives no
    rows; other columns are not read.  Very long texts are hashed ``RUN_CHARS`` characters at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # fixed size

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        m = ToxicityModel(weights.astype(np.float64), bias)
        for texts in batches:
            yield pd.Series(m.scores(texts.tolist()))

    scored = docs.select("doc_id", held_out().alias("held_out"), score(full_text()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the labels that are not held out, and scores every row of ``docs``."""
    return toxicity_scores(docs, fit_on(docs, labels, sample))
