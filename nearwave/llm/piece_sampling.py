"""SentencePiece ids by sampling a segmentation, and back to text.

A text is a lattice: its edges are the pieces that match at a place, its paths the
segmentations.  A path's weight is the product of its pieces' weights, exp(theta * score).
Forward filtering sums the weights of all paths to each place; backward sampling then walks
from the end, each time drawing one of the pieces that end there in proportion to the paths it
continues.  The draw at a place is a hash of (seed, row key, place), so a row has the same
segmentation however the rows are batched or retried.

No piece reaches from other text into a space, or across a line end, so the lattice falls apart
at words: each different word of a batch is filtered once, all its occurrences are drawn
together.  Characters without a piece of their own become their UTF-8 bytes, as does U+2581,
which the piece list uses for the space: decoding gives back every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwave.llm.common import per_process, row_runs

MODEL_FILE = "piece_bpe_32k.model"
#: Scores are minus the rank of a merge; at this scale one step of 1000 ranks costs a factor e.
THETA = 0.001
SEED = 17
#: Characters whose lattices are held at a time.
RUN_CHARS = 500_000
#: Bits of a draw.
DRAW_BITS = 32
SPACE = "▁"
_WORDS = re.compile(r" +[^ \n]*|\n+|[^ \n]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Pieces:
    """The piece list as a trie in arrays: (node, character) -> node, node -> piece."""

    def __init__(self, path: str, theta: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.strings: dict[int, bytes] = {}
        node_of: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        scores = []
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.strings[i] = bytes([int(text[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                node = 0
                plain = text.replace(SPACE, " ")
                for c in map(ord, plain):
                    node = node_of.setdefault((node, c), len(piece_at))
                    if node == len(piece_at):
                        piece_at.append(-1)
                piece_at[node] = i
                self.strings[i] = plain.encode()
                scores.append(model.get_score(i))
        self.piece_at = np.array(piece_at, np.int32)
        keys = np.array([(n << 21) | c for n, c in node_of], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(node_of.values(), np.int64)[order]
        low = min((s for s in scores if s > -1e8), default=0.0)
        weights = np.zeros(size)
        for i in self.strings:
            weights[i] = theta * max(model.get_score(i), low)
        self.weights = weights
        self.fallback = theta * (low - 10_000.0)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where the trie has none."""
        wanted = (nodes << 21) | chars
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.nodes[at], -1)


class Lattices:
    """The filtered lattices of many words; places are numbered over all of them.

    Word w has the places first[w] .. first[w] + length[w].  Edges are sorted by the place
    where they end; ``cumulative`` is, at each edge, the place's number and, in its low bits, the
    share of the paths to it that come by this edge or an earlier one.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        word_of = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(chars)) + word_of  # the place before each character
        last = (first + length)[word_of]
        self.first, self.length = first, length

        begin, end, piece = [], [], []
        alive, node, at = place, np.zeros(len(chars), np.int64), np.arange(len(chars))
        lone = np.ones(len(chars), bool)
        for step in range(1, 1 << 20):
            node = pieces.step(node, chars[at + step - 1])
            good = node >= 0
            alive, node, at = alive[good], node[good], at[good]
            found = pieces.piece_at[node]
            full = found >= 0
            begin.append(alive[full])
            end.append(alive[full] + step)
            piece.append(found[full])
            if step == 1:
                lone[at[full]] = False
            more = alive + step < last[at]
            alive, node, at = alive[more], node[more], at[more]
            if not len(alive):
                break
        # A character without a piece goes by an edge of its own: -1 - its code point.
        begin.append(place[lone])
        end.append(place[lone] + 1)
        piece.append((-1 - chars[lone]).astype(np.int32))
        begin, end, piece = np.concatenate(begin), np.concatenate(end), np.concatenate(piece)
        order = np.argsort(end, kind="stable")
        self.begin, self.piece = begin[order], piece[order]
        end = end[order]
        weight = np.where(self.piece >= 0, pieces.weights[np.maximum(self.piece, 0)], pieces.fallback)

        # Forward filtering, all words at once: first the places one character in, then two, ...
        n_places = int(first[-1] + length[-1] + 1) if len(words) else 0
        total = np.zeros(n_places)  # logarithm of the summed weights of all paths to a place
        n_edges = np.bincount(end, minlength=n_places)
        edge0 = np.concatenate([[0], np.cumsum(n_edges)[:-1]])
        self.edge0, self.n_edges = edge0, n_edges
        depth_order = np.argsort(-length, kind="stable")
        sorted_length = -length[depth_order]
        share = np.zeros(len(end))
        for depth in range(1, int(length.max(initial=0)) + 1):
            here = first[depth_order[: np.searchsorted(sorted_length, -depth, "right")]] + depth
            count = n_edges[here]
            heads = np.concatenate([[0], np.cumsum(count)[:-1]])
            edges = np.arange(int(count.sum())) + np.repeat(edge0[here] - heads, count)
            logs = total[self.begin[edges]] + weight[edges]
            most = np.maximum.reduceat(logs, heads)
            parts = np.exp(logs - np.repeat(most, count))
            sums = np.add.reduceat(parts, heads)
            total[here] = most + np.log(sums)
            share[edges] = parts / np.repeat(sums, count)
        # Shares add up place by place, so that no sum depends on which other words are here.
        rank = np.arange(len(end)) - edge0[end]
        for k in range(1, int(rank.max(initial=0)) + 1):
            later = np.flatnonzero(rank == k)
            share[later] += share[later - 1]
        self.cumulative = (end << DRAW_BITS) + np.floor(share * (1 << DRAW_BITS)).astype(np.int64)
        self.total = total

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge that ends at each place, for whole numbers u below 2^DRAW_BITS."""
        edge = np.searchsorted(self.cumulative, (place << DRAW_BITS) + u, "right")
        return np.minimum(edge, self.edge0[place] + self.n_edges[place] - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit numbers (the splitmix64 finisher)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def encode(texts: list[str], keys: np.ndarray, pieces: Pieces, seed: int) -> list[np.ndarray]:
    """Ids of each text (int32), drawn with its key."""
    number: dict[str, int] = {}
    counts, found = [], []
    for text in texts:
        # One space goes before a text, as the piece list expects; an empty text has no ids.
        words = _WORDS.findall(" " + text) if text else []
        found += [number.setdefault(w, len(number)) for w in words]
        counts.append(len(words))
    if not found:
        return [np.zeros(0, np.int32) for _ in texts]
    lattices = Lattices(list(number), pieces)
    word = np.array(found, np.int64)
    counts = np.array(counts)
    text_of = np.repeat(np.arange(len(texts)), counts)
    length = lattices.length[word]
    ends = np.cumsum(length)
    text_start = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)[:-1]])]
    offset = ends - length - text_start[text_of] - lattices.first[word]  # a place's number in its text
    row_hash = _mixed(keys.view(np.uint64) ^ _mixed(np.array([seed], np.uint64)))[text_of]

    place = lattices.first[word] + length
    active = np.arange(len(word))
    steps = np.zeros(len(word), np.int64)
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    while len(active):
        at = place[active]
        u = _mixed(row_hash[active] + (at + offset[active]).astype(np.uint64) * _MIX[0])
        edge = lattices.draw(at, (u >> np.uint64(64 - DRAW_BITS)).astype(np.int64))
        drawn.append((active, lattices.piece[edge]))
        steps[active] += 1
        place[active] = lattices.begin[edge]
        active = active[place[active] > lattices.first[word[active]]]

    stop = np.cumsum(steps)
    ids = np.empty(int(stop[-1]), np.int32)
    for k, (who, piece) in enumerate(drawn):  # the k-th draw is the k-th piece from the word's end
        ids[stop[who] - 1 - k] = piece
    per_text = np.add.reduceat(np.append(steps, 0), np.minimum(np.concatenate([[0], np.cumsum(counts)[:-1]]), len(steps)))
    per_text = np.where(counts > 0, per_text, 0)
    lone = np.flatnonzero(ids < 0)
    if len(lone):
        codes = np.array([list(chr(-1 - i).encode()) + [-1] * (4 - len(chr(-1 - i).encode())) for i in ids[lone].tolist()])
        sizes = np.ones(len(ids), np.int64)
        sizes[lone] = (codes >= 0).sum(axis=1)
        owner = np.repeat(np.repeat(np.arange(len(texts)), per_text), sizes)
        heads = np.cumsum(sizes) - sizes
        ids = np.repeat(ids, sizes)
        for k in range(4):
            has = codes[:, k] >= 0
            ids[heads[lone[has]] + k] = pieces.byte_ids[codes[has, k]]
        per_text = np.bincount(owner, minlength=len(texts))
    return np.split(ids, np.cumsum(per_text)[:-1])


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text whose pieces these are."""
    strings = pieces.strings
    return b"".join([strings[i] for i in ids.tolist()])[1:].decode()


def _encoded(keys: pa.Array, texts: pa.Array, pieces: Pieces, seed: int) -> Iterator[tuple[int, int, list[str], list]]:
    """Rows [i, j) of a batch, their texts and their ids; other rows stay in the batch."""
    numbers = keys.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    for i, j in row_runs(sizes, RUN_CHARS):
        part = [t or "" for t in texts.slice(i, j - i).to_pylist()]
        yield i, j, part, encode(part, numbers[i:j], pieces, seed)


def with_pieces(
    docs: DataFrame, key: str = "doc_id", model_file: str = MODEL_FILE, theta: float = THETA, seed: int = SEED
) -> DataFrame:
    """``docs`` with the column ``piece_ids`` (array of int): the sampled segmentation of ``text``.

    The draw depends on the seed, the row's key and the text alone: rows alike in both have the
    same ids.  A null text has null ids, an empty one an empty array; a null key draws like any
    other.  An empty table gives no rows.  A column of that name is replaced, others stay.
    """
    path = public_tokenizers.path(model_file)
    kept = [c for c in docs.columns if c != "piece_ids"]
    at = kept.index("text") + 1
    source = docs.select(F.xxhash64(key).alias("_key"), *[F.col(f"`{c}`") for c in kept])
    result = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("array<int>").alias("piece_ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = per_process(f"pieces of {path} at {theta}", lambda: Pieces(path, theta))
        for batch in batches:
            for i, j, _, ids in _encoded(batch.column(0), batch.column(at), pieces, seed):
                rows = batch.slice(i, j - i)
                ends = np.cumsum([len(x) for x in ids])
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()), mask=rows.column(at).is_null())
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], lists], names=[*kept, "piece_ids"])

    return source.mapInArrow(run, result)


def with_text(pieces: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """``pieces`` with ``decoded``: the text of ``piece_ids``, null for null."""
    path = public_tokenizers.path(model_file)

    @F.pandas_udf("string")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = per_process(f"pieces of {path} at {THETA}", lambda: Pieces(path, THETA))
        for rows in batches:
            yield pd.Series([None if ids is None else decode(ids, table) for ids in rows])

    return pieces.withColumn("decoded", of_batches("piece_ids"))


def piece_digest(docs: DataFrame, model_file: str = MODEL_FILE, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pieces, the CRC-32 of the ids (int32, little-endian) and whether
    decoding gave back the text.

    Null and empty texts have no pieces.  Rows without doc_id, repeated rows and empty tables
    are as in ``with_pieces``; other columns are not read.
    """
    path = public_tokenizers.path(model_file)
    source = docs.select(F.xxhash64("doc_id"), "text", "doc_id")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = per_process(f"pieces of {path} at {theta}", lambda: Pieces(path, theta))
        for batch in batches:
            for i, j, texts, ids in _encoded(batch.column(0), batch.column(1), pieces, seed):
                columns = [
                    batch.column(2).slice(i, j - i).cast(pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()),
                    pa.array([decode(x, pieces) == t for x, t in zip(ids, texts)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return source.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
