"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A file holds the ids of consecutive documents back to back (little-endian, two bytes each if the
vocabulary has at most 65,536 ids, else four), then
two Elias-Fano sequences: where each document ends, and which document it is.  A sequence of n
ascending numbers up to u takes about n (2 + log2(u / n)) bits: the low bits packed as they are,
the high bits as unary gaps in a bit vector.  Every 256th one of the vector has its position
stored, so any boundary is found by reading a few words, without a table of offsets.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearwave.llm.common import full_text, per_process, row_runs
from nearwave.llm.files import new_file, open_folder
from nearwave.workdir import new_folder

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"IDSEF001"
SELECT_STEP = 256
HEADER = "<QQqQQ"  # numbers, universe, base, low bits of each, bytes of the high bits
TRAILER = "<8sQQQQQ"  # magic, ids, bytes of an id, documents without a key, bytes of both sequences


class EliasFano:
    """Ascending whole numbers, stored relative to the first one's base."""

    def __init__(self, n: int, universe: int, base: int, low: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray):
        self.n, self.universe, self.base, self.low = n, universe, base, low
        self.lows, self.highs, self.ones = lows, highs, ones

    @classmethod
    def of(cls, values: np.ndarray, base: int = 0) -> EliasFano:
        """``values``: ascending int64; ``base``: at most the first of them."""
        n = len(values)
        above = values.astype(np.int64).view(np.uint64) - np.array(base, np.int64).view(np.uint64)
        universe = int(above[-1]) if n else 0
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        lows = np.zeros(0, np.uint8)
        if n and low:
            kept = (above & np.uint64((1 << low) - 1))[:, None] >> np.arange(low, dtype=np.uint64)
            lows = np.packbits((kept & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (above >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        highs = np.packbits(bits, bitorder="little")
        return cls(n, universe, base, low, lows, highs, places[::SELECT_STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack(HEADER, self.n, self.universe, self.base, self.low, len(self.highs))
        return head + self.lows.tobytes() + self.highs.tobytes() + self.ones.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, base, low, n_highs = struct.unpack_from(HEADER, data)
        at = struct.calcsize(HEADER)
        n_lows = (n * low + 7) // 8
        lows = np.frombuffer(data, np.uint8, n_lows, at)
        highs = np.frombuffer(data, np.uint8, n_highs, at + n_lows)
        ones = np.frombuffer(data, "<u4", -(-n // SELECT_STEP), at + n_lows + n_highs)
        return cls(n, universe, base, low, lows, highs, ones)

    def __getitem__(self, i: int) -> int:
        """The i-th number, from the bytes around it alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.ones[i // SELECT_STEP]), i % SELECT_STEP
        byte = place // 8
        word = int(self.highs[byte]) >> (place % 8) << (place % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        first, last = i * self.low, (i + 1) * self.low
        rest = int.from_bytes(self.lows[first // 8 : (last + 7) // 8].tobytes(), "little") >> (first % 8)
        return self.base + ((place - i) << self.low | rest & ((1 << self.low) - 1))

    def all(self) -> np.ndarray:
        """Every number, as int64."""
        places = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n].astype(np.uint64)
        above = (places - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        if self.low and self.n:
            bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            for k in range(self.low):
                above |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return (above + np.array(self.base, np.int64).view(np.uint64)).view(np.int64)


class WordEncoder:
    """Ids of whole texts, word by word.

    The tokenizer's own rules never join what white space separates, so a text has the ids of
    its words in turn, and a word that was seen before need not be encoded again.  A mark after
    letters or digits is a token of its own by the same rules.  Only A-Z are lowered here (the
    tokenizer lowers all); its special strings are found before it lowers, so a text that holds
    one keeps its case.

    Known words are numbered; their ids lie back to back in one array, from which a text's are gathered.
    When there are too many words, those met in one run of texts only are forgotten.
    """

    MAX_WORDS = 600_000
    MARKS = b".,;:!?"
    #: The tokenizer's own parts of a word, so that many words can be encoded in one string.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.IGNORECASE)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.type = np.dtype("<u2" if len(self.ends_word) <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.size, self.runs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.type)

    def _encoded(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in another order, how many ids each has, and the ids back to back."""
        texts = b"\n".join(words).decode().split("\n")
        special = re.compile("|".join(map(re.escape, self.special)) or "(?!)", re.IGNORECASE)
        done: list[bytes] = []
        sizes, flat = [], []
        # Words of letters are one part each; of others the parts are counted.
        letters = [(w, t, 1) for w, t in zip(words, texts) if t.isalpha()]
        others = [(w, t, len(self.PARTS.findall(t))) for w, t in zip(words, texts) if not t.isalpha()]
        alone = [row for row in others if not row[2] or special.search(row[1])]
        others = [row for row in others if row[2] and not special.search(row[1])]
        for group in (letters, others):
            for start in range(0, len(group), 1000):
                part, texts, n = zip(*group[start : start + 1000])
                encoded = self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0]
                ids = np.array(encoded.ids, self.type)
                ends = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)
                last = np.cumsum(n)
                if len(ends) != last[-1] + 1:
                    alone += group[start : start + 1000]
                    continue
                done += part
                sizes.append(np.diff(ends[np.append(0, last)]))
                flat.append(ids)
        for start in range(0, len(alone), 20_000):
            part, texts, _ = zip(*alone[start : start + 20_000])
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]
            done += part
            sizes.append(np.array(list(map(len, ids)), np.int64))
            flat.append(np.array(list(chain.from_iterable(ids)), self.type))
        return done, np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, self.type), *flat])

    def _learn(self, words: list[bytes]) -> None:
        marked = [len(w) > 1 and w[-1] in self.MARKS and w[:-1].isalnum() for w in words]
        parts = [part for w, m in zip(words, marked) for part in ((w[:-1], w[-1:]) if m else (w,))]
        done, sizes, flat = self._encoded(sorted(set(parts) - {b""}))
        done.append(b"")
        sizes = np.append(sizes, 0)
        place = dict(zip(done, range(len(done))))
        at = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
        size = sizes[at]
        ends = np.cumsum(size)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - size), size) + np.arange(size.sum())]
        first = np.cumsum(1 + np.array(marked, np.int64)) - 1 - np.array(marked, np.int64)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.size = np.concatenate([self.size, np.add.reduceat(size, first)])
        self.runs = np.concatenate([self.runs, np.zeros(len(words), np.int64)])
        self.flat = np.concatenate([self.flat, ids])

    def _make_room(self, n_new: int) -> None:
        """Forgets words met in few runs until at most half the room is taken."""
        if len(self.number) + n_new <= self.MAX_WORDS:
            return
        least = 2
        while (kept := self.runs >= least).sum() + n_new > self.MAX_WORDS // 2 and kept.any():
            least *= 2
        self.flat = self.flat[np.repeat(kept, self.size)]
        words = [w for w, k in zip(self.number, kept.tolist()) if k]
        self.number = dict(zip(words, range(len(words))))
        self.size, self.runs = self.size[kept], self.runs[kept] // 2

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of an array of ``type``."""
        flat, lengths = self.encode_flat(texts)
        ends = np.append(0, np.cumsum(lengths)).tolist()
        return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts back to back, and how many each has."""
        rows = pa.array(texts, pa.large_string())
        lowered = pc.ascii_lower(rows)
        cased = np.zeros(len(texts), bool)
        for special in self.special:
            cased |= pc.match_substring(lowered, special).to_numpy(zero_copy_only=False)
        if cased.any():
            lowered = pc.if_else(pa.array(cased), rows, lowered)
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > self.MAX_WORDS:
            self._make_room(len(new))
            new = [w for w in words if w not in self.number]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.runs[numbers] += 1
        starts = np.cumsum(self.size) - self.size
        codes = coded.indices.to_numpy(zero_copy_only=False)
        size = self.size[numbers][codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(starts[numbers][codes] - ends[:-1], size) + np.arange(ends[-1])]
        return flat, np.diff(ends[np.asarray(split.offsets)])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` in ascending doc_id order; returns the files (part, file, n_docs, n_ids).

    Files follow each other by ``part``.  Every document ends with ``end_id``.  Null texts are
    empty, rows without doc_id come first, rows with one doc_id are ordered by a hash of the text.
    """
    rows = docs.select("doc_id", full_text().alias("text"), F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        ends: list[np.ndarray] = []
        keys: list[int] = []
        total = without_key = 0
        out = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in row_runs(list(map(len, texts)), 4_000_000):
                if encoder is None:
                    encoder = per_process(f"words of {tokenizer}", lambda: WordEncoder(tokenizer))
                    system, path, name = new_file(folder, "ids", ".bin")
                    out = system.open_output_stream(path)
                flat, lengths = encoder.encode_flat(texts[i:j])
                stops = np.cumsum(lengths)
                out.write(np.insert(flat, stops, encoder.type.type(end_id)).tobytes())
                ends.append(total + stops + np.arange(1, j - i + 1))
                total += len(flat) + j - i
                without_key += sum(k is None for k in ids[i:j])
                keys += [k for k in ids[i:j] if k is not None]
        if out is None:
            return
        n_docs = sum(map(len, ends))
        boundaries = EliasFano.of(np.concatenate(ends)).to_bytes()
        numbers = EliasFano.of(np.array(keys, np.int64), keys[0] if keys else 0).to_bytes()
        out.write(boundaries)
        out.write(numbers)
        out.write(struct.pack(TRAILER, MAGIC, total, encoder.type.itemsize, without_key, len(boundaries), len(numbers)))
        out.close()
        yield pa.RecordBatch.from_pylist(
            [{"part": TaskContext.get().partitionId(), "file": name, "n_docs": n_docs, "n_ids": total}], schema=schema
        )

    return ordered.mapInArrow(write, "part int, file string, n_docs long, n_ids long")


class TokenFile:
    """Random access to one file: boundaries are held encoded, ids are read by range."""

    def __init__(self, folder: str, name: str):
        system, path = open_folder(folder)
        self.source = system.open_input_file(f"{path}/{name}")
        size = self.source.size()
        n_trailer = struct.calcsize(TRAILER)
        magic, self.n_ids, self.width, self.without_key, n_bounds, n_keys = struct.unpack(
            TRAILER, self.source.read_at(n_trailer, size - n_trailer)
        )
        if magic != MAGIC:
            raise ValueError(f"{name} is no token file")
        tail = self.source.read_at(n_bounds + n_keys, self.n_ids * self.width)
        self.ends = EliasFano.from_bytes(tail[:n_bounds])
        self.keys = EliasFano.from_bytes(tail[n_bounds:])

    def __len__(self) -> int:
        return self.ends.n

    def _read(self, start: int, stop: int) -> np.ndarray:
        data = self.source.read_at((stop - start) * self.width, start * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        return self._read(self.ends[i - 1] if i else 0, self.ends[i])

    def documents(self, block: int = 4_000_000) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """Runs of documents: their keys, their ends in the file, and their ids back to back."""
        ends = self.ends.all()
        keys = [None] * self.without_key + self.keys.all().tolist()
        i = start = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, start + block, "right")))
            stop = int(ends[j - 1])
            yield keys[i:j], ends[i:j], self._read(start, stop)
            i, start = j, stop


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the ``files``: doc_id, start, n_tokens and the CRC-32 of its ids.

    ``start`` counts the ids of all documents before it, over all files.
    """
    # One row for each file: the window orders file sizes, never documents.
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    n_files = max(1, files.count())
    placed = files.select("part", "file", F.coalesce(before, F.lit(0)).alias("before"))
    placed = placed.repartitionByRange(n_files, "part").select("file", "before")  # a task for each file
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                last = 0
                for keys, ends, ids in TokenFile(folder, name).documents():
                    starts = np.concatenate([[last], ends[:-1]])
                    crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts - last, ends - last)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(starts + offset), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                        schema=schema,
                    )
                    last = int(ends[-1])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """Writes the token files of ``docs`` and reads them back, one row per row of ``docs``.

    An empty table writes no file and gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    written = write_token_files(docs, f"{folder}/ids", public_tokenizers.path(tokenizer_file))
    written.write.parquet(f"{folder}/files")
    return read_token_files(spark.read.parquet(f"{folder}/files"), f"{folder}/ids")
