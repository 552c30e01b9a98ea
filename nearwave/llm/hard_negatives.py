"""Hard negatives: candidates in Hilbert-ordered Parquet blocks, chosen by interval arithmetic.

All vectors are stored as Parquet files whose row groups are blocks of neighbours on a Hilbert curve over
the leading principal axes.  A block's zone map has the least and greatest value of each dimension, the
range of its labels and its smallest id.  For an anchor, interval arithmetic over the zone map bounds every
inner product with the block from both sides, so a block is read only if it may hold a better positive, or a
better negative in one of the anchor's score windows.  Bounds are exact whole numbers: nothing is lost.

Anchors are dealt to tasks along the same curve; a task takes a pack of them past the zone maps, most
promising block first, and keeps a short list for each.  Zone maps travel in groups of a bounded size; more
groups are more passes, whose lists are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwave.functions.arrow import flat_lists
from nearwave.llm.files import new_file, open_folder
from nearwave.workdir import new_folder

BLOCK_ROWS = 1024
#: Anchors that a task compares at a time, at most.
PACK = 256
#: Axes of the curve, and bits of each: together below 63.
AXES, AXIS_BITS = 8, 7
#: Values of the sampled vectors from which the axes are found; it decides the order of blocks, not what is in them.
SAMPLE_VALUES, SAMPLE_ROWS = 1 << 20, 4096
#: Bytes of zone maps that travel with the tasks at a time.
ZONE_BYTES = 1 << 24
OPEN_FILES = 32

EVERY, N_POSITIVES, N_NEGATIVES = 100, 5, 10
#: A negative scores between these hundredths of its positive.
LEAST, MOST = 30, 90
MOVED_EVERY, N_LABELS = 7, 10
SCALE = 256

_ROWS = "vec_id long, label int, q array<long>, key long"
_ZONES = "file string, block int, first_id long, label_lo int, label_hi int, low binary, high binary"
_POSITIVES = "anchor_id long, positive_id long, score long"
_NEGATIVES = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): rows that take part, in whole numbers, with the labels that are moved."""
    infinity = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))
    rows = vectors.select("vec_id", "label", "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    )
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % N_LABELS).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    rows = rows.select(F.col("vec_id").cast("long"), moved.cast("int").alias("label"), whole.alias("q"))
    repeated = rows.groupBy("vec_id").count().filter("count > 1").limit(1).count()
    if repeated:
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")
    return rows


def hilbert_keys(codes: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates (row, axis) below 2^bits."""
    axes = [codes[:, i].astype(np.int64) for i in range(codes.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            # Set: the lower half is mirrored on the first axis.  Not set: it trades places with it.
            mirrored = (axis & bit) != 0
            traded = np.where(mirrored, 0, (axes[0] ^ axis) & below)
            axes[0] = axes[0] ^ np.where(mirrored, below, traded)
            if i:
                axes[i] = axis ^ traded
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turned = np.zeros(len(codes), np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    keys = np.zeros(len(codes), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            keys = keys << 1 | ((axis ^ turned) >> level) & 1
    return keys


@dataclass
class Space:
    """What is known of all vectors: how long, how large, and the curve's axes over them."""

    dims: int
    largest: int
    """Components are cut to plus and minus this, so that every inner product fits in 64 bits."""
    exact: type
    """The number type of inner products: doubles while they are whole below 2^53."""
    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def matrix(self, lists: pa.ListArray) -> np.ndarray:
        """(row, dimension); missing components of shorter vectors are zero."""
        flat, offsets = flat_lists(lists, np.int64)
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), self.dims), np.int64)
        out[np.arange(self.dims)[None, :] < lengths[:, None]] = np.clip(flat, -self.largest, self.largest)
        return out

    def keys(self, matrix: np.ndarray) -> np.ndarray:
        span = np.where(self.high > self.low, self.high - self.low, 1.0)
        codes = (matrix @ self.axes - self.low) / span * (1 << AXIS_BITS)
        return hilbert_keys(np.clip(codes, 0, (1 << AXIS_BITS) - 1).astype(np.int64), AXIS_BITS)


def space_of(rows: DataFrame) -> Space:
    """Sizes over all rows; axes from a bounded sample of them, chosen by a hash of the id."""
    size = rows.agg(
        F.max(F.size("q")).alias("dims"), F.max(F.array_max(F.transform("q", lambda x: F.abs(x)))).alias("largest")
    ).first()
    dims = max(1, size.dims or 1)
    most = math.isqrt(2**62 // dims)
    largest = min(size.largest or 0, most)
    exact = np.float64 if largest**2 * dims < 2**53 else np.int64
    space = Space(dims, max(1, largest), exact, np.zeros((dims, AXES)), np.zeros(AXES), np.ones(AXES))
    n = min(SAMPLE_ROWS, max(2 * AXES, SAMPLE_VALUES // dims))
    sample = rows.select("q", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(n).select("q").toArrow()
    if sample.num_rows:
        matrix = space.matrix(sample.column("q").combine_chunks()).astype(np.float64)
        _, _, axes = np.linalg.svd(matrix - matrix.mean(axis=0), full_matrices=False)
        space.axes[:, : min(AXES, len(axes))] = axes[:AXES].T
        along = matrix @ space.axes
        space.low, space.high = along.min(axis=0), along.max(axis=0)
    return space


def with_keys(rows: DataFrame, space: Space) -> DataFrame:
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = space.keys(space.matrix(batch.column(2)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["vec_id", "label", "q", "key"])

    return rows.mapInArrow(key, _ROWS)


def write_blocks(keyed: DataFrame, space: Space, folder: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Writes files of blocks in the curve's order; returns their zone maps, a row for each block."""
    ordered = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("values", pa.binary(8 * space.dims))])
    zones = pa.schema(
        [("file", pa.string()), ("block", pa.int32()), ("first_id", pa.int64()), ("label_lo", pa.int32())]
        + [("label_hi", pa.int32()), ("low", pa.binary()), ("high", pa.binary())]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block_rows:
                table = pa.Table.from_batches(held)
                yield table.slice(0, block_rows)
                held, n = table.slice(block_rows).to_batches(), n - block_rows
        if n:
            yield pa.Table.from_batches(held)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made = None, []
        for i, block in enumerate(blocks(batches)):
            if writer is None:
                system, path, name = new_file(folder, "blocks", ".parquet")
                stream = system.open_output_stream(path)
                writer = pq.ParquetWriter(stream, schema, compression="zstd", write_statistics=False)
            ids, labels = block.column("vec_id").combine_chunks(), block.column("label").combine_chunks()
            matrix = space.matrix(block.column("q").combine_chunks())
            values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * space.dims), len(matrix), [None, pa.py_buffer(matrix)])
            writer.write_table(pa.table([ids, labels, values], schema=schema), row_group_size=len(matrix))
            made.append(
                {
                    "file": name,
                    "block": i,
                    "first_id": ids.to_numpy().min(),
                    "label_lo": labels.to_numpy().min(),
                    "label_hi": labels.to_numpy().max(),
                    "low": matrix.min(axis=0).tobytes(),
                    "high": matrix.max(axis=0).tobytes(),
                }
            )
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist(made, zones)

    return ordered.mapInArrow(write, _ZONES)


@dataclass
class ZoneMaps:
    """Zone maps of some blocks, and the way to read those blocks."""

    folder: str
    space: Space
    files: list[str]
    blocks: np.ndarray
    first_id: np.ndarray
    label_lo: np.ndarray
    label_hi: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, folder: str, space: Space, rows: list) -> ZoneMaps:
        ends = [np.frombuffer(b"".join(bytes(r[c]) for r in rows), np.int64).reshape(-1, space.dims) for c in ("low", "high")]
        numbers = [np.array([r[c] for r in rows], np.int64) for c in ("block", "first_id", "label_lo", "label_hi")]
        return cls(folder, space, [r.file for r in rows], *numbers, *[e.astype(space.exact) for e in ends])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, block): least and greatest inner product that the block's box allows."""
        above, below = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return above @ self.low.T + below @ self.high.T, above @ self.high.T + below @ self.low.T

    def reader(self) -> Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Reads a block by its place here: ids, labels and values."""
        system, path = open_folder(self.folder)

        @lru_cache(OPEN_FILES)
        def opened(name: str) -> pq.ParquetFile:
            return pq.ParquetFile(system.open_input_file(f"{path}/{name}"))

        def read(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            table = opened(self.files[at]).read_row_group(int(self.blocks[at]), use_threads=False)
            ids, labels, values = (c.combine_chunks() for c in table.columns)
            data = np.frombuffer(values.buffers()[1], np.int64).reshape(-1, self.space.dims)[: len(ids)]
            return ids.to_numpy(), labels.to_numpy(), data.astype(self.space.exact)

        return read


class BestLists:
    """The k best (score, id) of each of n lists: highest score first, then smallest id."""

    def __init__(self, n: int, k: int, kind: type):
        self.k = k
        self.none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        self.score = np.full((n, k), self.none, kind)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def may_enter(self, score: np.ndarray, first_id: int) -> np.ndarray:
        """Whether a row of at most this score and at least this id could enter each list."""
        last, last_id = self.score[:, -1], self.id[:, -1]
        return (score > last) | ((score == last) & (first_id < last_id))

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(at)
        row = np.concatenate([np.repeat(touched, self.k), at])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        # Lists are short of k rows only while they hold fillers, which come last.
        order = np.lexsort((ids, -score if self.score.dtype == np.float64 else ~score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.score[row[kept], place[kept]] = score[kept]
        self.id[row[kept], place[kept]] = ids[kept]


def nearest_of_label(zones: ZoneMaps, read: Callable, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, k: int) -> BestLists:
    """The k best other rows of each anchor's own label."""
    best = BestLists(len(ids), k, zones.space.exact)
    _, upper = zones.bounds(values)
    has_label = (zones.label_lo[None, :] <= labels[:, None]) & (labels[:, None] <= zones.label_hi[None, :])
    upper = np.where(has_label, upper, best.none)
    for at in np.argsort(-upper.max(axis=0), kind="stable"):
        asked = np.flatnonzero(best.may_enter(upper[:, at], zones.first_id[at]) & has_label[:, at])
        if len(asked):
            found, found_labels, matrix = read(at)
            scores = values[asked] @ matrix.T
            fits = (found_labels[None, :] == labels[asked, None]) & (found[None, :] != ids[asked, None])
            a, b = np.nonzero(fits & (scores >= best.score[asked, -1][:, None]))
            best.add(asked[a], scores[a, b], found[b])
    return best


def windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score a negative of each positive score may have."""
    hundreds, left = scores // 100, scores % 100
    return LEAST * hundreds - (-LEAST * left // 100), MOST * hundreds + MOST * left // 100


def best_in_windows(
    zones: ZoneMaps, read: Callable, labels: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
) -> BestLists:
    """Per anchor and window [low, high] the k best rows of other labels; list a * windows + w."""
    n, n_windows = low.shape
    best = BestLists(n * n_windows, k, zones.space.exact)
    least, upper = zones.bounds(values)
    differs = (zones.label_lo != zones.label_hi)[None, :] | (zones.label_lo[None, :] != labels[:, None])
    wanted = low <= high
    for at in np.argsort(-upper.max(axis=0), kind="stable"):
        may = best.may_enter(np.repeat(upper[:, at], n_windows), zones.first_id[at]).reshape(n, n_windows)
        may &= wanted & differs[:, at, None] & (upper[:, at, None] >= low) & (least[:, at, None] <= high)
        asked = np.flatnonzero(may.any(axis=1))
        if not len(asked):
            continue
        found, found_labels, matrix = read(at)
        scores = values[asked] @ matrix.T
        other = found_labels[None, :] != labels[asked, None]
        for w in range(n_windows):
            lists = asked * n_windows + w
            floor = np.maximum(low[asked, w], best.score[lists, -1])
            a, b = np.nonzero(other & (scores >= floor[:, None]) & (scores <= high[asked, w][:, None]))
            if len(a):
                best.add(lists[a], scores[a, b], found[b])
    return best


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for start in range(0, batch.num_rows, PACK):
            yield pa.Table.from_batches([batch.slice(start, PACK)])


def _columns(space: Space, pack: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (pack.column(c).to_numpy() for c in ("vec_id", "label"))
    return ids, labels, space.matrix(pack.column("q").combine_chunks()).astype(space.exact)


def find_positives(anchors: DataFrame, zones: ZoneMaps, k: int) -> DataFrame:
    """(anchor_id, positive_id, score): the k best of the given blocks for each anchor."""
    shared = anchors.sparkSession.sparkContext.broadcast(zones)  # ``ZONE_BYTES`` at most

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        read = maps.reader()
        for pack in _packs(batches):
            ids, labels, values = _columns(maps.space, pack)
            best = nearest_of_label(maps, read, ids, labels, values, k)
            a, b = np.nonzero(best.score > best.none)
            columns = ids[a], best.id[a, b], best.score[a, b].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "score"])

    return anchors.mapInArrow(search, _POSITIVES)


def find_negatives(anchors: DataFrame, zones: ZoneMaps, n_positives: int, k: int) -> DataFrame:
    """The k best rows of the given blocks in each window; ``anchors`` have arrays ``positives`` (id, score)."""
    shared = anchors.sparkSession.sparkContext.broadcast(zones)  # ``ZONE_BYTES`` at most

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        read = maps.reader()
        for pack in _packs(batches):
            ids, labels, values = _columns(maps.space, pack)
            given = pack.column("positives").combine_chunks()
            offsets = np.asarray(given.offsets, np.int64)
            offsets -= offsets[0]
            row = np.repeat(np.arange(len(ids)), np.diff(offsets))
            place = np.arange(len(row)) - offsets[row]
            p_id, p_score = (c.to_numpy() for c in given.flatten().flatten())
            positive, score = np.zeros((2, len(ids), n_positives), np.int64)
            low, high = np.ones((len(ids), n_positives), np.int64), np.zeros((len(ids), n_positives), np.int64)
            positive[row, place], score[row, place] = p_id, p_score
            low[row, place], high[row, place] = windows(p_score)
            best = best_in_windows(maps, read, labels, values, low, high, k)
            at, b = np.nonzero(best.score > best.none)
            a, w = at // n_positives, at % n_positives
            columns = ids[a], positive[a, w], best.id[at, b], score[a, w], best.score[at, b].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns],
                names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
            )

    return anchors.mapInArrow(search, _NEGATIVES)


def first_of(rows: DataFrame, by: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first k rows of each group, with their ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    n_positives: int = N_POSITIVES,
    n_negatives: int = N_NEGATIVES,
    block_rows: int = BLOCK_ROWS,
    zone_bytes: int = ZONE_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    Anchors are the rows whose vec_id is divisible by 100.  Rows without vec_id or label, and those
    whose vector is null or has a component that is null or not finite, take no part.  Of rows that share a vec_id
    the one of least (label, vector) counts.  Shorter vectors end in zeros.  Components are cut where inner
    products would not fit in 64 bits (for 64 dimensions at 2^28).  A positive score
    below zero has no negatives, one of zero those of score zero.  Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    folder = new_folder(spark, "negatives")
    rows = usable(vectors)
    space = space_of(rows)
    keyed = with_keys(rows, space)
    write_blocks(keyed, space, f"{folder}/blocks", block_rows).write.parquet(f"{folder}/zones")
    zones = spark.read.schema(_ZONES).parquet(f"{folder}/zones")
    n_zones = zones.count()
    if not n_zones:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n_groups = math.ceil(n_zones * (16 * space.dims + 64) / zone_bytes)
    # Blocks of a file stay together: their order in it tells the place on the curve.
    group = F.pmod(F.xxhash64("file", F.floor(F.col("block") / 64)), F.lit(n_groups))

    anchors = keyed.filter(F.col("vec_id") % EVERY == 0)
    n_anchors = rows.filter(F.col("vec_id") % EVERY == 0).count()
    n_tasks = max(1, math.ceil(n_anchors / PACK), min(n_anchors // 8, 4 * spark.sparkContext.defaultParallelism))

    def over_zones(asked: DataFrame, search: Callable[[DataFrame, ZoneMaps], DataFrame]) -> DataFrame:
        dealt = asked.repartitionByRange(n_tasks, "key", "vec_id").sortWithinPartitions("key", "vec_id")
        found = []
        for i in range(n_groups):
            maps = zones.filter(group == i).orderBy("file", "block").collect()  # ``zone_bytes``, about
            if maps:
                found.append(search(dealt, ZoneMaps.of(f"{folder}/blocks", space, maps)))
        return reduce(DataFrame.unionAll, found)

    found = over_zones(anchors, lambda asked, maps: find_positives(asked, maps, n_positives))
    first_of(found, ["anchor_id"], [F.desc("score"), "positive_id"], n_positives).write.parquet(f"{folder}/positives")
    # At most ``n_positives`` rows of an anchor.
    listed = (
        spark.read.parquet(f"{folder}/positives")
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("p"))
        .select("anchor_id", F.transform("p", lambda x: F.struct(x.positive_id.alias("id"), x.score.alias("score"))).alias("positives"))
    )
    asked = anchors.join(listed, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "q", "key", "positives")
    found = over_zones(asked, lambda dealt, maps: find_negatives(dealt, maps, n_positives, n_negatives))
    ranked = first_of(found, ["anchor_id", "positive_id"], [F.desc("negative_score"), "negative_id"], n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
