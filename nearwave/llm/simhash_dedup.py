"""SimHash near-duplicates by an inverted index over positional bytes.

Two 64-bit fingerprints that differ in at most three bits share at least five of their eight
bytes at the same positions.  The index has a posting list for four positional bytes at once:
of the 14 blocks of the Steiner system S(3, 4, 8) exactly one holds any three given positions,
and the complement of a block is a block, so whichever (at most) three bytes differ, one block
is free of them.  Pairs that meet in a list tally their shared positional bytes; those that
reach the minimum of five are verified by their differing bits.

Equal fingerprints are collapsed first, so a list holds different ones only.  Lists are cut
into chunks by a hash, chunk pairs are the unit of work, and each hands on a spanning forest
of the links it verified: not more rows than fingerprints it was given.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from nearwave.llm.common import full_text, unused_names
from nearwave.llm.components import components
from nearwave.workdir import new_folder

BYTES = 8
MAX_BITS = 3
MIN_SHARED = BYTES - MAX_BITS
#: Blocks of S(3, 4, 8): the sets of four positions whose numbers XOR to zero.
BLOCKS = [b for b in combinations(range(BYTES), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
SHINGLE_WORDS = 3
#: Fingerprints of a list that one task compares with as many others.
CHUNK = 2048
SEED = 42


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """SimHash over the XXH64 of word shingles; a bit is set if over half of the hashes have it."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [hash_of(joined(words), SEED)]
    else:
        hashes = [hash_of(joined(s), SEED) for s in zip(*(words[k:] for k in range(width)))]
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[start : start + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@pandas_udf(T.LongType())
def fingerprint_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's 64 bits as a signed long."""
    return docs.select("doc_id", fingerprint_of(full_text()).alias("fp"))


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the verified pairs of one list join, fewer than fingerprints."""
    values = np.unique(fps.astype(np.int64)).view(np.uint64)
    n = len(values)
    parts = values.view(np.uint8).reshape(n, BYTES)
    group = np.arange(n)
    links = []
    for i in range(n - 1):
        shared = (parts[i + 1 :] == parts[i]).sum(axis=1)  # the tally of shared positional bytes
        near = i + 1 + np.flatnonzero(shared >= MIN_SHARED)
        near = near[np.bitwise_count(values[near] ^ values[i]) <= MAX_BITS]
        near = near[group[near] != group[i]]
        _, first = np.unique(group[near], return_index=True)  # one link to each group not joined yet
        for j in near[first]:
            links.append((int(values[i].view(np.int64)), int(values[j].view(np.int64))))
            group[group == group[j]] = group[i]
    return links


def near_links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (fp, each once) that span every group.

    Whoever is within three bits is in one group of these links; not every such pair is a row.
    """
    byte = [F.shiftrightunsigned("fp", 8 * (BYTES - 1 - p)).bitwiseAND(255) for p in range(BYTES)]
    keys = [
        (F.lit(k).cast("long") * (1 << 32)) + sum((byte[p] * (1 << (8 * j)) for j, p in enumerate(block)), F.lit(0))
        for k, block in enumerate(BLOCKS)
    ]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    cut = (
        postings.join(lists, "key")
        .withColumn("chunks", F.ceil(F.col("n") / chunk))
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    )
    # Each chunk meets every chunk of its list once: (lower, upper) names the pair.
    pairs = cut.select(
        "key",
        "fp",
        "chunk",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"),
    ).select(
        "key",
        "fp",
        F.least("chunk", "other").alias("lower"),
        F.greatest("chunk", "other").alias("upper"),
    )
    gathered = pairs.groupBy("key", "lower", "upper").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            found: list[tuple[int, int]] = []
            for row in range(len(lists)):
                fps = lists[row].values.to_numpy(zero_copy_only=False)
                found += spanning_links(fps)
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())}
            )

    return gathered.select("fps").mapInArrow(spans, "a long, b long").distinct()


def near_groups(fingerprinted: DataFrame) -> DataFrame:
    """(fp, component, component_id) for each different fingerprint of ``fingerprinted`` (doc_id, fp).

    ``component`` is the smallest fingerprint of the group, ``component_id`` its smallest doc_id
    (null if it has none).
    """
    spark = fingerprinted.sparkSession
    folder = new_folder(spark, "simhash")
    fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    groups = components(near_links(distinct.select("fp")))
    grouped = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.select("fp", "component").join(least, "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and blank texts have fingerprint zero and link like any other.  Rows without doc_id
    take part; a group of such rows only has a null component_id.  Repeated rows share one
    fingerprint.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "fingerprints")
    fingerprints(docs).write.parquet(f"{folder}/all")
    rows = spark.read.parquet(f"{folder}/all")
    return rows.join(near_groups(rows), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, all columns as they were.

    The row with the smallest doc_id stays (rows without one come last); among those of one
    doc_id a hash of the row decides, and of rows alike in every column one stays.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "fingerprints")
    # A row is found again by what it holds, so nothing depends on the order of reading.
    row_hash, kept_id, kept_hash = unused_names(docs, "row_hash", "kept_id", "kept_hash")
    marked = docs.withColumn(row_hash, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    marked.select("doc_id", F.col(row_hash).alias("hash"), fingerprint_of(full_text()).alias("fp")).write.parquet(f"{folder}/all")
    rows = spark.read.parquet(f"{folder}/all")
    first = (
        rows.join(near_groups(rows), "fp")
        .groupBy("component")
        .agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "hash")).alias("first"))
        .select(F.col("first.doc_id").alias(kept_id), F.col("first.hash").alias(kept_hash))
    )
    return (
        marked.join(first, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(row_hash) == F.col(kept_hash)), "left_semi")
        .dropDuplicates(["doc_id", row_hash])
        .drop(row_hash)
    )
