"""Benchmark decontamination by item-sized windows, with DataFrame functions only.

1. Every five-word shingle of every document is looked up among the benchmark's.  Positions that
   hit some item of ``n`` words are gathered by document and ``n``: numbers only, no text.
2. A window has as many words as an item and lies in its document; in a document shorter than
   the item it is the whole document.  A similarity of ``least`` takes a number of common shingles
   that follows from it, so only windows with that many hits, wherever in the item those lie,
   can match: none is lost.  Of windows with the same or fewer hits the first is enough.
3. Windows and items get SimHash fingerprints of 128 bits over their benchmark shingles.  They are cut into
   blocks, and the item side lists every block value with up to ``FLIPS`` other bits: fingerprints that
   differ in ``RADIUS`` bits or fewer have such a block in common, so all of these pairs meet, and only they go on.
4. The weighted Jaccard similarity of the shingles (sum of the lesser counts by sum of the larger
   ones) decides.  Shingles are told apart by two independent 64-bit hashes.

A window at 0.8 has lost a ninth of the item's shingles at most, which moves 13 to 18 of the 128 bits on average and
beyond 35 in fewer than one of 10,000 windows, for items of 13 to 150 words.  What is shuffled are hits and
windows over benchmark text, not documents.  Equal windows are collapsed before they meet the
items, so a passage that a third of the documents share is matched once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwave.llm.common import unused_names
from nearwave.workdir import new_folder

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, its blocks, and the bits in which one of them may differ.
BITS, BLOCKS, FLIPS = 128, 9, 3
#: Differing bits up to which a pair is sure to meet: one more needs ``FLIPS`` + 1 in every block.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Rows of 24 bytes of the benchmark's shingles that are broadcast at a time.
BROADCAST_ROWS = 4_000_000
#: Keeps a bound that is a whole number from being rounded up to the next.
ROUNDING = 1e-9


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; null has none."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.filter(runs, lambda w: w != "")


def _shingle_hashes(words: Column) -> Column:
    """128 bits of each shingle, in order."""

    def both(i: Column) -> Column:
        parts = [F.get(words, i + k) for k in range(SHINGLE_WORDS)]
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))

    return F.transform(_starts(words), both)


def _starts(words: Column) -> Column:
    """0 .. number of shingles - 1; empty if there are too few words."""
    n = F.size(words) - SHINGLE_WORDS
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _common(a: Column, b: Column) -> Column:
    """Sum of the lesser counts of the values of two sorted arrays."""

    def repeats(values: Column) -> Column:
        """All but the first of equal values."""
        return F.filter(values, lambda v, i: (i > 0) & (F.get(values, i - 1) == v))

    def count(values: Column, value: Column) -> Column:
        return F.size(F.filter(values, lambda v: v == value))

    more = F.aggregate(
        F.array_intersect(repeats(a), repeats(b)), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)) - 1
    )
    return F.size(F.array_intersect(a, b)) + more


def _block_ends() -> list[int]:
    return [BITS * j // BLOCKS for j in range(BLOCKS + 1)]


def fingerprint(shingles: Column) -> Column:
    """SimHash of an array of 64-bit shingle hashes, as an array of its blocks' values.

    A bit is set if it is in over half the hashes; the second 64 bits are those of the hashes hashed again.
    """
    again = F.transform(shingles, lambda h: F.xxhash64(F.lit(2), h))

    def bits(hashes: Column) -> Column:
        def majority(b: Column) -> Column:
            ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
            return F.when(2 * ones > F.size(hashes), 1).otherwise(0)

        return F.transform(F.sequence(F.lit(0), F.lit(63)), majority)

    # The transform over one element keeps the bits from being counted anew for every block.
    ends = _block_ends()

    def blocks(all_bits: Column) -> Column:
        parts = [F.slice(all_bits, a + 1, b - a) for a, b in zip(ends, ends[1:])]
        return F.array(*[F.aggregate(part, F.lit(0), lambda v, bit: v * 2 + bit) for part in parts])

    return F.get(F.transform(F.array(F.concat(bits(shingles), bits(again))), blocks), F.lit(0))


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)


def _hits(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, text_hash, size, n, hit): a row per shingle of a document and length of items that have it."""
    # The one-element explode keeps the planner from splitting the text anew for every shingle.
    split = docs.select("doc_id", "text_hash", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    hashed = split.select("doc_id", "text_hash", F.size("words").alias("size"), _shingle_hashes(F.col("words")).alias("hashes"))
    each = hashed.select("doc_id", "text_hash", "size", F.posexplode("hashes").alias("pos", "key"))
    keyed = each.select("doc_id", "text_hash", "size", "pos", "key.h1", "key.h2")
    return keyed.join(F.broadcast(places), ["h1", "h2"]).select(
        "doc_id", "text_hash", "size", "n", F.struct("pos", F.col("h1").alias("shingle")).alias("hit")
    )


def _windows(docs: DataFrame, places: DataFrame, least: float) -> DataFrame:
    """(doc_id, text_hash, start, n, n_words, hits) of the windows with enough hits for ``least``.

    ``hits`` are the window's shingles that items of ``n`` words have, sorted.  A window that ends
    with a shingle without hit has no hit that the window before it lacks, and is left out.
    Places are broadcast up to ``BROADCAST_ROWS`` at a time: a larger benchmark takes more scans
    of the documents, never a shuffle of them.
    """
    parts = -(-places.count() // BROADCAST_ROWS) or 1
    found = [_hits(docs, places.filter(F.pmod("h1", F.lit(parts)) == part)) for part in range(parts)]
    hits, n_shingles, enough = F.col("hits"), F.col("n_shingles"), F.col("enough")

    def pos(j: Column) -> Column:
        return F.get(hits, j)["pos"]

    def ends_window(j: Column) -> Column:
        """Enough hits end with hit ``j``; of those in the first window only its last one."""
        follower = pos(j + 1)
        last = (pos(j) >= n_shingles - 1) | follower.isNull() | (follower >= n_shingles)
        return (j >= enough - 1) & (pos(j) - pos(j - enough + 1) < n_shingles) & last

    def window(j: Column) -> Column:
        start = F.greatest(F.lit(0), pos(j) - n_shingles + 1)
        from_hit = F.greatest(F.lit(0), j - n_shingles + 1)
        inside = F.filter(F.slice(hits, from_hit + 1, j - from_hit + 1), lambda hit: hit["pos"] >= start)
        return F.struct(start.alias("start"), F.sort_array(F.transform(inside, lambda hit: hit["shingle"])).alias("hits"))

    ends = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), ends_window)
    item_shingles = F.col("n") - SHINGLE_WORDS + 1
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy("doc_id", "text_hash", "size", "n")
        .agg(F.sort_array(F.collect_set("hit")).alias("hits"))
        .withColumn("n_words", F.least("size", "n"))
        .withColumn("n_shingles", F.col("n_words") - SHINGLE_WORDS + 1)
        .withColumn("enough", F.ceil((item_shingles + n_shingles) * (least / (1 + least)) - ROUNDING).cast("int"))
        .filter(F.size("hits") >= enough)
        # Windows are cut inside the array: no row carries all hits of its document.
        .select("doc_id", "text_hash", "n", "n_words", F.explode(F.transform(ends, window)).alias("w"))
        .select("doc_id", "text_hash", "w.start", "n", "n_words", "w.hits")
    )


def _item_keys(prints: DataFrame) -> DataFrame:
    """(item, n, block, value): every block of each item's fingerprint with up to ``FLIPS`` of its bits changed."""
    ends = _block_ends()
    masks = [
        (j, sum(1 << bit for bit in chosen))
        for j, width in enumerate(b - a for a, b in zip(ends, ends[1:]))
        for flips in range(FLIPS + 1)
        for chosen in combinations(range(width), flips)
    ]
    changed = F.broadcast(prints.sparkSession.createDataFrame(masks, "block INT, mask INT"))  # a few thousand rows
    each = prints.select("item", "n", F.posexplode("print").alias("block", "value"))
    return each.join(changed, "block").select("item", "n", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_words, similarity): each document with each item it holds.

    ``start`` is the first word of the most similar window (the first of equals), ``n_words`` its
    length: the item's, or the document's if that is shorter.  ``text_hash``
    tells apart rows that share a doc_id.  Null or empty texts, on either side, and items
    of fewer than five words have no shingle and match nothing.  Rows without an id match like
    others and carry null.  Equal rows give one row; equal items one for each id.  Extra columns
    are not read.  An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "decontaminate")
    # What is joined later is written, so that joins are planned by its true size.
    words = benchmark.select("item_id", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    words.filter(F.size("words") >= SHINGLE_WORDS).select(
        "item_id", F.xxhash64("words").alias("item"), F.size("words").alias("n"), _shingle_hashes(F.col("words")).alias("keys")
    ).write.parquet(f"{folder}/items")
    stored = spark.read.parquet(f"{folder}/items").withColumn("shingles", F.sort_array("keys.h1"))
    # Which shingle lies in an item of which length: how many items share it does not matter.
    stored.select("n", F.explode("keys").alias("key")).select("key.h1", "key.h2", "n").distinct().write.parquet(f"{folder}/places")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    _windows(rows, spark.read.parquet(f"{folder}/places"), least).write.parquet(f"{folder}/windows")
    windows = spark.read.parquet(f"{folder}/windows").withColumn("content", F.xxhash64("n", "n_words", "hits"))

    items = stored.select("item", "n", "shingles").distinct()
    items.select("item", "n", fingerprint(F.col("shingles")).alias("print")).write.parquet(f"{folder}/prints")
    prints = spark.read.parquet(f"{folder}/prints")
    _item_keys(prints).write.parquet(f"{folder}/keys")
    windows.select("content", "n", "n_words", "hits").distinct().withColumn("print", fingerprint(F.col("hits"))).write.parquet(
        f"{folder}/asked"
    )
    asked = spark.read.parquet(f"{folder}/asked")
    met = (
        asked.select("content", "n", "print", F.posexplode("print").alias("block", "value"))
        .join(spark.read.parquet(f"{folder}/keys"), ["n", "block", "value"])
        .select("content", "print", "item")
        .distinct()
        .join(prints.select("item", F.col("print").alias("item_print")), "item")
        .filter(differing_bits(F.col("print"), F.col("item_print")) <= RADIUS)
        .select("content", "item")
    )
    near = asked.drop("print").join(met.distinct(), "content").select("n", "n_words", "hits", "item")
    # The generator keeps the common shingles from being counted anew for every use.
    common = F.explode(F.array(_common(F.col("hits"), F.col("shingles")))).alias("common")
    all_shingles = F.col("n") + F.col("n_words") - 2 * (SHINGLE_WORDS - 1)
    near.join(stored.select("item", "shingles").distinct(), "item").select("n", "n_words", "hits", "item", common).withColumn(
        "similarity", F.col("common") / (all_shingles - F.col("common"))
    ).filter(F.col("similarity") >= least).select(
        F.xxhash64("n", "n_words", "hits").alias("content"), F.col("hits").alias("match_hits"), "item", "similarity"
    ).write.parquet(f"{folder}/matches")
    matches = spark.read.parquet(f"{folder}/matches").join(stored.select("item", "item_id").distinct(), "item")
    return (
        windows.join(matches, "content")
        .filter(F.col("hits") == F.col("match_hits"))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words")).alias("best"))
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            (-F.col("best.before")).cast("long").alias("start"),
            F.col("best.n_words").cast("long").alias("n_words"),
            "best.similarity",
        )
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) of every contaminated row."""
    return contaminated(docs, benchmark).drop("text_hash")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they were."""
    spark = docs.sparkSession
    folder = new_folder(spark, "leaks")
    leak_id, leak_hash = unused_names(docs, "leak_id", "leak_hash")
    contaminated(docs, benchmark).select(
        F.col("doc_id").alias(leak_id), F.col("text_hash").alias(leak_hash)
    ).distinct().write.parquet(folder)
    found = spark.read.parquet(folder)
    return docs.join(
        found, F.col("doc_id").eqNullSafe(F.col(leak_id)) & (F.xxhash64("text") == F.col(leak_hash)), "left_anti"
    )
