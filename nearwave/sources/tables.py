"""Stored tables: series by id, and the block index.

A block index is a folder with three Parquet tables:

* ``blocks``  one row per (time block, series), in directories by time block and
  sorted by (tb, tmax, tmin, id) so that row-group statistics can skip data.  The blocks
  of sampled series lie in directories of their own, so the sample is read off without
  another pass over the values;
* ``sample``  a hash sample of whole series, from which search radii are derived;
* ``meta``    one row: block lengths and counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearwave.operators.blocks import BLOCK_SCHEMA, time_blocks
from nearwave.operators.sampling import in_sample, sample_fraction

# Tables are read with their known schema: no job to infer it from footers.
SERIES_SCHEMA = "id BIGINT, v ARRAY<DOUBLE>"
STORED_BLOCK_SCHEMA = f"{BLOCK_SCHEMA}, seg ARRAY<DOUBLE>, tb_dir INT, sampled INT"
META_SCHEMA = "t_len INT, v_len INT, n_series BIGINT, n_blocks BIGINT, uniform_len INT, sample_num INT"
# Values per task of a build, at most on average.
VALUES_PER_TASK = 1 << 24
BLOCK_KEY = ("tb", "tmax", "tmin", "id")


def last_per_id(series: DataFrame, order: str = "ord") -> DataFrame:
    """The last row of each id by ``order``: a second write of an id replaces the first.

    The row-number filter runs per task before the shuffle, so an id that holds a large
    share of the rows sends one row per task.
    """
    latest = Window.partitionBy("id").orderBy(F.col(order).desc())
    return series.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").select("id", "v")


def write_series_table(series: DataFrame, path: str, order: str | None = "ord", mode: str = "errorifexists") -> int:
    """Store ``(id, v)``, one row per id; returns the rows stored.

    ``order=None`` says ids are already unique.  Rows are stored by ranges of id and in its order, so
    that a lookup of some ids reads only the row groups that hold them.
    """
    unique = series.select("id", "v") if order is None else last_per_id(series, order)
    unique.repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(path)
    return read_series_table(series.sparkSession, path).count()


def read_series_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERIES_SCHEMA).parquet(path)


@dataclass(frozen=True)
class BlockIndex:
    """An opened block index."""

    spark: SparkSession
    path: str
    t_len: int
    v_len: int
    n_series: int
    n_blocks: int
    uniform_len: int | None
    """Common length of all series, or None if they differ."""
    sample_num: int
    """Size that the stored sample was drawn for."""

    @property
    def blocks(self) -> DataFrame:
        return read_blocks(self.spark, self.path).drop("sampled")

    def series(self, first: int, last: int) -> DataFrame:
        """``(id, v)`` of all series, put together from the time blocks ``first`` to ``last``."""
        return whole_series(self.blocks.filter(F.col("tb_dir").between(first, last)))

    @property
    def sample(self) -> DataFrame:
        return read_series_table(self.spark, f"{self.path}/sample")

    @cached_property
    def envelopes(self) -> DataFrame:
        return self.sample.select("id", F.array_max("v").alias("smax"), F.array_min("v").alias("smin"))


@dataclass(frozen=True)
class UnstoredIndex:
    """Envelopes of blocks cut on the fly, for comparing block lengths without storing each."""

    series: DataFrame
    t_len: int
    v_len: int
    uniform_len: int | None

    @property
    def spark(self) -> SparkSession:
        return self.series.sparkSession

    @property
    def blocks(self) -> DataFrame:
        return time_blocks(self.series, self.t_len, self.v_len, values=False).withColumn("tb_dir", F.col("tb"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_BLOCK_SCHEMA).parquet(f"{path}/blocks")


def stored_counts(blocks: DataFrame) -> tuple[int, int, int | None]:
    """Series, block rows and the common length, read from the table just written."""
    per_tb = sorted(
        blocks.groupBy("tb")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        .collect(),
        key=lambda r: r.tb,
    )
    if not per_tb:
        return 0, 0, None
    n_series = per_tb[0].rows
    same = all(r.rows == n_series and r.lo == r.hi for r in per_tb)
    length = sum(r.hi for r in per_tb) if same else None
    return n_series, sum(r.rows for r in per_tb), length


def whole_series(blocks: DataFrame) -> DataFrame:
    """Series put together from their stored blocks."""
    return (
        blocks.groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("tb", "seg"))).alias("parts"))
        .select("id", F.flatten(F.col("parts.seg")).alias("v"))
    )


def write_blocks(
    series: DataFrame, path: str, t_len: int, v_len: int, fraction: float, seed: int = 0, mode: str = "errorifexists"
) -> None:
    """Cut series into blocks and store them under ``path``/blocks, those of a ``fraction`` of the ids apart.

    The range partitioning is over the whole sort key: rows that share one block maximum
    are still spread by id, so a value held by a third of the series splits over tasks.
    """
    n_values = series.agg(F.sum(F.size("v"))).first()[0] or 0
    # Tasks follow the data, whatever the session's number of shuffle partitions.
    tasks = series.sparkSession.sparkContext.defaultParallelism + n_values // VALUES_PER_TASK
    (
        time_blocks(series, t_len, v_len)
        .repartitionByRange(tasks, *BLOCK_KEY)
        .withColumn("tb_dir", F.col("tb"))
        .withColumn("sampled", in_sample(fraction, seed).cast("int"))
        .sortWithinPartitions("tb_dir", "sampled", *BLOCK_KEY)
        .write.mode(mode)
        .partitionBy("tb_dir", "sampled")
        .parquet(f"{path}/blocks")
    )


def write_block_index(
    series: DataFrame,
    path: str,
    t_len: int,
    v_len: int,
    sample_num: int = 1000,
    seed: int = 0,
    mode: str = "errorifexists",
) -> BlockIndex:
    """Cut series into blocks and store them; ids must be unique (see ``last_per_id``)."""
    spark = series.sparkSession
    write_blocks(series, path, t_len, v_len, sample_fraction(sample_num, series.count()), seed, mode)
    blocks = read_blocks(spark, path)
    n_series, n_blocks, length = stored_counts(blocks)
    whole_series(blocks.filter("sampled = 1")).write.mode(mode).parquet(f"{path}/sample")
    meta = [(t_len, v_len, n_series, n_blocks, length, sample_num)]
    spark.createDataFrame(meta, META_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/meta")
    return open_block_index(spark, path)


def open_block_index(spark: SparkSession, path: str) -> BlockIndex:
    meta = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").first()
    return BlockIndex(
        spark, path, meta.t_len, meta.v_len, meta.n_series, meta.n_blocks, meta.uniform_len, meta.sample_num
    )
