"""A store of series and their block index in which a second write of an id replaces the first.

A write is a segment of its own: the ids it speaks for, their blocks, and the sampled ones among them.  A manifest
names the segments that count, oldest first; it is moved into place in one rename, so readers see all of a
write or nothing, and keep the version they opened.  What a writer leaves behind that was stopped before
the rename is named nowhere and never read.

On reading the newest segment that speaks for an id wins.  All of the older series is hidden, also blocks that a now
shorter series no longer has.  Removed ids are spoken for without a series.  ``compact`` writes what is
left as one segment.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import cached_property, reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwave.operators.sampling import sample_fraction
from nearwave.sources.tables import (
    SERIES_SCHEMA,
    STORED_BLOCK_SCHEMA,
    last_per_id,
    read_blocks,
    read_series_table,
    stored_counts,
    whole_series,
    write_blocks,
)

_PREFIX = "manifest-"


@dataclass(frozen=True)
class Segment:
    folder: str
    n_series: int
    n_blocks: int
    length: int | None
    """Common length of the segment's series, None if they differ or there is none."""


@dataclass(frozen=True)
class Manifest:
    version: int
    t_len: int
    v_len: int
    sample_num: int
    seed: int
    fraction: float | None
    """Share of ids that are sampled: set by the first write, and again when the store is compacted."""
    n_series: int
    segments: tuple[Segment, ...] = ()


class Conflict(RuntimeError):
    """Another writer has made the version that was to be made."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop
    folder = hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return hadoop, folder, hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop, folder, _ = _files(spark, path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(n.removeprefix(_PREFIX)) for n in names if n.startswith(_PREFIX))


def _commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Makes the manifest's version, or raises :class:`Conflict` if there is one."""
    hadoop, folder, context = _files(spark, path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    draft = hadoop.fs.Path(folder, f"_draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()
    never_replace = spark._sc._gateway.new_array(getattr(hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, hadoop.fs.Path(folder, f"{_PREFIX}{manifest.version:010d}"), never_replace)
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Conflict(f"version {manifest.version} of {path} is there already") from error
        raise


def _read(spark: SparkSession, path: str, version: int) -> Manifest:
    text = spark.read.text(f"{path}/{_PREFIX}{version:010d}", wholetext=True).first().value
    found = json.loads(text)
    return Manifest(**found | {"segments": tuple(Segment(**s) for s in found["segments"])})


@dataclass(frozen=True)
class SeriesStore:
    """One version of a store.  Writes return the store at its new version; this one stays as it is."""

    spark: SparkSession
    path: str
    manifest: Manifest

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, t_len: int, v_len: int, sample_num: int = 1000, seed: int = 0
    ) -> SeriesStore:
        manifest = Manifest(0, t_len, v_len, sample_num, seed, None, 0)
        _commit(spark, path, manifest)
        return cls(spark, path, manifest)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> SeriesStore:
        """The newest version, or the one asked for."""
        versions = _versions(spark, path)
        chosen = version if version is not None else max(versions, default=None)
        if chosen not in versions:
            raise ValueError(f"no version {version} of a store at {path}" if version is not None else f"no store at {path}")
        return cls(spark, path, _read(spark, path, chosen))

    # Reading

    def _of_segments(self, name: str, schema: str) -> list[DataFrame]:
        """A table of each segment without the rows of ids that a newer one speaks for; newest first.

        The ids of newer segments are one table for each older one: Spark broadcasts it while it is small.
        """
        tables: list[DataFrame] = []
        newer: DataFrame | None = None
        for segment in reversed(self.manifest.segments):
            folder = f"{self.path}/{segment.folder}"
            ids = self.spark.read.schema("id BIGINT").parquet(f"{folder}/ids")
            if segment.n_series:
                table = self.spark.read.schema(schema).parquet(f"{folder}/{name}") if schema else read_blocks(self.spark, folder)
                tables.append(table if newer is None else table.join(newer, "id", "left_anti"))
            newer = ids if newer is None else newer.unionAll(ids)
        return tables

    @property
    def blocks(self) -> DataFrame:
        found = [table.drop("sampled") for table in self._of_segments("blocks", "")]
        return reduce(DataFrame.unionByName, found) if found else self._nothing("blocks").drop("sampled")

    @property
    def sample(self) -> DataFrame:
        found = [table.select("id", "v") for table in self._of_segments("sample", SERIES_SCHEMA)]
        return reduce(DataFrame.unionAll, found) if found else self._nothing("sample")

    def _nothing(self, name: str) -> DataFrame:
        if name == "sample":
            return self.spark.createDataFrame([], SERIES_SCHEMA)
        return self.spark.createDataFrame([], STORED_BLOCK_SCHEMA)

    def series(self, first: int = 0, last: int | None = None) -> DataFrame:
        """``(id, v)`` of all series, or of their time blocks ``first`` to ``last``."""
        wanted = F.col("tb_dir") >= first if last is None else F.col("tb_dir").between(first, last)
        return whole_series(self.blocks.filter(wanted))

    # What index searches ask for: a store is searched like a block index.

    @property
    def t_len(self) -> int:
        return self.manifest.t_len

    @property
    def v_len(self) -> int:
        return self.manifest.v_len

    @property
    def sample_num(self) -> int:
        return self.manifest.sample_num

    @property
    def n_series(self) -> int:
        return self.manifest.n_series

    @property
    def uniform_len(self) -> int | None:
        lengths = {s.length for s in self.manifest.segments if s.n_series}
        return lengths.pop() if len(lengths) == 1 else None

    @cached_property
    def envelopes(self) -> DataFrame:
        return self.sample.select("id", F.array_max("v").alias("smax"), F.array_min("v").alias("smin"))

    # Writing

    def _segment(self, ids: DataFrame, series: DataFrame | None, fraction: float) -> Segment:
        folder = f"segment-{uuid.uuid4().hex}"
        path = f"{self.path}/{folder}"
        ids.write.parquet(f"{path}/ids")
        if series is None:
            return Segment(folder, 0, 0, None)
        write_blocks(series, path, self.t_len, self.v_len, fraction, self.manifest.seed)
        blocks = read_blocks(self.spark, path)
        whole_series(blocks.filter("sampled = 1")).write.parquet(f"{path}/sample")
        return Segment(folder, *stored_counts(blocks))

    def _next(self, segments: tuple[Segment, ...], fraction: float | None) -> SeriesStore:
        draft = replace(self.manifest, version=self.manifest.version + 1, segments=segments, fraction=fraction)
        n_series = replace(self, manifest=draft).blocks.filter("tb_dir = 0").count() if segments else 0
        manifest = replace(draft, n_series=n_series)
        _commit(self.spark, self.path, manifest)
        return replace(self, manifest=manifest)

    def put(self, series: DataFrame, order: str | None = None) -> SeriesStore:
        """Writes ``(id, v)``: new ids are added, known ones replaced.

        With ``order`` the last row of an id counts; without it ids must be unique.  A series without
        values removes its id.  Rows are stored before they are looked at, so what is written is what was read once.
        """
        folder = f"{self.path}/segment-{uuid.uuid4().hex}"
        unique = series.select("id", "v") if order is None else last_per_id(series, order)
        unique.write.parquet(f"{folder}/given")
        given = read_series_table(self.spark, f"{folder}/given")
        size = given.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("v") > 0).alias("series"), F.countDistinct("id").alias("ids")).first()
        if size.ids != size.n:
            raise ValueError("series ids must be unique")
        if not size.n:
            return self
        fraction = self.manifest.fraction
        if fraction is None and size.series:
            fraction = sample_fraction(self.sample_num, size.series)
        segment = self._segment(given.select("id"), given if size.series else None, fraction or 1.0)
        return self._next((*self.manifest.segments, segment), fraction)

    def remove(self, ids: DataFrame) -> SeriesStore:
        """Hides the series of ``(id)``; unknown ids do no harm."""
        segment = self._segment(ids.select("id").distinct(), None, 1.0)
        return self._next((*self.manifest.segments, segment), self.manifest.fraction)

    def compact(self) -> SeriesStore:
        """The same series in one segment, sampled anew.  Older versions stay readable."""
        if not self.n_series:
            return self._next((), None)
        fraction = sample_fraction(self.sample_num, self.n_series)
        series = self.series()
        segment = self._segment(self.blocks.filter("tb_dir = 0").select("id"), series, fraction)
        return self._next((segment,), fraction)
