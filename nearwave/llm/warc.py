"""WARC archives with a two-level capture index.

Writing: each task streams its pages into files of gzip members, one per record.  A payload that
other pages share is stored once, by the page with the smallest id; the others are revisit
records that name it.

Index: a line per record, keyed by the address with its host reversed (so that a site and its
subdomains stand together) and the page id.  Lines are range-partitioned and sorted by key, cut
into compressed blocks, and each index file ends with a directory of its blocks' first keys.
The first keys of the files, one row per file, are a Parquet table.

Lookup: keys go to the index file whose range holds them, where each is found by a binary search
in the directory and one range read of a block; the records are then read by their ranges, in
the order of the archive files.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from nearwave.llm.files import new_file, open_folder
from nearwave.workdir import new_folder

MIN_REVISIT_BYTES = 100
CAPTURE_DATE = "1970-01-01T00:00:00Z"
BLOCK_LINES = 300
MAX_FILE_BYTES = 1 << 30
GZIP_LEVEL = 4
TAIL = "<8sQQ"  # magic, where the directory starts, its bytes
INDEX_MAGIC = b"CAPIDX01"


def url_key(url: str | None) -> str:
    """Address with its host reversed: com,example,www)/path?query, lower-case host, no fragment."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "://" in text else "//" + text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return text
    host = ",".join(reversed(host.split(".")))
    default = {"http": 80, "https": 443}.get(parts.scheme)
    place = f":{port}" if port and port != default else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{host}{place}){parts.path or '/'}{query}"


@pandas_udf(T.StringType())
def url_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for urls in batches:
        yield urls.map(url_key, na_action=None)


# Records


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _line_safe(value: str) -> str:
    return "".join(c for c in value if c >= " " and c != "\x7f")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record of an HTTP response, or of a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {CAPTURE_DATE}",
        f"WARC-Target-URI: {_line_safe(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_name(refers_to)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:] if ":" in line)
    return {name.lower(): value.strip() for name, value in pairs}


def parse_record(data: bytes) -> dict:
    """What a record says: page_id, record_type, refers_to, payload (None of a revisit), size, digest, url."""
    head, rest = data.split(b"\r\n\r\n", 1)
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    kind = warc["warc-type"]

    def number(name: str) -> int | None:
        text = warc.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.lstrip("-").isdigit() else None

    return {
        "page_id": number("warc-record-id"),
        "record_type": kind,
        "refers_to": number("warc-refers-to"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(_headers(http)["content-length"]),
        "payload_digest": warc["warc-payload-digest"].removeprefix("sha256:"),
        "url": warc["warc-target-uri"],
    }


# Writing


def _with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with their payload's digest, and ``first``: the smallest page_id of a shared payload."""
    payload = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    shared = (
        pages.select(F.sha2(F.col("html").cast("binary"), 256).alias("shared_digest"), "page_id", F.octet_length("html").alias("n"))
        .filter(F.col("n") >= min_bytes)
        .groupBy("shared_digest")
        .agg(F.count("*").alias("copies"), F.min("page_id").alias("first"))
        .filter("copies > 1")
        .drop("copies")
    )
    folder = new_folder(pages.sparkSession, "shared-payloads")
    shared.write.parquet(folder)  # planned by its true size
    return payload.join(pages.sparkSession.read.parquet(folder), F.col("digest") == F.col("shared_digest"), "left")


_CAPTURE = pa.schema(
    [("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]
)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns (key, page_id, file, offset, size).

    The result must be stored once and read from there: computing it writes the files.
    Rows that share the smallest id of a payload are all responses.
    """
    rows = _with_revisits(pages, min_bytes).select("page_id", "url", "html", "digest", "first", url_keys("url").alias("key"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        name, at = "", 0
        for batch in batches:
            captures = []
            for row in batch.to_pylist():
                if out is None or at >= MAX_FILE_BYTES:
                    if out is not None:
                        out.close()
                    system, path, name = new_file(folder, "pages", ".warc.gz")
                    out, at = system.open_output_stream(path, compression=None), 0
                revisit = row["first"] is not None and row["page_id"] != row["first"]
                payload = row["html"].encode()
                data = gzip.compress(
                    record(row["page_id"], row["url"], payload, row["digest"], row["first"] if revisit else None, revisit),
                    GZIP_LEVEL,
                    mtime=0,
                )
                out.write(data)
                captures.append((row["key"], row["page_id"], name, at, len(data)))
                at += len(data)
            columns = list(zip(*captures)) or [()] * len(_CAPTURE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CAPTURE)], schema=_CAPTURE)
        if out is not None:
            out.close()

    return rows.mapInArrow(write, "key string, page_id long, file string, offset long, size long")


# Index


def _sort_key(key: str, page_id: int | None) -> tuple[bytes, bool, int]:
    """Orders as Spark does: by the key's UTF-8 bytes, then null ids, then ids."""
    return key.encode(), page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index of ``captures``; returns (file, key, page_id): each file's first entry."""
    names = _CAPTURE.names
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").select(*names)
    schema = pa.schema([("file", pa.string()), ("key", pa.string()), ("page_id", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        directory: list[list] = []
        lines: list[str] = []
        at = 0

        def flush() -> None:
            nonlocal at
            data = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(data)
            first = json.loads(lines[0])
            directory.append([first[0], first[1], at, len(data)])
            at += len(data)
            lines.clear()

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if out is None:
                    system, path, name = new_file(folder, "captures", ".idx")
                    out = system.open_output_stream(path, compression=None)
                lines.append(json.dumps(row, ensure_ascii=False))
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        data = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
        out.write(data + struct.pack(TAIL, INDEX_MAGIC, at, len(data)))
        out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "key", "page_id"), [name, *directory[0][:2]]))], schema=schema)

    return ordered.mapInArrow(write, "file string, key string, page_id long")


class CaptureIndex:
    """One index file: the block directory in memory, blocks read by range."""

    def __init__(self, folder: str, name: str):
        system, path = open_folder(folder)
        self.source = system.open_input_file(f"{path}/{name}")
        size = self.source.size()
        n_tail = struct.calcsize(TAIL)
        magic, start, n = struct.unpack(TAIL, self.source.read_at(n_tail, size - n_tail))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{name} is no capture index")
        self.directory = json.loads(gzip.decompress(self.source.read_at(n, start)))
        self.firsts = [_sort_key(key, page_id) for key, page_id, *_ in self.directory]
        self.at = -1
        self.entries: list[list] = []
        self.keys: list[tuple] = []

    def _load(self, block: int) -> None:
        if block != self.at:
            _, _, start, n = self.directory[block]
            self.entries = [json.loads(line) for line in gzip.decompress(self.source.read_at(n, start)).decode().split("\n")]
            self.keys = [_sort_key(e[0], e[1]) for e in self.entries]
            self.at = block

    def find(self, key: str, page_id: int | None) -> list[list]:
        """Every capture (key, page_id, file, offset, size) of that key and id."""
        wanted = _sort_key(key, page_id)
        block = max(0, bisect_right(self.firsts, wanted) - 1)
        while block > 0 and self.firsts[block] == wanted:  # equal entries may fill several blocks
            block -= 1
        found = []
        while block < len(self.directory) and self.firsts[block] <= wanted:
            self._load(block)
            i = bisect_right(self.keys, wanted)
            j = i
            while j and self.keys[j - 1] == wanted:
                j -= 1
            found += self.entries[j:i]
            block += 1
        return found


def lookup(asked: DataFrame, index_files: DataFrame, folder: str) -> DataFrame:
    """Captures (file, offset, size) of each different (key, page_id) of ``asked``.

    ``index_files`` has one row per index file (as many as the index has range partitions), so
    its rows may go to every task; captures and keys stay distributed.
    """
    shards = sorted(((r.key, r.page_id, r.file) for r in index_files.collect()), key=lambda s: _sort_key(s[0], s[1]))
    firsts = [_sort_key(key, page_id) for key, page_id, _ in shards]
    names = [name for *_, name in shards]
    if not names:
        return asked.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("size")).limit(0)

    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, current = None, -1
        for batch in batches:
            found = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wanted = _sort_key(key, page_id)
                # Ranges end where the next begins; an entry that begins a range lies in it alone.
                shard = max(0, bisect_right(firsts, wanted) - 1)
                if shard != current:
                    index, current = CaptureIndex(folder, names[shard]), shard
                found += [e[2:] for e in index.find(key, page_id)]
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    keys = asked.select("key", "page_id").distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return keys.mapInArrow(find, "file string, offset long, size long")


def read_records(captures: DataFrame, folder: str, tasks: int) -> DataFrame:
    """The records of ``captures`` (file, offset, size), read by range in the order of the files.

    Columns: page_id, url, payload_bytes, payload_digest (of the payload itself where the record holds
    it, else as the revisit states it), record_type, refers_to.
    """
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        source, current = None, None
        for batch in batches:
            rows = []
            for name, offset, size in zip(*(column.to_pylist() for column in batch.columns)):
                if name != current:
                    if source is not None:
                        source.close()
                    source, current = system.open_input_file(f"{path}/{name}"), name
                row = parse_record(gzip.decompress(source.read_at(size, offset)))
                payload = row.pop("payload")
                if payload is not None:
                    row["payload_bytes"] = len(payload)
                    row["payload_digest"] = hashlib.sha256(payload).hexdigest()
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ordered = captures.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "size").mapInArrow(
        read,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def write_archive(pages: DataFrame, folder: str) -> None:
    """Archives, index and their tables of ``pages`` in ``folder``."""
    spark = pages.sparkSession
    write_archives(pages, f"{folder}/archives").write.parquet(f"{folder}/captures")
    captures = spark.read.parquet(f"{folder}/captures")
    write_index(captures, f"{folder}/index").write.parquet(f"{folder}/index_files")


def read_pages(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """Records of the pages ``asked`` (page_id, url), found through the index."""
    index_files = spark.read.parquet(f"{folder}/index_files")
    n_archives = spark.read.parquet(f"{folder}/captures").select("file").distinct().count()
    keyed = asked.select(url_keys("url").alias("key"), "page_id")
    found = new_folder(spark, "found-captures")
    lookup(keyed, index_files, f"{folder}/index").write.parquet(found)
    # As many tasks as archive files: the rows are few bytes, what they stand for is not.
    return read_records(spark.read.parquet(found), f"{folder}/archives", max(1, n_archives))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archive of ``pages`` and reads every page back by its address and id.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest, record_type,
    refers_to.  A null html is an empty payload, a null address an empty key, a null id is kept
    (it comes last among the ids of a payload, and is named by none).  Rows that share an id
    have a record each.  An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archive(pages, folder)
    found = read_pages(spark, folder, pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
