"""A Spark data source for WARC archives, and archiving of web pages.

``spark.read.format("warc").load(folder)`` plans byte ranges of the files as partitions
(``partition_bytes``); predicates on the record type and other headers are pushed down
to the reader, which parses a record's headers first and steps over the payloads of
records that do not qualify: by seeking in plain files, and in compressed ones by the
places of all records, which the writer notes beside each file, so that no more than a
record's headers is inflated.  Compressed files of other writers lack these places and
are inflated in passing.  ``option("payload", "false")`` skips all payloads.  The writer
makes one file a task and, at commit, a manifest; files of failed attempts are not in
it and never read.

Folders are addressed through ``pyarrow.fs``, so any shared store it knows works.

Defined results: a null html is an empty payload; a null url is archived as the page's
URN; rows with a null id are revisits of a known page with the same payload, else
responses; repeated rows each give a record; line ends in header values are escaped;
payloads of any length are one record, which a task holds whole; an empty table gives an
archive without records; only the named columns are read, so extra ones never clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from marketloom.llm.scratch import Scratch
from marketloom.llm.skew import spread_join

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_type string, http_length long, payload binary"
#: Header of each column; fixed names of the WARC format.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
#: Profile of a revisit record: a fixed value of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "_files.json"
_OFFSETS = ".offsets"  # beside each file: the places of its records and its end, 64 bits each
_BATCH_BYTES = 8 << 20
SPLIT = 32 << 20  # distance of the split points that the writer notes


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def record_bytes(headers: dict[str, str], http_headers: dict[str, str], payload: bytes) -> bytes:
    """One WARC/1.1 record whose block is an HTTP response."""
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in http_headers.items()) + "\r\n").encode() + payload
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _headers(stream) -> dict[str, str] | None:
    """Headers of the record at the stream's place, None at its end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


@dataclass
class FilePart(InputPartition):
    """Records that begin in [start, end) of a file."""

    path: str
    start: int
    end: int
    noted: bool = False  # whether the places of the file's records are noted


def _matches(row: dict, filters: list) -> bool:
    for f in filters:
        value = row.get(f.attribute[0])
        if isinstance(f, EqualTo):
            ok = value == f.value
        elif isinstance(f, In):
            ok = value in f.value
        elif isinstance(f, StringStartsWith):
            ok = value is not None and value.startswith(f.value)
        else:
            ok = value is not None
        if not ok:
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", SPLIT))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            plain = isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS
            if plain:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Ranges between noted split points; a foreign file, which has none, is one range."""
        store, root = open_store(self.path)
        noted = True
        try:
            with store.open_input_stream(f"{root}/{_MANIFEST}") as f:
                cuts = {f"{root}/{n}": c for n, c in json.loads(f.read()).items()}
        except FileNotFoundError:
            noted = False
            info = store.get_file_info(root)
            found = store.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
            cuts = {x.path: [0, x.size] for x in found if x.path.endswith((".warc", ".warc.gz"))}
        parts = []
        for path, places in sorted(cuts.items()):
            start = places[0]
            for at in places[1:]:
                if at - start >= self.partition_bytes or at == places[-1] and at > start:
                    parts.append(FilePart(path, start, at, noted))
                    start = at
        return parts or [FilePart("", 0, 0)]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = open_store(self.path)
        rows, held = [], 0
        with store.open_input_file(part.path) as raw:
            for row in self._records(store, raw, part):
                rows.append(row)
                held += len(row["payload"] or b"")
                if held > _BATCH_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, store: fs.FileSystem, raw, part: FilePart) -> Iterator[dict]:
        """The qualifying records of a part."""
        if part.path.endswith(".gz") and part.noted:
            with store.open_input_file(part.path + _OFFSETS) as f:
                places = np.frombuffer(f.read(), "<i8")
            first = int(np.searchsorted(places, part.start))
            for a, b in zip(places[first:-1].tolist(), places[first + 1 :].tolist(), strict=True):
                if a >= part.end:
                    return
                # a small buffer: a record that does not qualify is inflated no further than its headers
                row = self._record(io.BufferedReader(gzip.GzipFile(fileobj=_Range(raw, a, b)), 1024))
                if row:
                    yield row
            return
        if part.path.endswith(".gz"):
            stream = io.BufferedReader(gzip.GzipFile(fileobj=_Range(raw, part.start, part.end)), 1 << 20)
        else:
            stream = io.BufferedReader(raw, 1 << 20)
            stream.seek(part.start)
        while part.path.endswith(".gz") or stream.tell() < part.end:
            row = self._record(stream, go_on=True)
            if row is None:
                return
            if row:
                yield row

    def _record(self, stream, go_on: bool = False) -> dict | None:
        """The record at the stream's place: None at its end, empty if it does not qualify."""
        headers = _headers(stream)
        if headers is None:
            return None
        row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        block_end = stream.tell() + int(headers.get("content-length", 0))
        if _matches(row, self.filters):
            row["http_length"], row["payload"] = None, None
            if "msgtype=response" in (row["content_type"] or "").replace(" ", ""):
                while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                    if line.lower().startswith(b"content-length:"):
                        row["http_length"] = int(line.split(b":")[1])
            if self.with_payload:
                row["payload"] = stream.read(block_end - stream.tell())
        else:
            row = {}
        if go_on:
            stream.seek(block_end + 4)  # past the two line ends that close a record
        return row


_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string())) for c in SCHEMA.split(", ")])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class _Range:
    """The bytes [start, end) of a file, for a decompressor."""

    def __init__(self, raw, start: int, end: int) -> None:
        self.raw, self.left = raw, end - start
        raw.seek(start)

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(data)
        return data


@dataclass
class WrittenFile(WriterCommitMessage):
    """A file and the places where records begin, one about every SPLIT bytes, with its end."""

    name: str
    cuts: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Columns record_id, record_type, target_uri, date, payload_digest, refers_to, http_length, payload."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.suffix = ".warc.gz" if options.get("compression") == "gzip" else ".warc"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenFile:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        name, cuts, places, at = f"part-{uuid.uuid4().hex}{self.suffix}", [0], [], 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    headers = {h: row[c] for c, h in HEADERS.items() if row.get(c) is not None}
                    headers["Content-Type"] = "application/http; msgtype=response"
                    if row["record_type"] == "revisit":
                        headers["WARC-Profile"] = PROFILE
                    record = record_bytes(headers, {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(row["http_length"])}, row["payload"] or b"")
                    record = gzip.compress(record, 6) if self.suffix.endswith(".gz") else record  # a member a record
                    out.write(record)
                    places.append(at)
                    at += len(record)
                    if at - cuts[-1] >= SPLIT:
                        cuts.append(at)
        if self.suffix.endswith(".gz"):
            with store.open_output_stream(f"{root}/{name}{_OFFSETS}", compression=None) as out:
                out.write(np.array([*places, at], "<i8").tobytes())
        return WrittenFile(name, cuts if cuts[-1] == at and len(cuts) > 1 else [*cuts, at])

    def commit(self, messages) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{_MANIFEST}", compression=None) as out:
            out.write(json.dumps({m.name: m.cuts for m in messages if m}).encode())

    def abort(self, messages) -> None:
        store, root = open_store(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.name}")
                if m.name.endswith(".gz"):
                    store.delete_file(f"{root}/{m.name}{_OFFSETS}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format("warc") known and let Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_ID = "<urn:page:"


def _digests(column: str, frame: DataFrame) -> DataFrame:
    """``frame`` with payload_digest of a binary column, appended."""
    schema = type(frame.schema)(frame.schema.fields[:]).add("payload_digest", "string")
    at = frame.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else payload_digest(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=schema.names)

    return frame.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, compression: str | None = None, date: str | None = None) -> None:
    """Write a record for each page; repeated payloads of ``least_bytes`` or more become revisits.

    ``date`` (ISO 8601, UTC) is that of all records, the present time if None.

    Among equal payloads (compared by SHA-256) the rows with the smallest id hold the
    response; rows with a null id are revisits unless no id is known, then responses.
    """
    register(pages.sparkSession)
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), body.alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha2("payload", 256)), "http_length": F.octet_length("payload").cast("long")})
    large = rows.filter(F.col("http_length") >= least_bytes)
    first = large.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = Scratch(pages.sparkSession, "warc").save(first, "first")
    marked = spread_join(_digests("payload", rows), first.drop("n"), "sha", "left", counts=first)
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    urn = lambda c: F.concat(F.lit(_ID), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    target = F.coalesce("target_uri", F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("target_uri")
    out = marked.select(
        urn(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), target,
        F.lit(date).alias("date"), F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"), F.lit("application/http; msgtype=response").alias("content_type"), "http_length",
        F.when(~again, F.col("payload")).alias("payload"))
    writer = out.write.format("warc").mode("append").option("path", folder)
    (writer.option("compression", compression) if compression else writer).save()


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of a folder.

    Figures of responses come from their payloads, those of revisits from their headers.
    """
    register(spark)
    kinds = []
    for kind in ("response", "revisit"):
        # each kind loads the folder anew: Spark keeps pushed filters with a loaded source
        part = spark.read.format("warc").load(folder).filter(F.col("record_type") == kind)
        if kind == "response":
            part = _digests("payload", part.select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")).drop("payload")
        else:
            part = part.select("record_id", "record_type", "refers_to", F.col("http_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"))
        kinds.append(part)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    both = kinds[0].unionByName(kinds[1])
    return both.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0, compression: str | None = "gzip", **columns) -> DataFrame:
    """Archive the pages in the shared folder and read the archives back."""
    folder = Scratch(pages.sparkSession, "warc").path("archive")
    archive_pages(pages, folder, least_bytes=least_bytes, compression=compression, **columns)
    return read_archive(pages.sparkSession, folder)
