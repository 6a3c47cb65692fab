"""A Spark data source for folders of zipped daily CSV archives.

``spark.read.format("market_archives").option("kind", "klines").load(folder)`` lists the folder
once and plans archives as partitions, small ones together.  Conditions on ``symbol`` and
``archive_day`` are pushed down to the names, so other archives are neither planned nor opened.
A task reads an archive through a seekable stream and parses its members in Arrow blocks, so
neither an archive nor a member is ever held whole.

All columns are text, as in the files; ``ingest.typed`` types them.  Members are read in the
order of their names, other members than ``*.csv`` are left out.  A row with more or fewer
fields than the kind has is an error, or is left out with the option ``bad_rows`` = ``skip``.
An empty member gives no rows.  Folders are those that ``pyarrow.fs`` can open: local and shared
paths, and the URIs of the stores it supports.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

PARTITION_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20

_NAME = re.compile(r"^(?P<symbol>.+)-(?P<middle>[^-]+)-(?P<day>\d{4}-\d{2}-\d{2})\.zip$")
_INTERVAL = re.compile(r"^\d+[smhdwM]o?$")


def archive_of(name: str, kind: str) -> tuple[str, str] | None:
    """Symbol and day of an archive of ``kind`` by its file name; None for other files."""
    found = _NAME.match(name)
    if not found or not (_INTERVAL.match(found["middle"]) if kind == "klines" else found["middle"] == kind):
        return None
    return found["symbol"], found["day"]


def _filesystem(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


@dataclass
class Archives(InputPartition):
    """Archives that one task reads: (path, symbol, day)."""

    files: tuple[tuple[str, str, str], ...]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.folder, self.kind = options["path"], options["kind"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.skip = options.get("bad_rows", "error") == "skip"
        self.columns, self.tests = columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on what a file name tells decide which archives are read; all others stay with Spark."""
        compare = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in ("archive_symbol", "archive_day") and isinstance(f, IsNotNull):
                continue  # a name always tells both
            if name in ("archive_symbol", "archive_day") and type(f) in compare:
                self.tests.append((name == "archive_day", compare[type(f)], tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        store, path = _filesystem(self.folder)
        found = []
        for info in sorted(store.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda i: i.path):
            named = archive_of(info.base_name, self.kind) if info.is_file else None
            if named and all(test(named[is_day], value) for is_day, test, value in self.tests):
                found.append((info.size, (info.path, *named)))
        parts: list[list] = []
        size = self.partition_bytes
        for n, file in found:
            if size + n > self.partition_bytes:
                parts.append([])
                size = 0
            parts[-1].append(file)
            size += n
        return [Archives(tuple(p)) for p in parts] or [Archives(())]

    def read(self, partition: Archives) -> Iterator:
        import pyarrow as pa
        from pyarrow import csv

        names = self.columns[:-2]
        store, _ = _filesystem(self.folder)
        handler = (lambda row: "skip") if self.skip else (lambda row: "error")
        options = {
            "read_options": csv.ReadOptions(column_names=names, block_size=BLOCK_BYTES, use_threads=False),
            "parse_options": csv.ParseOptions(invalid_row_handler=handler, newlines_in_values=False),
            "convert_options": csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False)}
        for path, symbol, day in partition.files:
            with store.open_input_file(path) as stream, zipfile.ZipFile(stream) as archive:
                for member in sorted(i.filename for i in archive.infolist() if i.filename.endswith(".csv") and i.file_size):
                    with archive.open(member) as content, csv.open_csv(content, **options) as batches:
                        for batch in batches:
                            told = [pa.array([v] * batch.num_rows, pa.string()) for v in (symbol, day)]
                            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=self.columns)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market_archives"

    def _columns(self) -> list[str]:
        from marketloom.sources.ingest import schema_of

        return [*schema_of(self.options["kind"]), "archive_symbol", "archive_day"]

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self._columns())

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options, self._columns())


def register(spark: SparkSession) -> None:
    """Make ``market_archives`` known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
