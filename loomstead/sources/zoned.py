"""A table format of Parquet files with zones: a Python data source with pruning reads and two-phase commits.

Below the table's folder, ``data`` holds files that are never changed and ``commits`` one manifest a
write. A manifest names its files with their rows and each column's least and largest value. What no
manifest names doesn't exist: tasks write files first, and the driver's commit makes them visible all
at once. Readers skip the files whose zones can't meet the pushed filters.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: Rows of a file at most, unless the option ``filerows`` says otherwise.
FILE_ROWS = 1_000_000


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _plain(value: object) -> object:
    """A zone's end as JSON holds it: numbers and strings as they are, dates and times as text that sorts alike."""
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(timespec="microseconds")
    return value.isoformat() if isinstance(value, datetime.date) else value


def _zones(table: pa.Table) -> dict[str, list]:
    """Least and largest value and the number of nulls by column, of columns of numbers, strings, dates and times."""
    found = {}
    for name, column in zip(table.column_names, table.columns, strict=True):
        kind = column.type
        if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_date(kind) or pa.types.is_timestamp(kind):
            if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
                continue  # Spark holds NaN for the largest number
            ends = pc.min_max(column)
            found[name] = [_plain(ends["min"].as_py()), _plain(ends["max"].as_py()), column.null_count]
    return found


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, each with its rows and zones."""

    files: list[dict] = field(default_factory=list)


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]) -> None:
        super().__init__(names)
        self.names = names


def _write_files(path: str, batches: Iterator[pa.RecordBatch], file_rows: int) -> Written:
    """One task's files, of ``file_rows`` rows at most; nobody sees them yet."""
    fs, root = _place(path)
    fs.create_dir(f"{root}/data", recursive=True)
    done, held, n = Written(), [], 0

    def put() -> None:
        table = pa.Table.from_batches(held)
        for start in range(0, table.num_rows, file_rows):
            part = table.slice(start, file_rows)
            name = f"{uuid.uuid4().hex}.parquet"
            pq.write_table(part, f"{root}/data/{name}", filesystem=fs, coerce_timestamps="us")
            done.files.append({"name": name, "rows": part.num_rows, "zones": _zones(part)})

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= file_rows:
            put()
            held, n = [], 0
    if n:
        put()
    return done


def _publish(path: str, schema: str, messages: list[WriterCommitMessage | None], **more: object) -> None:
    """Make the files of all tasks part of the table at once, by one manifest."""
    fs, root = _place(path)
    fs.create_dir(f"{root}/commits", recursive=True)
    number = _last(path) + 1
    manifest = {"number": number, "schema": schema, "files": [f for m in messages if m for f in m.files], **more}
    name = f"{number:08d}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{root}/commits/{name}.writing") as out:
        out.write(json.dumps(manifest).encode())
    fs.move(f"{root}/commits/{name}.writing", f"{root}/commits/{name}.json")  # from here on readers see the files


def _take_back(path: str, messages: list[WriterCommitMessage | None]) -> None:
    fs, root = _place(path)
    for message in messages:
        for f in message.files if message else []:
            with contextlib.suppress(FileNotFoundError):
                fs.delete_file(f"{root}/data/{f['name']}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, file_rows: int) -> None:
        self.path, self.schema, self.overwrite, self.file_rows = path, schema.json(), overwrite, file_rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write_files(self.path, iterator, self.file_rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        _publish(self.path, self.schema, messages, replaces=self.overwrite)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _take_back(self.path, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    """Batches by number: one that runs again after a failure isn't published twice."""

    def __init__(self, path: str, schema: T.StructType, file_rows: int, writer: str) -> None:
        self.path, self.schema, self.file_rows, self.writer = path, schema.json(), file_rows, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write_files(self.path, iterator, self.file_rows)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        if any(c.get("writer") == self.writer and c.get("batch") == batchId for c in _manifests(self.path)):
            _take_back(self.path, messages)
        else:
            _publish(self.path, self.schema, messages, replaces=False, writer=self.writer, batch=batchId)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        _take_back(self.path, messages)


def _manifests(path: str) -> list[dict]:
    """All of the table's manifests, in order."""
    fs, root = _place(path)
    found = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/commits", allow_not_found=True)), key=lambda i: i.base_name):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as source:
                found.append(json.loads(source.read()))
    return found


def _last(path: str) -> int:
    return max((c["number"] for c in _manifests(path)), default=0)


def _commits(path: str) -> list[dict]:
    """The manifests that count: the last one that replaces the table, and those after it."""
    found = _manifests(path)
    begin = max((i for i, c in enumerate(found) if c["replaces"]), default=0)
    return found[begin:]


def clear(path: str) -> int:
    """Delete the files that no manifest that counts names, which failed or replaced writes left; how many there were.

    Nobody may write to the table or read an earlier state of it meanwhile.
    """
    fs, root = _place(path)
    named = {f["name"] for c in _commits(path) for f in c["files"]}
    left = [i.path for i in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True)) if i.base_name not in named]
    for file in left:
        fs.delete_file(file)
    return len(left)


def _may_meet(test: Filter, zones: dict[str, list], rows: int) -> bool:
    """Whether a file with these zones can hold a row that the filter keeps; yes where that can't be told."""
    if len(getattr(test, "attribute", ())) != 1 or test.attribute[0] not in zones:
        return True
    least, largest, nulls = zones[test.attribute[0]]
    if isinstance(test, IsNotNull):
        return nulls < rows
    values = [_plain(v) for v in test.value] if isinstance(test, In) else [_plain(getattr(test, "value", None))]
    if least is None:
        return isinstance(test, EqualNullSafe) and values == [None] or not isinstance(test, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
    try:
        if isinstance(test, (EqualTo, In)):
            return any(v is not None and least <= v <= largest for v in values)
        if isinstance(test, EqualNullSafe):
            return nulls > 0 if values == [None] else least <= values[0] <= largest
        if isinstance(test, GreaterThan):
            return largest > values[0]
        if isinstance(test, GreaterThanOrEqual):
            return largest >= values[0]
        if isinstance(test, LessThan):
            return least < values[0]
        if isinstance(test, LessThanOrEqual):
            return least <= values[0]
    except TypeError:
        return True
    return True


def _split(files: list[dict], split_rows: int) -> list[Files]:
    """Files put together until they have ``split_rows`` rows."""
    found, rows = [], split_rows
    for f in files:
        if rows >= split_rows:
            found.append(Files([]))
            rows = 0
        found[-1].names.append(f["name"])
        rows += f["rows"]
    return found


def _read(path: str, columns: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    fs, root = _place(path)
    for name in names:
        with fs.open_input_file(f"{root}/data/{name}") as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=columns):
                yield batch.select(columns)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split_rows: int) -> None:
        self.path, self.columns, self.split_rows, self.tests = path, schema.names, split_rows, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.tests = list(filters)
        return filters  # zones rule files out; Spark still tests every row

    def partitions(self) -> list[Files]:
        files = [f for c in _commits(self.path) for f in c["files"] if all(_may_meet(t, f["zones"], f["rows"]) for t in self.tests)]
        return _split(files, self.split_rows) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.columns, partition.names)


class _StreamReader(DataSourceStreamReader):
    """Commits in their order: an offset is the number of the last one that was read."""

    def __init__(self, path: str, schema: T.StructType, split_rows: int) -> None:
        self.path, self.columns, self.split_rows = path, schema.names, split_rows

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": _last(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = [c for c in _manifests(self.path) if start["commit"] < c["number"] <= end["commit"]]
        if start["commit"] and any(c["replaces"] for c in new):
            raise ValueError("the table was replaced under the stream")
        return _split([f for c in new for f in c["files"]], self.split_rows)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.columns, partition.names)


class Zoned(DataSource):
    """``spark.read.format("zoned").load(path)`` and ``df.write.format("zoned").mode(...).save(path)``, or the same of streams.

    ``path`` is a folder that driver and executors see alike (a mounted one, or a URI that pyarrow
    opens). Modes are append and overwrite; an overwrite leaves earlier files until they are cleared away. Options: ``filerows``, rows of a
    file at most when writing; ``splitrows``, rows a task reads at least, if there are as many. Order the rows by a column before
    writing to make its zones narrow. Columns of all files are those of the newest write.

    A stream reads each commit once, in order. A stream that writes publishes each of its batches once, even if
    one runs again; ``writer`` names it where several streams write to a table. One write commits at a time: manifests are numbered without a lock.
    """

    @classmethod
    def name(cls) -> str:
        return "zoned"

    def schema(self) -> T.StructType:
        commits = _commits(self.options["path"])
        if not commits:
            raise ValueError(f"no table at {self.options['path']}")
        return T.StructType.fromJson(json.loads(commits[-1]["schema"]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("splitrows", FILE_ROWS)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite, int(self.options.get("filerows", FILE_ROWS)))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], schema, int(self.options.get("splitrows", FILE_ROWS)))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"], schema, int(self.options.get("filerows", FILE_ROWS)), self.options.get("writer", "stream"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.dataSource.register(Zoned)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
