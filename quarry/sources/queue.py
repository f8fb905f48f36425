"""A bounded queue in a shared folder, as a data source: append in batch or as a stream, consume as a stream by group.

    rows.write.format("quarry_queue").option("path", queue).mode("append").save()
    spark.readStream.format("quarry_queue").schema(s).option("path", queue).option("group", "workers").load()

Entries have numbers in the order of their commit. A commit renames the files that tasks wrote into place, so what an
aborted job wrote is never seen. Each consumer group has its own place: the entries that a micro-batch was done with are
acknowledged when Spark commits it, which it does before the next one; `settle` does so for the last one of a query that
has stopped. A query without a checkpoint starts after the group's last acknowledgement.
The queue keeps its last `most` entries; what a slow group has not read by then is lost to it. One writer commits at a
time. Files are reached through Arrow's file systems.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Entries that a queue keeps, and that a consumer takes at once, at most.
MOST, PER_BATCH = 1000, 10
FORMAT = "quarry_queue"


def register(spark: SparkSession) -> None:
    """Makes the format known. Its classes travel whole: the process that plans a stream on the driver knows nothing of the
    packages that were sent to executors."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(QueueSource)


@dataclass(frozen=True)
class Entry:
    """A file of n entries, of which `first` is the number of the first one, by one commit of a writer."""

    first: int
    n: int
    commit: str

    @property
    def name(self) -> str:
        return f"{self.first:020d}-{self.n:09d}-{self.commit}.parquet"

    @classmethod
    def of(cls, name: str) -> Entry:
        first, n, commit = name.removesuffix(".parquet").split("-", 2)
        return cls(int(first), int(n), commit)


class Folder:
    """The queue's files."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("most", MOST))

    def fs(self) -> tuple[afs.FileSystem, str]:
        return afs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (afs.LocalFileSystem(), self.path)

    def entries(self) -> list[Entry]:
        fs, at = self.fs()
        found = fs.get_file_info(afs.FileSelector(f"{at}/entries", allow_not_found=True))
        return sorted((Entry.of(f.base_name) for f in found if f.base_name.endswith(".parquet")), key=lambda e: e.first)

    def number(self, name: str) -> int | None:
        fs, at = self.fs()
        if fs.get_file_info(f"{at}/{name}").type == afs.FileType.NotFound:
            return None
        with fs.open_input_stream(f"{at}/{name}") as f:
            return int(f.read() or b"0")

    def put_number(self, name: str, n: int) -> None:
        fs, at = self.fs()
        folder, draft = f"{at}/{name}".rsplit("/", 1)[0], f"{at}/{name}.{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(draft) as f:
            f.write(str(n).encode())
        fs.move(draft, f"{at}/{name}")

    def ends(self) -> tuple[int, int]:
        """(number of the first entry that is kept, number after the last one)."""
        own = self.entries()
        end = max((e.first + e.n for e in own), default=self.number("floor") or 0)
        return max(self.number("floor") or 0, min((e.first for e in own), default=end)), end

    def group(self, name: str, start: str = "first") -> int:
        """Where a group goes on. One that is new begins with the first entry, or after the last one; again is no change."""
        at = self.number(f"groups/{name}")
        if at is None:
            first, end = self.ends()
            at = first if start == "first" else end
            self.put_number(f"groups/{name}", at)
        return at

    def pending(self, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Pending:
        fs, at = self.fs()
        fs.create_dir(f"{at}/pending", recursive=True)
        name, n = f"{at}/pending/{uuid.uuid4().hex}.parquet", 0
        with fs.open_output_stream(name) as out, pq.ParquetWriter(out, schema) as writer:
            for batch in batches:
                writer.write_batch(batch.cast(schema) if batch.schema != schema else batch)
                n += len(batch)
        return Pending(name, n)

    def commit(self, pending: list[Pending], commit: str) -> None:
        """Numbers the files of a commit and drops what is over `most`; a commit that is there already changes nothing."""
        fs, at = self.fs()
        fs.create_dir(f"{at}/entries", recursive=True)
        own = self.entries()
        if any(e.commit.split(".")[0] == commit for e in own):
            return self.abort(pending)
        _, end = self.ends()
        for i, p in enumerate(sorted((p for p in pending if p.n), key=lambda p: p.path)):
            fs.move(p.path, f"{at}/entries/{Entry(end, p.n, f'{commit}.{i}').name}")
            end += p.n
        self.abort([p for p in pending if not p.n])
        floor = max(0, end - self.most)
        self.put_number("floor", max(floor, self.number("floor") or 0))
        for e in self.entries():
            if e.first + e.n <= floor:
                fs.delete_file(f"{at}/entries/{e.name}")

    def abort(self, pending: list[Pending | None]) -> None:
        fs, _ = self.fs()
        for p in pending:
            if p is not None and fs.get_file_info(p.path).type != afs.FileType.NotFound:
                fs.delete_file(p.path)


@dataclass
class Pending(WriterCommitMessage):
    path: str
    n: int


@dataclass
class Range(InputPartition):
    """Some of a file's entries."""

    name: str
    low: int
    high: int


def ranges(folder: Folder, start: int, end: int) -> list[Range]:
    out = []
    for e in folder.entries():
        low, high = max(start, e.first), min(end, e.first + e.n)
        if low < high:
            out.append(Range(e.name, low - e.first, high - e.first))
    return out


def rows(folder: Folder, part: Range) -> Iterator[pa.RecordBatch]:
    fs, at = folder.fs()
    with fs.open_input_file(f"{at}/entries/{part.name}") as f:
        yield from pq.read_table(f).slice(part.low, part.high - part.low).to_batches()


def settle(query: StreamingQuery, path: str, group: str = "default") -> None:
    """Acknowledges what the last batch of a stopped query was done with."""
    done = [p for p in query.recentProgress if p.sources and p.sources[0].endOffset]
    if done:
        told = done[-1].sources[0].endOffset  # JSON, or Python's way to write the same
        end = int(re.search(r"next\D+(\d+)", str(told)).group(1))  # type: ignore[union-attr]
        folder = Folder({"path": path})
        if end > folder.group(group):
            folder.put_number(f"groups/{group}", end)


class QueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a queue is appended to")
        return _Writer(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options, schema)


class _Reader(DataSourceReader):
    """All entries that the queue keeps; no group's place changes."""

    def __init__(self, options: dict[str, str]):
        self.folder = Folder(options)

    def partitions(self) -> list[InputPartition]:
        return ranges(self.folder, *self.folder.ends()) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows(self.folder, partition) if partition.name else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = Folder(options)
        self.group = options.get("group", "default")
        self.per_batch = int(options.get("perBatch", PER_BATCH))
        self.at = self.folder.group(self.group, options.get("start", "first"))

    def initialOffset(self) -> dict:
        return {"next": self.folder.group(self.group)}

    def latestOffset(self) -> dict:
        first, end = self.folder.ends()
        self.at = min(max(self.at, first) + self.per_batch, end) if end > self.at else self.at
        return {"next": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["next"])
        return ranges(self.folder, max(start["next"], self.folder.ends()[0]), end["next"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows(self.folder, partition)

    def commit(self, end: dict) -> None:
        if end["next"] > self.folder.group(self.group):
            self.folder.put_number(f"groups/{self.group}", end["next"])


class _Written:
    def __init__(self, options: dict[str, str], schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.folder, self.schema = Folder(options), to_arrow_schema(schema)
        self.name = options.get("writer") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pending:
        return self.folder.pending(iterator, self.schema)


class _Writer(_Written, DataSourceArrowWriter):
    def commit(self, messages: list[Pending]) -> None:
        self.folder.commit(messages, uuid.uuid4().hex)

    def abort(self, messages: list[Pending]) -> None:
        self.folder.abort(messages)


class _StreamWriter(_Written, DataSourceStreamArrowWriter):
    """With an option `writer`, a batch that Spark commits again after a failure is there once."""

    def commit(self, messages: list[Pending], batchId: int) -> None:
        self.folder.commit(messages, f"{self.name}_{batchId}")

    def abort(self, messages: list[Pending], batchId: int) -> None:
        self.folder.abort(messages)
