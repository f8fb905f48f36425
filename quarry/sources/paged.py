"""A paged scan of a large table as a data source: partitions by ranges of a key, filters pushed to the store.

    spark.read.format("quarry_paged").option("path", p).option("key", "o_orderkey").load().where("o_totalprice > 1000")

In place of offsets, which read all that they skip, each task takes a range of the key's values and goes through it in
pages of a bounded number of rows. Filters that compare a column with constants go to the store, which skips row groups
by their statistics; Spark applies the others. The store here is a folder of Parquet files read through Arrow.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

FORMAT = "quarry_paged"
#: Rows of a page, and key ranges that tasks take.
PAGE, RANGES = 1000, 16


def register(spark: SparkSession) -> None:
    """Makes the format known; Spark asks Python sources for filters only if told to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


_COMPARED = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


def expression(filter_: Filter) -> pc.Expression | None:
    """A pushed filter as the store's own; None if it has none."""
    if len(filter_.attribute) != 1:
        return None
    column = pc.field(filter_.attribute[0])
    if isinstance(filter_, In):
        return column.isin(list(filter_.value))
    if isinstance(filter_, IsNotNull):
        return column.is_valid()
    if isinstance(filter_, IsNull):
        return column.is_null()
    if type(filter_) in _COMPARED and filter_.value is not None:
        value = pc.scalar(filter_.value)
        return {"equal": column == value, "greater": column > value, "greater_equal": column >= value, "less": column < value, "less_equal": column <= value}[_COMPARED[type(filter_)]]
    return None


@dataclass
class KeyRange(InputPartition):
    """Keys from low on and under high; None is open. The rows without a key are a range of their own."""

    low: int | None
    high: int | None
    nulls: bool = False


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _dataset(self) -> ds.Dataset:
        return dataset(self.options["path"])

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._dataset().schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)


def dataset(path: str) -> ds.Dataset:
    fs, at = afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)
    return ds.dataset(at, filesystem=fs, format="parquet")


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.key = options["path"], options["key"]
        self.page, self.ranges = int(options.get("page", PAGE)), int(options.get("ranges", RANGES))
        self.columns = [f.name for f in schema.fields]
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if expression(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def bounds(self) -> tuple[int, int] | None:
        """The least and the greatest key, by the files' statistics alone."""
        low, high = math.inf, -math.inf
        for fragment in dataset(self.path).get_fragments():
            for group in fragment.row_groups:
                told = group.statistics.get(self.key) if group.statistics else None
                if told and told["min"] is not None:
                    low, high = min(low, told["min"]), max(high, told["max"])
        return None if low > high else (int(low), int(high))

    def partitions(self) -> list[InputPartition]:
        ends = self.bounds()
        if ends is None:
            return [KeyRange(None, None), KeyRange(None, None, True)]
        step = max(1, -(-(ends[1] - ends[0] + 1) // self.ranges))
        cuts = list(range(ends[0] + step, ends[1] + 1, step))
        return [KeyRange(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)] + [KeyRange(None, None, True)]

    def condition(self, part: KeyRange) -> pc.Expression:
        key = pc.field(self.key)
        own = key.is_null() if part.nulls else key.is_valid()
        if part.low is not None:
            own = own & (key >= part.low)
        if part.high is not None:
            own = own & (key < part.high)
        for f in self.pushed:
            own = own & expression(f)
        return own

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        for page in dataset(self.path).to_batches(columns=self.columns, filter=self.condition(partition), batch_size=self.page):
            if len(page):
                yield page
