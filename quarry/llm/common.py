"""Helpers shared by the corpus operators: inputs, written intermediates, key digests, numbers of equal rows."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that are numbered together.
PIECE_BITS = 12
#: Bytes of an Arrow batch of texts, and the setting that bounds them. Spark's own bound is 64 MB, which a task holds several
#: times: as the JVM's vectors, which double as they grow, as the message, and in Python.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_own_dir: dict[str, str] = {}
#: Where fresh_path lists what it names, in this thread.
_run: ContextVar[list[str] | None] = ContextVar("_run", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder, but only if all of Spark is in this process (tests): executors on other
    machines would each write to a folder of their own.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own_dir:
        _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _own_dir[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    if (made := _run.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates() -> Iterator[list[str]]:
    """The paths of the tables that this thread writes inside: those of one run, whatever else runs in the application."""
    made: list[str] = []
    token = _run.set(made)
    try:
        yield made
    finally:
        _run.reset(token)


def clear(spark: SparkSession, made: list[str]) -> None:
    """Deletes a run's intermediate tables. Results of them that are not written yet cannot be computed any more."""
    while made:
        at = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives memory back when its task ends: a worker lives on between tasks, and what it has freed
    counts for its executor until then."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return task


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have at most BATCH_BYTES, and one row where that is larger. A lower bound of the
    user's stays. Narrow rows keep the batches that Spark's bound on rows gives them."""
    n, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get(BATCH_CONF).strip().lower()).groups()
    if int(n) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def digest(*cols: Column) -> list[Column]:
    """Two 64-bit digests under different seeds: together a 128-bit key for grouping by long values."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols, F.lit(2)).alias("h2")]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of keys, null to null."""
    return reduce(and_, [a[k].eqNullSafe(b[k]) for k in keys])


def numbered(rows: DataFrame, keys: list[str], name: str = "nth") -> DataFrame:
    """rows with `name`: 0, 1, ... among the rows that agree in keys, in any order.

    Most keys occur once; the others' rows are numbered inside pieces of a bounded number of rows, and pieces by a
    running sum of their sizes, so a key that a third of all rows have is spread over many tasks.
    """
    often = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "repeated")
    once = rows.join(often, same(rows, often, keys), "left_anti").withColumn(name, F.lit(0).cast("long"))
    again = rows.join(often, same(rows, often, keys), "left_semi").withColumn("_at", F.monotonically_increasing_id())
    again = written(again, "repeats").withColumn("_piece", F.shiftright("_at", PIECE_BITS))
    again = again.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy("_at")))
    sizes = again.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate([*keys, "_piece"])], F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate([*keys, "_piece"])])
    there = again.join(sizes, on).select(*rows.columns, (F.col("_before") + F.col("_k") - 1).alias(name))
    return once.unionByName(there)


def carried(docs: DataFrame, text: Column, keep: list[str] | None, new: list[str]) -> tuple[DataFrame, list[Column]]:
    """(rows, columns): rows of a text and, in one struct `kept`, the columns `keep` (all by default) of docs; and what
    selects them again. In a struct, no name of theirs clashes with one of an Arrow function's. Columns named like a
    new one are left out. Batches of texts are small from here on."""
    small_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    kept = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("boolean")
    return docs.select(kept.alias("kept"), text.alias("text")), [F.col("kept").getField(c).alias(c) for c in names]
