"""Token counts of documents in flat token files that have no index.

A file is a run of little-endian integers in which an identifier ends each document. Files are read in blocks: in
each, one vectorised search finds the separators. A block tells the lengths of the documents that lie between two of
its separators, and where its first and last ones are. Documents that cross blocks are stitched by a prefix scan over
the blocks' last separators, a row for each block, so a file of any size is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of a file that are searched at once; a multiple of every width.
BLOCK_BYTES = 8 << 20
SUFFIX = ".tokens"


#: Names that Spark has for file systems which the Arrow library knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = uri.partition("://")
    if scheme in SCHEMES:
        uri = f"{SCHEMES[scheme]}://{rest}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, encode: Callable[[list[str]], Iterator[np.ndarray]], end: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """Writes docs to flat token files in folder, one for each task, and returns (file, ordinal, doc_id) of what is in them.

    folder: a URI that all executors reach. A task that runs again writes another file; only the files of tasks that
    ended well are in the result. Null texts are documents without tokens; null ids and repeated rows are documents of
    their own. An id that dtype cannot hold, or that is the separator, is an error: it would read back as another one.
    """
    most = np.iinfo(dtype).max
    if not 0 <= end <= most:
        raise ValueError(f"the separator {end} does not fit {dtype}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(folder)
        system.create_dir(at, recursive=True)
        name, n, sink = f"{uuid.uuid4().hex}{SUFFIX}", 0, None
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                sink = sink or system.open_output_stream(f"{at}/{name}")
                for ids in encode(part.column("text").to_pylist()):
                    if len(ids) and (ids.max() > most or (ids == end).any()):
                        raise ValueError(f"a token id is above {most} or the separator {end}")
                    sink.write(np.append(ids, end).astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(n, n + len(part))), part.column("doc_id")], names=["file", "ordinal", "doc_id"])
                n += len(part)
        if sink:
            sink.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-manifest")


def _searched(end: int, dtype: str, block_bytes: int):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, size in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "size")), strict=True):
                system, at = _open(path)
                with system.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(size, block * block_bytes), dtype)
                ends = np.flatnonzero(ids == end) + block * (block_bytes // width)
                first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (None, None)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()),
                    pa.array([block * (block_bytes // width) + len(ids)], pa.int64()), pa.array([np.diff(ends) - 1], pa.list_(pa.int64())),
                ], names=["path", "block", "ends", "first", "last", "stop", "inner"])

    return run


def token_counts(spark: SparkSession, folder: str, end: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in the token files of a folder.

    ordinal counts a file's documents from 0; the separator is no token of a document.
    Tokens after the last separator are a document with closed = false. Bytes too few for a token at the end of a file
    are ignored. block_bytes is a multiple of the width of an id.
    Empty files hold no documents; a folder without token files gives an empty result.
    """
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", (F.col("length") - F.col("length") % width).alias("length")).where("length > 0")
    last = F.ceil(F.col("length") / block_bytes) - 1
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.select("path", "block", F.least(F.lit(block_bytes), F.col("length") - F.col("block") * block_bytes).cast("long").alias("size")).repartition("path", "block")
    found = blocks.mapInArrow(_searched(end, dtype, block_bytes), "path string, block long, ends long, first long, last long, stop long, inner array<bigint>")
    found = written(found, "token-blocks")

    # The prefix scan, over rows without the lengths.
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("path", "block", "ends", "last")
    scan = scan.select("path", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("earlier"), F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("previous"), F.lead("block").over(order).alias("later"))
    stitched = found.join(scan, ["path", "block"])
    head = F.when(F.col("ends") > 0, F.array(F.col("first") - F.col("previous") - 1)).otherwise(F.array().cast("array<bigint>"))
    lengths = F.concat(head, F.col("inner"))
    tail = F.col("stop") - F.coalesce("last", "previous") - 1
    file = F.element_at(F.split("path", "/"), -1)
    inside = stitched.select(file.alias("file"), "earlier", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("earlier") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    open_ = stitched.where(F.col("later").isNull() & (tail > 0)).select(file.alias("file"), (F.col("earlier") + F.col("ends")).alias("ordinal"), tail.alias("n_tokens"), F.lit(False).alias("closed"))
    return inside.unionByName(open_)
