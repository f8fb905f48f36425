"""Vectors packed into blocks: the shape in which the search operators keep an index and meet it with queries.

A block is one row with a matrix of a bounded number of vectors, so a join of query tiles with blocks moves a few
large rows, and their scores are one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a block of an index, and in a tile of queries.
BLOCK, TILE = 1024, 256
#: Lengths of vectors in one table.
MAX_LENGTHS = 64


def finite(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null, NaN or infinite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def of_each_length(rows: DataFrame, search: Callable[[DataFrame], DataFrame], empty: str) -> DataFrame:
    """What `search` finds among the rows (vec_id, v) of each length, as no others compare; without rows, an empty
    DataFrame of the schema `empty`."""
    lengths = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.lit(1)).orderBy("d").limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths: each length is an index of its own")
    found = [search(rows.where(F.size("v") == d) if len(lengths) > 1 else rows) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], empty)


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def packed(rows: DataFrame, keys: list[str], order: list[str], parts: int, size: int = BLOCK, dtype: str = "<f8") -> DataFrame:
    """Rows (keys..., order..., vec_id, v) sorted by keys, order and vec_id over all partitions, cut into blocks.

    A block holds up to `size` neighbours that agree in keys: (keys..., n, members, ids, data, low_x and high_x and x for each
    x of order). Equal keys split freely, so a value that a third of the rows have makes more blocks, not larger
    ones. A row that repeats its neighbour is left out.
    """
    columns = [*keys, *order, "vec_id"]
    ranged = rows.select(*columns, "v").repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    kinds = dict(rows.dtypes)
    fields = [f"{k} {kinds[k]}" for k in keys] + ["n int", "members array<bigint>", "ids binary", "data binary"]
    fields += [f"low_{x} {kinds[x]}, high_{x} {kinds[x]}, {x} binary" for x in order]
    names = [x.split()[0] for f in fields for x in f.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def cut(table: pa.Table, end: bool):
            """Blocks of a table; without `end`, the rows that may still belong to a block with the next ones stay."""
            n = table.num_rows
            ks = [table.column(k).to_numpy() for k in keys]
            new = np.ones(n + 1, bool)
            if n:
                new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in ks]) if ks else False
            starts = np.flatnonzero(new)
            out, done = [], 0
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                for i in range(a, b, size):
                    j = min(i + size, b)
                    if not end and j == n:
                        return out, table.slice(i)
                    out.append(block(table.slice(i, j - i)))
                    done = j
            return out, table.slice(done)

        def block(t: pa.Table):
            v = matrix(t.column("v").combine_chunks())
            ids = t.column("vec_id").to_numpy()
            own = [t.column(x).to_numpy() for x in order]
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | (v[1:] != v[:-1]).any(axis=1)
            row = [t.column(k)[0].as_py() for k in keys] + [int(fresh.sum()), ids[fresh].tolist(), ids[fresh].astype("<i8").tobytes(), v[fresh].astype(dtype).tobytes()]
            for x in own:
                row += [x[0].item(), x[-1].item(), x[fresh].tobytes()]
            return row

        rest = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None or not rest.num_rows else pa.concat_tables([rest, table])
            rows_, rest = cut(table, False)
            if rows_:
                yield _batch(rows_, names, schema)
        if rest is not None and rest.num_rows:
            yield _batch(cut(rest, True)[0], names, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(", ".join(fields))
    schema = to_arrow_schema(spark_schema)
    return ranged.mapInArrow(run, spark_schema)


def _batch(rows: list[list], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=schema)


def unpack(ids: bytes, data: bytes, dtype: str = "<f8") -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, dtype).reshape(len(i), -1)


def best_of(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, score) of the k best of each row of scores, with all that tie at the end of k.

    A query's own id is no candidate; neither is a score under `least` (of each query) or outside `allowed`.
    """
    ok = ids[None, :] != query_ids[:, None]
    if allowed is not None:
        ok &= allowed
    if least is not None:
        ok &= scores >= least[:, None]
    k += len(ids) - len(np.unique(ids))  # ids that occur again must not crowd out others
    if scores.shape[1] > k:
        low = np.iinfo(scores.dtype).min if scores.dtype.kind == "i" else -np.inf
        kth = np.partition(np.where(ok, scores, low), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        ok &= scores >= kth[:, None]
    r, c = np.nonzero(ok)
    s = scores[r, c]
    order = np.lexsort((ids[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    first = np.searchsorted(r, np.arange(len(query_ids)))
    kept = np.arange(len(r)) - first[r] < k
    return query_ids[r[kept]], ids[c[kept]], s[kept]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all that was found, each vec_id once, ties to the smaller one."""
    from pyspark.sql import Window

    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
