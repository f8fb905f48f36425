"""Approximate nearest neighbours in a hash-prefix forest.

Each of TREES trees gives every vector a string of DEPTH bits, the sides of random hyperplanes it lies on, and keeps
the vectors in the order of their strings: a sorted array, cut into cells of equal leading bits and blocks within.
Largest inner product is smallest angle once vectors have one more coordinate, sqrt(M - |x|^2); queries have 0 there.

Descending: a query goes to its cell of each tree, and in the sorted array there takes the strings that share the
longest prefix with its own, longer ones before shorter ones, until START vectors are seen. Ascending: in all trees a
query starts at the same prefix length, that under which about START vectors lie or AHEAD bits more than its k-th score
asks for, whichever is shorter, and gives up one bit a round, in all trees together; a round scores the vectors under
the bit just given up, its sibling, so none is scored twice in a tree by the ascent. A tree whose descent saw all under
a length takes part from there up only, so where neighbours stand out the descent is all. The k-th best score so far tells
how alike the k nearest are at least, hence how likely each is to share a prefix of the length reached in some tree: a
query stops at the first length at which that chance is SURE. There is no cap on candidates: where neighbours are
hardly closer than the rest, queries ascend nearly to the root and many vectors are scored; where they stand out, few
are. The column `scored` tells how many.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .vectors import BLOCK, TILE, best_of, finite, matrix, of_each_length, packed, ranked, unpack

TREES, DEPTH = 16, 48
#: Vectors that a query looks at in each tree before ascending.
START = 32
#: Least chance of a neighbour as far as the k-th so far to be met.
SURE = 0.9
#: Bits that the ascent starts below the length that the descent's k-th score asks for.
AHEAD = 2
#: Blocks of a cell that meet queries in one place.
TOGETHER = 16


def _planes(width: int, trees: int, depth: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((width, trees * depth))


def _strings(v: np.ndarray, planes: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(rows, trees): bits as an integer, the first one highest."""
    side = (v @ planes > 0).reshape(len(v), trees, depth)
    return side @ (1 << np.arange(depth - 1, -1, -1, dtype=np.int64))


def _hashed(planes, most: float, trees: int, depth: int, bits: int, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                v = matrix(part.column("v"))
                extra = np.zeros((len(v), 1)) if query else np.sqrt(np.maximum(most - (v**2).sum(axis=1), 0))[:, None]
                strings = _strings(np.concatenate((v, extra), axis=1), planes.value, trees, depth)
                n = len(v)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(np.repeat(part.column("vec_id").to_numpy(), trees)),
                    pa.array((strings >> (depth - bits)).ravel()), pa.array(strings.ravel()), part.column("v").take(pa.array(np.repeat(np.arange(n), trees))),
                ], names=["tree", "vec_id", "cell", "string", "v"])

    return run


_FOUND = "query_id long, vec_id long, score double, tree int, reached int"


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in batch.to_pylist():
            qs, q = unpack(row["ids"], row["data"])
            ids, x = unpack(row["x_ids"], row["x_data"], row["x_kind"])
            yield row, qs, q, np.frombuffer(row["string"], np.int64), ids, x.astype(np.float64), np.frombuffer(row["x_string"], np.int64)


def _result(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], qs: np.ndarray, met: np.ndarray, tree: int | None = None, reached: np.ndarray | None = None) -> pa.RecordBatch:
    """What was found, and a row without vec_id for the number of vectors that each query met and the length reached."""
    q, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    nulls = lambda n, kind: pa.array([None] * n, kind)
    last = nulls(len(qs), pa.int32()) if reached is None else pa.array(reached)
    columns = [
        pa.array(np.concatenate((q, qs))), pa.concat_arrays([pa.array(ids), nulls(len(qs), pa.int64())]), pa.array(np.concatenate((score, met.astype(float)))),
        pa.array([tree] * (len(q) + len(qs)), pa.int32()), pa.concat_arrays([nulls(len(q), pa.int32()), last]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "tree", "reached"])


def _descend(k: int, depth: int, start: int):
    """In one block's sorted array, the `start` strings with the longest prefixes in common with each query's.

    Tells the length from which on the block's strings were all looked at. Of very many strings under one prefix those
    around the query's place are taken; then none counts as done, and the ascent looks at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, qs, q, qstring, ids, x, xstring in _rows(batches):
            found, met, reached = [], np.zeros(len(qs)), np.zeros(len(qs), np.int32)
            for j in range(len(qs)):
                low, high = 0, len(ids)
                for bits in range(1, depth + 1):  # while enough strings share one bit more
                    head = qstring[j] >> (depth - bits) << (depth - bits)
                    a, b = np.searchsorted(xstring, [head, head + (1 << (depth - bits))])
                    if b - a < min(start, len(ids)):
                        break
                    low, high, reached[j] = a, b, bits
                if high - low > 4 * start:
                    low = max(low, min(int(np.searchsorted(xstring, qstring[j])) - 2 * start, high - 4 * start))
                    high, reached[j] = low + 4 * start, depth + 1
                met[j] = high - low
                found.append(best_of(q[j : j + 1] @ x[low:high].T, qs[j : j + 1], ids[low:high], k))
            yield _result(found, qs, met, row["tree"], reached)

    return run


def _under(k: int, depth: int):
    """All vectors of a block that lie under each query's prefix, of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, qs, q, qstring, ids, x, xstring in _rows(batches):
            length, least = np.frombuffer(row["length"], np.int64), np.frombuffer(row["least"], "<f8")
            shift = depth - length
            low = np.searchsorted(xstring, qstring >> shift << shift)
            high = np.searchsorted(xstring, (qstring >> shift) + 1 << shift)
            found = []
            for a, b in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):
                if a < b:
                    alike = (low == a) & (high == b)
                    found.append(best_of(q[alike] @ x[a:b].T, qs[alike], ids[a:b], k, least[alike]))
            if found:
                yield _result(found, qs, high - low)

    return run


_PACKED = (("query_id", "ids", "<i8"), ("string", "string", "<i8"), ("v", "data", "<f8"), ("length", "length", "<i8"), ("least", "least", "<f8"))


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the queries that go to a prefix together, up to TILE at once."""
    for batch in batches:
        rows = batch.to_pylist()
        if rows:
            packs = [pa.array([np.array([x[f] for x in r["qs"]], t).tobytes() for r in rows], pa.binary()) for f, _, t in _PACKED]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("size"), batch.column("prefix"), *packs], names=["tree", "size", "prefix", *[n for _, n, _ in _PACKED]])


def _meetings(asked: DataFrame, index: DataFrame, many: DataFrame, bits: int, depth: int) -> DataFrame:
    """Tiles of queries with all blocks of the cells under their prefixes.

    asked: tree, query_id, string, length, v, least. Queries that share the prefix, as far as cells tell it, make
    tiles; only a tile is listed with its cells, and with the places of a cell of many blocks.
    """
    size = F.least(F.col("length"), F.lit(bits)).cast("int")
    named = asked.withColumn("size", size).withColumn("prefix", F.call_function("shiftright", F.col("string"), F.lit(depth) - F.col("size")))
    sizes = named.groupBy("tree", "size", "prefix").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    salted = named.join(sizes, ["tree", "size", "prefix"]).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("tiles")))
    tiles = salted.groupBy("tree", "size", "prefix", "salt").agg(F.collect_list(F.struct(*[f for f, _, _ in _PACKED])).alias("qs"))
    tiles = tiles.select("tree", "size", "prefix", "qs").mapInArrow(_with_bytes, "tree int, size int, prefix long, " + ", ".join(f"{n} binary" for _, n, _ in _PACKED))
    first = F.call_function("shiftleft", F.col("prefix"), F.lit(bits) - F.col("size"))
    last = F.call_function("shiftleft", F.col("prefix") + 1, F.lit(bits) - F.col("size")) - 1
    listed = tiles.withColumn("cell", F.explode(F.sequence(first, last))).join(many, ["tree", "cell"], "left")
    return listed.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("places", F.lit(1)) - 1))).join(index, ["tree", "cell", "place"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, depth: int = DEPTH, sure: float = SURE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (double): the k largest inner products found for each query; and scored, how
    many vectors it met, those met in several trees counted each time.

    Queries: ids divisible by `every`; candidates: all rows but those with the query's id. Scores are those of the
    original vectors in double precision; ties go to the smaller vec_id. With fewer than k candidates all are
    returned. Rows with a null id, a null, empty or zero vector or a component that is null or not finite take no
    part. Vectors compare with those of their length, each length is searched for itself. Repeated rows count once; of
    one id with several vectors the best score counts. Every row is in the index; nothing is fitted. Other columns are
    not used. Empty input gives an empty result.
    """
    # Floats are kept as they are, in half the space; all sums are of doubles.
    kind, width_of = ("float", "<f4") if dict(vectors.dtypes)[vec_col] == "array<float>" else ("double", "<f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast(kind)).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = written(rows, "vectors")
    return of_each_length(rows, lambda r: _of_one_length(r, k, every, trees, depth, sure, kind, width_of), "query_id long, rank int, vec_id long, score double, scored long")


def _of_one_length(rows: DataFrame, k: int, every: int, trees: int, depth: int, sure: float, kind: str, width_of: str) -> DataFrame:
    spark = rows.sparkSession
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most, width = rows.agg(F.count(F.lit(1)), F.max(size), F.max(F.size("v"))).first()
    planes = spark.sparkContext.broadcast(_planes(width + 1, trees, depth))
    bits = int(min(depth // 2, max(0, np.ceil(np.log2(n / (2 * BLOCK))))))
    parts = max(shuffle_partitions(spark), n * trees // (16 * BLOCK))

    hashed = f"tree int, vec_id long, cell long, string long, v array<{kind}>"
    forest = packed(rows.mapInArrow(_hashed(planes, most, trees, depth, bits, False), hashed), ["tree", "cell"], ["string"], parts, BLOCK, width_of)
    forest = written(forest.select("tree", "cell", F.col("ids").alias("x_ids"), F.col("data").alias("x_data"), F.col("string").alias("x_string"), F.lit(width_of).alias("x_kind")), "forest")
    # Equal vectors can fill a cell with any number of blocks; these are dealt to several places.
    many = written(forest.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("places")).where("places > 1"), "large-cells")
    index = forest.join(many, ["tree", "cell"], "left").withColumn("place", F.pmod(F.xxhash64("x_ids"), F.coalesce("places", F.lit(1)))).drop("places")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.mapInArrow(_hashed(planes, most, trees, depth, bits, True), hashed).select("tree", F.col("vec_id").alias("query_id"), "string", "v")
    asked = written(asked, "queries")

    rounds: list[DataFrame] = []
    best: DataFrame | None = None

    def meet(queries: DataFrame, step) -> None:
        nonlocal best
        met = _meetings(queries, index, many, bits, depth)
        rounds.append(written(met.select("tree", *[n for _, n, _ in _PACKED], "x_ids", "x_string", "x_data", "x_kind").mapInArrow(step, _FOUND), "found"))
        found = rounds[-1].where("vec_id is not null").select("query_id", "vec_id", "score")
        best = written(ranked(found if best is None else found.unionByName(best.drop("rank")), k), "best")

    meet(asked.withColumns({"length": F.lit(bits).cast("long"), "least": F.lit(float("-inf"))}), _descend(k, depth, START))
    # All strings under this length were seen in a tree; blocks of one cell share `bits` bits at least.
    reached = rounds[0].where("vec_id is null").groupBy("tree", "query_id").agg(F.greatest(F.max("reached"), F.lit(bits)).alias("reached"))
    asked = written(asked.join(reached, ["tree", "query_id"], "left").withColumn("reached", F.coalesce("reached", F.lit(depth + 1))), "reached")
    norms = asked.where("tree = 0").select("query_id", F.sqrt(size).alias("norm"))
    one_tree = 1 - (1 - sure) ** (1 / trees)
    lowest = int(min(depth, max(1, np.floor(np.log2(max(n / START, 2))))))

    def so_far() -> DataFrame:
        """query_id, least: the k-th score, and enough: the longest prefix that neighbours as near share often enough."""
        kth = norms.join(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")), "query_id", "left")
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") / (F.col("norm") * float(np.sqrt(most)))))
        share = F.greatest(F.least(1 - F.acos(cosine) / F.pi(), F.lit(1 - 1e-9)), F.lit(1e-9))
        enough = F.coalesce(F.floor(F.log(F.lit(one_tree)) / F.log(share)), F.lit(0))
        return kth.select("query_id", F.coalesce("least", F.lit(float("-inf"))).alias("least"), enough.alias("enough"))

    def under(queries: DataFrame, sibling: bool) -> DataFrame:
        """What lies under the queries' prefixes of length `level`, or under those with the last bit turned over."""
        rows = asked.join(queries.select("query_id", "least", "level"), "query_id")
        turned = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth) - F.col("level")).cast("int"))
        string = F.col("string").bitwiseXOR(turned) if sibling else F.col("string")
        # Trees that the descent saw further up have nothing new; at the root one tree has all.
        rows = rows.where("reached >= level and (level > 1 or tree = 0)" if sibling else "reached > level")
        return rows.select("tree", "query_id", string.alias("string"), F.col("level").cast("long").alias("length"), "v", "least")

    # No query starts below the length that the descent's k-th asks for by more than AHEAD: it only gets longer. Where that
    # is a long one, it is all that a query has to look under.
    level = F.when(F.col("enough") >= lowest, F.col("enough")).otherwise(F.greatest(F.least(F.lit(lowest), F.col("enough") + AHEAD), F.lit(1)))
    started = written(so_far().withColumn("level", F.least(level, F.lit(depth)).cast("int")), "started")
    meet(under(started, False), _under(k, depth))
    for up in range(lowest):
        level = started.select("query_id", (F.col("level") - up).alias("level"))
        still = written(so_far().join(level, "query_id").where((F.col("enough") < F.col("level")) & (F.col("level") > 0)), "still")
        if still.isEmpty():
            break
        meet(under(still, True), _under(k, depth))
    met = reduce(DataFrame.unionByName, rounds).where("vec_id is null").groupBy("query_id").agg(F.sum("score").cast("long").alias("scored"))
    return best.join(met, "query_id")
