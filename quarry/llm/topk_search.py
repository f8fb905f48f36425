"""Exact top-k inner products by a pivot-distance index.

Largest inner product is nearest point once every vector x has one more coordinate, sqrt(M - |x|^2) with M the
largest squared length, and queries have 0 there: then |q - x|^2 = |q|^2 + M - 2 q.x. In that space each vector is
keyed by its nearest pivot and its distance to it; the distances around a pivot are cut into annuli. For each annulus
the least and the greatest distance to a few other pivots, its witnesses, are kept as well: a table of bounded size.

By the triangle inequality a vector of an annulus is no nearer to a query than the query's distances to pivot and
witnesses are off the annulus' ranges. A query takes the annuli in the order of that bound, from its own one outward:
in rounds of 1, 7, 56, ... it opens those that the bound does not put beyond its k-th best so far, and it stops
when the bound excludes all that are left. The bound has a margin above the rounding of distances; scores themselves
are exact. Where vectors hardly cluster, distances to any pivot are nearly alike and all annuli get opened: the column
`scored` tells how many vectors a query met.

Queries travel in tiles, index rows in blocks, and each meeting returns its k best per query at most, none below the
query's radius, so neither a vector that a third of the rows have nor a popular annulus gathers rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .vectors import BLOCK, TILE, best_of, finite, matrix, of_each_length, packed, ranked, unpack

#: Pivots come from about so many vectors, drawn by a hash of their id.
SAMPLE = 20_000
#: Vectors for each pivot, and the most pivots.
PER_PIVOT, MAX_PIVOTS = 2048, 256
#: Vectors in an annulus, the most annuli of a pivot, and other pivots whose distances bound an annulus.
RING, MAX_RINGS, WITNESSES = 1024, 64, 8
#: Blocks of an annulus that meet queries in one place, and how much further each round goes than all before it.
TOGETHER, GROWTH = 16, 8
#: Added to radii, relative to the largest length.
MARGIN = 1e-6


def floored(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def pivots_of(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n means of the sample, by Lloyd's rounds from evenly spread rows."""
    means = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        near = _distances(sample, means).argmin(axis=1)
        for p in range(n):
            if (near == p).any():
                means[p] = sample[near == p].mean(axis=0)
    return means


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate((v, np.sqrt(np.maximum(most - (v**2).sum(axis=1), 0))[:, None]), axis=1)


def _points(v: np.ndarray, most: float, query: bool) -> np.ndarray:
    return np.concatenate((v, np.zeros((len(v), 1))), axis=1) if query else _lifted(v, most)


def _keyed(pivots, most: float, query: bool):
    """Adds the nearest pivot and the distance to it, exact enough to be covered by MARGIN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = _distances(_points(matrix(batch.column("v")), most, query), pivots.value)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), batch.column("v")], names=["vec_id", "pivot", "dist", "v"])

    return run


def _ranges(pivots, most: float):
    """For each block the least and greatest distance to each witness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, v = unpack(row["ids"], row["data"], "<i8")
                d = _distances(_lifted(v.astype(float), most), pivots.value[:WITNESSES])
                w = d.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([row["pivot"]] * w, pa.int32()), pa.array([row["ring"]] * w, pa.int32()), pa.array(np.arange(w, dtype=np.int32)), pa.array(d.min(axis=0)), pa.array(d.max(axis=0))], names=["pivot", "ring", "witness", "low", "high"])

    return run


class _Annuli:
    """The annuli by number: pivot, ring, places where their blocks are, and ranges of distances."""

    def __init__(self, pivots: np.ndarray, cells: list, ranges: list):
        self.pivots = pivots
        cells = sorted(cells, key=lambda r: (r["pivot"], r["ring"]))
        self.number = {(r["pivot"], r["ring"]): i for i, r in enumerate(cells)}
        self.pivot = np.array([r["pivot"] for r in cells])
        self.low, self.high = np.array([r["low"] for r in cells]), np.array([r["high"] for r in cells])
        self.places = np.array([-(-r["blocks"] // TOGETHER) for r in cells])
        w = min(WITNESSES, len(pivots))
        self.wlow, self.whigh = np.zeros((len(cells), w)), np.zeros((len(cells), w))
        for r in ranges:
            at = self.number[r["pivot"], r["ring"]]
            self.wlow[at, r["witness"]], self.whigh[at, r["witness"]] = r["low"], r["high"]

    def bounds(self, q: np.ndarray, cells: slice | np.ndarray = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(queries, annuli): how near a vector of an annulus can be at least, and how far its middle seems."""
        d = _distances(np.concatenate((q, np.zeros((len(q), 1))), axis=1).astype(float), self.pivots)
        own = d[:, self.pivot[cells]]
        least = np.maximum(np.maximum(self.low[cells] - own, own - self.high[cells]), 0)
        far = np.abs((self.low[cells] + self.high[cells]) / 2 - own)
        for j in range(self.wlow.shape[1]):
            low, high, w = self.wlow[cells, j], self.whigh[cells, j], d[:, j : j + 1]
            least = np.maximum(least, np.maximum(low - w, w - high))
            far = np.maximum(far, np.abs((low + high) / 2 - w))
        return least, far


def _exact(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products. Below 2^53 all partial sums are exact in doubles too, and far faster."""
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _radius(q: np.ndarray, least: np.ndarray, most: float) -> np.ndarray:
    r = np.sqrt(np.maximum((q.astype(float) ** 2).sum(axis=1) + most - 2 * np.maximum(least, -most), 0))
    return r + MARGIN * (1 + np.sqrt(most))


def _expand(annuli, most: float, start: int, stop: int):
    """The annuli from place `start` on and before `stop` in each tile's order that may hold something better, once for
    each place of their blocks; and in a row with annulus -1 how many beyond `stop` may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = annuli.value
        for batch in batches:
            for tile, ids, data, least in zip(*(batch.column(c).to_pylist() for c in ("tile", "ids", "data", "least")), strict=True):
                _, v = unpack(ids, data, "<i8")
                bound, far = a.bounds(v)
                order = np.lexsort((far.mean(axis=0), bound.min(axis=0)))
                may = (bound <= _radius(v, np.frombuffer(least, "<f8"), most)[:, None]).any(axis=0)[order]
                now = order[start:stop][may[start:stop]]
                n = a.places[now]
                cell = np.append(np.repeat(now, n), -1)
                place = np.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), int(may[stop:].sum()))
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(cell), pa.int64()), pa.array(cell.astype(np.int32)), pa.array(place.astype(np.int64))], names=["tile", "cell", "place"])

    return run


_FOUND = "query_id long, vec_id long, score long"


def _scored(k: int, most: float, annuli):
    """Meets tiles with blocks; queries that the bound keeps out, and scores under a query's `least`, are left out. A
    row without vec_id counts the vectors that a query met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qs, q = unpack(row["ids"], row["data"], "<i8")
                least = np.frombuffer(row["least"], "<f8")
                bound, _ = annuli.value.bounds(q, np.array([row["cell"]]))
                near = bound[:, 0] <= _radius(q, least, most)
                qs, q, least = qs[near], q[near], least[near]
                if len(qs):
                    ids, v = unpack(row["x_ids"], row["x_data"], "<i8")
                    a, b, c = best_of(_exact(q, v, most), qs, ids, k, least)
                    met = pa.array([None] * len(qs), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, qs))), pa.concat_arrays([pa.array(b), met]), pa.array(np.concatenate((c, np.full(len(qs), len(ids)))))], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): the k largest integer inner products of each query; and scored, how
    many vectors the query was compared with.

    Components become floor(scale * x). Queries: ids divisible by `every`; candidates: all rows but those with the
    query's id. Ties go to the smaller vec_id; with fewer than k candidates all are returned. Rows with a null id, a
    null or empty vector or a component that is null or not finite take no part. Vectors compare with those of their
    length, each length is searched for itself. Repeated rows count once; of one id with several vectors the best score
    counts. Components and inner products have to fit 64 bits: beyond, ArithmeticException. Empty input gives an empty
    result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    rows = written(rows.select("vec_id", floored(F.col("v"), scale).alias("v")), "vectors")
    return of_each_length(rows, lambda r: _of_one_length(r, k, every), "query_id long, rank int, vec_id long, score long, scored long")


def _of_one_length(rows: DataFrame, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most = rows.agg(F.count(F.lit(1)), F.max(size)).first()
    if most >= 2.0**62:
        raise ArithmeticError("inner products of these vectors do not fit 64 bits")
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, SAMPLE / n)))).orderBy("vec_id").limit(2 * SAMPLE).toPandas()
    sample = _lifted(np.array(drawn["v"].tolist() or [rows.first()["v"]], float), most)
    pivots = pivots_of(sample, int(min(MAX_PIVOTS, max(1, n // PER_PIVOT), len(sample))))
    sent = spark.sparkContext.broadcast(pivots)
    parts = max(shuffle_partitions(spark), n // (16 * BLOCK))

    # The index: blocks of annuli. Where annuli begin matters for speed only.
    keyed = rows.mapInArrow(_keyed(sent, most, False), "vec_id long, pivot int, dist double, v array<bigint>")
    cuts = keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", [i / MAX_RINGS for i in range(1, MAX_RINGS)], 1000).alias("at"))
    begins = {r["pivot"]: r["at"][:: -(-MAX_RINGS // max(1, min(MAX_RINGS, r["n"] // RING)))] if r["n"] >= 2 * RING else [] for r in cuts.collect()}
    begin = F.element_at(F.create_map(*[x for p, at in sorted(begins.items()) for x in (F.lit(p), F.array(*map(F.lit, at)).cast("array<double>"))]), F.col("pivot"))
    ringed = keyed.withColumn("ring", F.size(F.filter(begin, lambda b: b <= F.col("dist"))))
    index = written(packed(ringed, ["pivot", "ring"], ["dist"], parts, BLOCK, "<i8").drop("dist", "members"), "index")
    cells = index.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("blocks"), F.min("low_dist").alias("low"), F.max("high_dist").alias("high"))
    ranges = index.select("pivot", "ring", "ids", "data").mapInArrow(_ranges(sent, most), "pivot int, ring int, witness int, low double, high double")
    ranges = ranges.groupBy("pivot", "ring", "witness").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    annuli = _Annuli(pivots, cells.collect(), ranges.collect())  # MAX_PIVOTS * MAX_RINGS * WITNESSES rows at most
    known = spark.sparkContext.broadcast(annuli)
    numbers = spark.createDataFrame([(*key, i, int(annuli.places[i])) for key, i in annuli.number.items()], "pivot int, ring int, cell int, places long")
    blocks = index.join(F.broadcast(numbers), ["pivot", "ring"]).select("cell", F.pmod(F.xxhash64("ids", "data"), F.col("places")).alias("place"), F.col("ids").alias("x_ids"), F.col("data").alias("x_data"))

    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.mapInArrow(_keyed(sent, most, True), "vec_id long, pivot int, dist double, v array<bigint>")
    tiles = packed(asked, ["pivot"], ["dist"], max(1, min(parts, n // (every * TILE))), TILE, "<i8")
    tiles = written(tiles.select(F.xxhash64("pivot", "ids").alias("tile"), "ids", "data", "members"), "tiles")

    best: DataFrame | None = None
    rounds: list[DataFrame] = []
    start, stop = 0, 1
    while start < len(annuli.low):
        state = written(_with_least(tiles, best, k), "state")
        opened = written(state.mapInArrow(_expand(known, most, start, stop), "tile long, cell int, place long"), "opened")
        meet = opened.where("cell >= 0").join(state, "tile").join(blocks, ["cell", "place"])
        new = written(meet.select("cell", "ids", "data", "least", "x_ids", "x_data").mapInArrow(_scored(k, most, known), _FOUND), "found")
        rounds.append(new)
        found = new.where("vec_id is not null")
        best = written(ranked(found if best is None else found.unionByName(best.drop("rank")), k), "best")
        if not opened.where("cell < 0 and place > 0").limit(1).count():
            break
        start, stop = stop, GROWTH * stop
    met = reduce(DataFrame.unionByName, rounds).where("vec_id is null").groupBy("query_id").agg(F.sum("score").alias("scored"))
    return best.join(met, "query_id")


def _with_least(tiles: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """tiles with `least`, the k-th score of each query so far."""
    singles = tiles.select("tile", F.posexplode("members").alias("at", "query_id"))
    if best is None:
        singles = singles.withColumn("least", F.lit(None).cast("double"))
    else:
        singles = singles.join(best.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least")), "query_id", "left")
    least = singles.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("least", F.lit(-(2.0**62))).alias("least")))).alias("l"))
    rows = tiles.select("tile", "ids", "data").join(least, "tile").select("tile", "ids", "data", F.col("l.least").alias("least"))
    return rows.mapInArrow(_least_bytes, "tile long, ids binary, data binary, least binary")


def _least_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = [np.array(x, "<f8").tobytes() for x in batch.column("least").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("tile"), batch.column("ids"), batch.column("data"), pa.array(least, pa.binary())], names=["tile", "ids", "data", "least"])
