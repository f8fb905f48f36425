"""A stored index of vectors: cells around centroids, each a folder of Parquet files, of which a query reads a few.

Cosine is the measure. Centroids come from k-means over a bounded sample; every vector is put in the cell of its
nearest one. A query meets the vectors of its `nprobe` nearest cells. Cells are the files' partition column, and which
of them are asked for is known before the scan starts: Spark prunes the other folders (dynamic partition pruning).
With nprobe as large as the number of cells results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import CORPUS_TILE, QUERY_TILE, best_in_tile, ranking_schema, scalar_filter, top_k, unit_vectors

#: Vectors that centroids are fitted to, about, and rounds of it; the most cells, which are broadcast with their centroids.
SAMPLE, ROUNDS, MAX_CELLS = 100_000, 8, 16_384
#: Vectors in a cell, about, unless the number of cells is given.
PER_CELL = 1000
NPROBE = 16


def _nearest_cells(centroids, n: int, query: bool):
    """The nearest cell of each vector, or the n nearest of each query with the query as a unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                for width, at, x in unit_vectors(part.column("v")):
                    if width != c.shape[1] or not len(at):
                        continue
                    score = np.round(x @ c.T, 12)
                    near = np.argsort(-score, axis=1, kind="stable")[:, :n]
                    rows = pa.array(np.repeat(at, near.shape[1]))
                    if query:
                        flat = pa.array(np.repeat(x, near.shape[1], axis=0).ravel())
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
                        yield pa.RecordBatch.from_arrays([part.column("id").take(rows), pa.array(near.ravel().astype(np.int32)), lists], names=["qid", "cell", "q"])
                    else:
                        yield pa.RecordBatch.from_arrays([part.column("kept").take(rows), pa.array(near.ravel().astype(np.int32))], names=["kept", "cell"])

    return run


def fitted(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centroids, by k-means in the cosine's sense over about `sample` of the vectors (id, vector), drawn by a hash
    of their ids."""
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = corpus.where(F.forall("vector", lambda x: x.isNotNull())).where((norm > 0) & (norm < float("inf"))).select("id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    sizes = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return np.zeros((0, 1))
    n, width = sizes["count"], sizes["d"]
    cells = min(cells or max(1, n // PER_CELL), MAX_CELLS, n)
    share = min(1.0, max(sample, 32 * cells) / n)
    drawn = whole.where((F.size("v") == width) & (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    drawn = drawn.select(array_to_vector("v").alias("features")).cache()
    try:
        model = KMeans(k=cells, distanceMeasure="cosine", initMode="random", maxIter=ROUNDS, seed=seed).fit(drawn)
    finally:
        drawn.unpersist()
    centres = np.array(model.clusterCenters())
    return centres / np.sqrt((centres**2).sum(axis=1))[:, None]


def build(corpus: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Writes an index of corpus (id, vector, and columns to filter by) to a folder: `vectors`, by cell, `cells` with the
    number of vectors of each, and `centroids`.

    Vectors of the most common length are indexed; those null or zero, or with a null or non-finite component, are not.
    A cell with many of the rows is several files, and no task writes it alone.
    """
    spark = corpus.sparkSession
    centroids = fitted(corpus.select("id", "vector"), cells, sample)
    sent = spark.sparkContext.broadcast(centroids)
    kept = F.struct(*[F.col(f"`{c}`") for c in corpus.columns])
    rows = corpus.where(F.forall("vector", lambda x: x.isNotNull())).select(kept.alias("kept"), F.col("vector").alias("v"))
    schema = T.StructType([rows.schema["kept"], T.StructField("cell", T.IntegerType())])
    placed = rows.mapInArrow(_nearest_cells(sent, 1, False), schema)
    columns = [F.col("kept").getField(c).alias(c) for c in corpus.columns]
    placed.select(*columns, "cell").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    listed = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(listed, "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
    _vectors(spark, path, corpus.schema).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/cells")
    return centroids


def _vectors(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    if schema is None:
        return spark.read.parquet(f"{path}/vectors")
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())])).parquet(f"{path}/vectors")


def _compare(k: int):
    """The k best of each query of a tile among one piece of a cell."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"qid": left.column("qid").slice(0, 0), "id": right.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        q = left.column("q").combine_chunks().flatten().to_numpy().reshape(left.num_rows, -1)
        out = []
        for width, at, x in unit_vectors(right.column("vector").combine_chunks()):
            if width == q.shape[1] and len(at):
                scores = np.round(q @ x.T, 12)
                r, c = best_in_tile(scores, k)
                out.append(pa.table({"qid": left.column("qid").take(pa.array(r)), "id": right.column("id").take(pa.array(at[c])), "score": pa.array(scores[r, c])}))
        return pa.concat_tables(out) if out else none

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, nprobe: int = NPROBE, filters: Mapping[str, object] | None = None) -> DataFrame:
    """(qid, id, rank, score): the k best of the queries' nprobe nearest cells. queries: qid, qvector.

    Filters on the corpus' columns go to the scan. Cells meet queries in pieces of CORPUS_TILE vectors and tiles of
    QUERY_TILE queries, so neither a large cell nor a cell that many ask for gathers in one task. Queries that are null,
    zero or of another length find nothing.
    """
    listed = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MAX_CELLS at most
    centroids = spark.sparkContext.broadcast(np.array([r["centroid"] for r in listed], float).reshape(len(listed), -1))
    vectors = _vectors(spark, path)
    qid = T.StructField("qid", queries.schema["qid"].dataType)
    asked = queries.where("qvector is not null").select(F.col("qid").alias("id"), F.col("qvector").alias("v"))
    probes = asked.mapInArrow(_nearest_cells(centroids, min(nprobe, max(len(listed), 1)), True), T.StructType([qid, *T.StructType.fromDDL("cell int, q array<double>")]))
    sizes = spark.read.parquet(f"{path}/cells").select("cell", F.ceil(F.col("n") / CORPUS_TILE).alias("pieces"))
    busy = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_TILE).alias("tiles")).where("cell >= 0")
    met = F.broadcast(busy.join(F.broadcast(sizes), "cell"))  # a row for each cell at most
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = probes.join(met, "cell").withColumn("tile", F.pmod(F.xxhash64("qid"), F.col("tiles"))).withColumn("piece", up_to("pieces"))
    rows = vectors.where(scalar_filter(filters or {})).select("cell", "id", "vector").join(met, "cell")
    right = rows.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).withColumn("tile", up_to("tiles"))
    keys = ["cell", "piece", "tile"]
    pairs = left.select(*keys, "qid", "q").groupBy(*keys).cogroup(right.select(*keys, "id", "vector").groupBy(*keys))
    return top_k(pairs.applyInArrow(_compare(k), ranking_schema(queries, vectors)), k)
