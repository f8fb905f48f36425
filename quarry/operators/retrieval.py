"""Retrieval: dense and BM25 rankings of many queries at once, fused, reranked and cut where scores drop.

Queries are a DataFrame. A ranking is rows (qid, id, score), a fused one has the best first by rank.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import first_json_object, tokens

RRF_K = 60
K1, B = 1.2, 0.75
#: Vectors of the corpus, and of queries, in a tile: their products have a million cells, 8 MB.
CORPUS_TILE, QUERY_TILE = 4096, 256
#: Texts that are embedded at once.
TEXTS_AT_ONCE = 256
#: Query vectors that are sent to all tasks at once, and terms of queries that are.
BROADCAST_ROWS, TERMS_SENT = 10_000, 5_000
#: Pairs of query and term that are.
PAIRS_SENT = 200_000
#: Bytes of files that are one partition, about; counted tokens in one batch of rows.
SPLIT_BYTES, ROWS_OUT = 64 << 20, 50_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double precision; null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def scalar_filter(filters: Mapping[str, object]) -> Column:
    """Lists become IN, scalars equality, all joined by AND; empty values do not filter."""
    parts = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in filters.items() if v not in (None, "", [], ())]
    return reduce(and_, parts, F.lit(True))


def top_k(ranking: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id, with rank from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return ranking.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if the files it reads are so small that they may be fewer: a small
    file is one partition, whatever its rows cost to work on. Tells by sizes, without a job; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if read_bytes(df) < cores * SPLIT_BYTES else df


def read_bytes(df: DataFrame) -> int:
    """Bytes of what df reads, by Spark's statistics, without a job; beyond any real size if Spark does not know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


#: (length, rows, matrix) of the rows of an Arrow column that have a direction, as unit vectors.
Vectors = Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray]]]
#: Texts, null ones among them, to a matrix with a row for each.
Embed = Callable[[list], np.ndarray]


def tiles(rows: DataFrame, id_col: str, vector_col: str, size: int, prefix: str, vectors: Vectors | None = None) -> DataFrame:
    """Vectors as unit vectors in tiles of up to `size`, made where they are: rows ({prefix}ids array, {prefix}width int,
    {prefix}data binary). Null and zero vectors, and those with a null or non-finite component, are in none."""
    ids = rows.schema[id_col].dataType
    schema = T.StructType([T.StructField(f"{prefix}ids", T.ArrayType(ids)), T.StructField(f"{prefix}width", T.IntegerType()), T.StructField(f"{prefix}data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, keys, x in _cut(batches, size, vectors or unit_vectors):
            lists = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([lists, pa.array([width], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=schema.names)

    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, schema)


def _cut(batches: Iterator[pa.RecordBatch], size: int, vectors: Vectors) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, ids, matrix) of up to `size` unit vectors of one length each, of batches (id, v)."""
    held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

    def cut(width: int, end: bool) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        own = held.get(width, [])
        if not own or (not end and sum(len(x) for _, x in own) < size):
            return
        keys, x = pa.concat_arrays([k for k, _ in own]), np.concatenate([v for _, v in own])
        whole = len(x) if end else len(x) // size * size
        for i in range(0, whole, size):
            yield width, keys.slice(i, min(size, whole - i)), x[i : min(i + size, whole)]
        held[width] = [(keys.slice(whole), x[whole:])]

    for batch in batches:
        for width, at, x in vectors(batch.column("v")):
            held.setdefault(width, []).append((batch.column("id").take(pa.array(at)), x))
            yield from cut(width, False)
    for width in list(held):
        yield from (t for t in cut(width, True) if len(t[1]))


def unit_vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length in a list column that have a direction."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    for width in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == width)
        ok, x = _directed(flat[(ends[at] - width)[:, None] + np.arange(width)])
        yield int(width), at[ok], x


def unit_texts(embed: Embed) -> Vectors:
    """What unit_vectors gives for the vectors of a column of texts, embedded TEXTS_AT_ONCE at a time."""

    def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i in range(0, len(column), TEXTS_AT_ONCE):
            ok, x = _directed(np.asarray(embed(column.slice(i, TEXTS_AT_ONCE).to_pylist()), np.float64))
            yield x.shape[1], np.flatnonzero(ok) + i, x

    return vectors


def _directed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return ok, x[ok] / norm[ok, None]


def best_in_tile(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row of scores, with all that tie at the end of k."""
    n = scores.shape[1]
    low = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    return np.nonzero(scores >= low[:, None])


def _best(q: np.ndarray, x: np.ndarray, qids: pa.Array, ids: pa.Array, k: int) -> pa.RecordBatch:
    """The k best of each query of a tile in a tile of the corpus: one matrix product of a bounded number of cells."""
    scores = np.round(q @ x.T, 12)  # equal vectors tie, wherever they stand
    r, c = best_in_tile(scores, k)
    return pa.RecordBatch.from_arrays([qids.take(pa.array(r)), ids.take(pa.array(c)), pa.array(scores[r, c])], names=["qid", "id", "score"])


def _nearest(k: int):
    """The k best of rows that are a tile of queries and one of the corpus each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                width = batch.column("width")[i].as_py()
                q, x = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8").reshape(-1, width) for c in ("qdata", "data"))
                yield _best(q, x, batch.column("qids")[i].values, batch.column("ids")[i].values, k)

    return run


def _nearest_sent(sent: Broadcast, kind: T.DataType, k: int, vectors: Vectors):
    """The k best of each part of the corpus (id, v), made into tiles where it is read, for the tiles of queries sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(width, np.frombuffer(data, "<f8").reshape(-1, width), pa.array(qids, to_arrow_type(kind))) for qids, width, data in sent.value]
        for width, ids, x in _cut(batches, CORPUS_TILE, vectors):
            for _, q, qids in filter(lambda a: a[0] == width, asked):  # noqa: B023
                yield _best(q, x, qids, ids, k)

    return run


def ranking_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", corpus.schema["id"].dataType), T.StructField("score", T.DoubleType())])


def dense_search(corpus: DataFrame, queries: DataFrame, k: int = 20, filters: Mapping[str, object] | None = None, embed: Embed | None = None) -> DataFrame:
    """Exact cosine top-k. corpus: id, vector and what filters name; queries: qid, qvector. Filters go to the scan. With
    `embed`, which makes vectors of texts, corpus has text and queries qtext instead.

    Both sides become tiles where they are read, QUERY_TILE queries and CORPUS_TILE vectors at most, and every tile of
    queries meets every tile of the corpus: a query set against all rows, in blocks. Up to BROADCAST_ROWS queries are sent
    to all tasks, which embed, cut and compare in one Python worker, a tile at a time; of more, every part of the corpus
    gets the tiles through a shuffle. No vector of the corpus goes through the driver, a product has a bounded number of
    cells, and no pair is a row before its score is among the k best of its tile. Null and zero vectors have no score, nor
    do vectors of another length than the query's.
    """
    spark = corpus.sparkSession
    v, qv, vectors = ("text", "qtext", unit_texts(embed)) if embed else ("vector", "qvector", unit_vectors)
    rows = spread(corpus.where(scalar_filter(filters or {})).select("id", v))
    asking, schema = queries.select("qid", qv), ranking_schema(queries, corpus)
    sent = [(list(t.qids), t.qwidth, bytes(t.qdata)) for t in tiles(asking.limit(BROADCAST_ROWS + 1), "qid", qv, QUERY_TILE, "q", vectors).collect()]
    if sum(len(qids) for qids, _, _ in sent) <= BROADCAST_ROWS:
        found = _nearest_sent(spark.sparkContext.broadcast(sent), schema["qid"].dataType, k, vectors)
        return top_k(rows.select("id", F.col(v).alias("v")).mapInArrow(found, schema), k)
    told, asked = tiles(rows, "id", v, CORPUS_TILE, "", vectors), tiles(asking, "qid", qv, QUERY_TILE, "q", vectors)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = told.withColumn("part", F.pmod(F.xxhash64("data"), F.lit(parts)).cast("int"))
    every = asked.withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = told.join(every.hint("merge"), (F.col("part") == F.col("qpart")) & (F.col("width") == F.col("qwidth")))
    return top_k(pairs.select("ids", "data", "qids", "qdata", "width").mapInArrow(_nearest(k), schema), k)


_RUNS = re.compile(r"[^\W_]+")


def term_counts(corpus: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """(id, dl, token, tf): how often each text has each of its tokens, or each of `asked`, and its number of tokens; and
    a row of token "" for each text. Tokens are those of functions.text.tokens, counted where the text is read."""
    schema = T.StructType([T.StructField("id", corpus.schema["id"].dataType), *T.StructType.fromDDL("dl int, token string, tf int")])
    sent = corpus.sparkSession.sparkContext.broadcast(None if asked is None else frozenset(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sent.value
        for batch in batches:
            at, dl, token, tf = [], [], [], []

            def out(ids: pa.Array) -> pa.RecordBatch:
                columns = [ids.take(pa.array(at, pa.int64())), pa.array(dl, pa.int32()), pa.array(token, pa.string()), pa.array(tf, pa.int32())]
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            for i, text in enumerate(batch.column("text")):
                runs = _RUNS.findall((text.as_py() or "").lower())
                n = Counter(runs if kept is None else filter(kept.__contains__, runs))
                n[""] = 1
                at += [i] * len(n)
                dl += [len(runs)] * len(n)
                token += n.keys()
                tf += n.values()
                if len(at) > ROWS_OUT:
                    yield out(batch.column("id"))
                    at, dl, token, tf = [], [], [], []
            yield out(batch.column("id"))

    return corpus.select("id", "text").mapInArrow(run, schema)


def bm25_part(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """What a token that a text has tf times gives to its score."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def asked_terms(queries: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """(qid, token) of the queries' distinct tokens; and these tokens, unless they are more than TERMS_SENT."""
    terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("qtext")))).alias("token"))
    asked = [r[0] for r in terms.select("token").distinct().limit(TERMS_SENT + 1).collect()]
    return terms, asked if len(asked) <= TERMS_SENT else None


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 top-k. corpus: id, text; queries: qid, qtext.

    Texts are read and counted once. Only the counts of the queries' terms go on, with one row of token "" for each text,
    so one table by token holds document frequencies and, there, the corpus' size. For many searches over one corpus
    see text_index, which reads no text.
    """
    terms, asked = asked_terms(queries)
    few = asked is not None
    # Dealt by text: the frequencies and the scores read the same shuffle.
    tf = term_counts(spread(corpus.select("id", "text")), asked).repartition("id")
    by_token = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("words"))
    # Not filtered by token, so that both uses read the same shuffle.
    size = lambda c: F.max(F.when(F.col("token") == "", F.col(c)))
    stats = by_token.agg(size("df").alias("n"), (size("words") / size("df")).alias("avgdl"))
    # A row for each term: sent to the postings where there are few, so that these stay spread as they are.
    df = F.broadcast(by_token.drop("words")) if few else by_token.drop("words")
    part = bm25_part(*map(F.col, ("tf", "dl", "df", "n", "avgdl")), k1, b)
    weighted = tf.join(df, "token").crossJoin(F.broadcast(stats)).select("token", "id", part.alias("part"))
    asking = F.broadcast(terms) if few and terms.limit(PAIRS_SENT + 1).count() <= PAIRS_SENT else terms
    return top_k(weighted.join(asking, "token").groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def rrf(rankings: Iterable[DataFrame], k: int = 20, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of rankings (qid, id, rank): score = sum of 1 / (constant + rank)."""
    # As one column, so that Spark does not try to line the lists' partitions of qid up, which differ in number.
    lists = [r.select(F.struct("qid", "id").alias("hit"), "rank") for r in rankings]
    fused = reduce(DataFrame.unionByName, lists).groupBy("hit").agg(F.round(F.sum(F.lit(1.0) / (constant + F.col("rank"))), 12).alias("score"))
    return top_k(fused.select("hit.*", "score"), k)


def hybrid_search(corpus: DataFrame, queries: DataFrame, k: int = 20, filters: Mapping[str, object] | None = None, extra: Iterable[DataFrame] = (), sparse: bool = True, embed: Embed | None = None) -> DataFrame:
    """Dense and BM25 rankings, and those of further query vectors (HyDE; qid, qvector), fused.

    corpus: id, text, vector and what filters name. Without a column of texts, or with sparse off, dense rankings alone;
    without vectors, BM25 alone; with neither an empty result. `embed` makes vectors of the texts of both sides, which
    then need none; it is not for `extra`.
    """
    kept = corpus.where(scalar_filter(filters or {}))
    lists = [dense_search(kept, q, k) for q in (queries.select("qid", "qvector"), *extra)] if "vector" in corpus.columns and "qvector" in queries.columns else []
    if embed:
        lists.append(dense_search(kept, queries, k, embed=embed))
    if sparse and "text" in corpus.columns and "qtext" in queries.columns:
        lists.append(bm25_search(kept, queries, k))
    if not lists:
        return corpus.limit(0).crossJoin(queries.limit(0)).select("qid", "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return rrf(lists, k)


def retrieve(corpus: DataFrame, queries: DataFrame, k: int = 20, top: int = 5, filters: Mapping[str, object] | None = None, hybrid: bool = True, hyde: Callable[[DataFrame], DataFrame] | None = None, reranked: bool = True, dynamic: bool = False) -> DataFrame:
    """Retrieval as it is configured: BM25 beside dense vectors, vectors of supposed answers (hyde: queries to qid,
    qvector), reranking. (qid, id, rank, score)."""
    fused = hybrid_search(corpus, queries, k, filters, [hyde(queries)] if hyde else (), hybrid)
    if not reranked:
        return fused.where(F.col("rank") <= top)
    hits = fused.join(queries.select("qid", "qtext"), "qid").join(corpus.select("id", "text"), "id")
    return rerank(hits.select("qid", "id", "rank", "qtext", "text"), top, dynamic).select("qid", "id", "rank", "score")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that a text holds: the default reranker."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, k: int = 5, dynamic: bool = False, score: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """hits (qid, id, rank, qtext, text): the k best by `score` of question and text, overlap unless a model's is given.
    With k hits or fewer they pass as they are."""
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    scored = hits.withColumns({"_n": n, "score": score(F.col("qtext"), F.col("text"))})
    new = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank"))
    out = scored.withColumn("_rank", F.when(F.col("_n") <= k, F.col("rank")).otherwise(new))
    if dynamic:
        cut = cliff_cut(out.select("qid", "id", "score"))
        return out.join(cut, "qid").where((F.col("_n") <= k) | (F.col("_rank") <= F.col("keep"))).withColumn("rank", F.col("_rank")).drop("_n", "_rank", "keep")
    return out.where(F.col("_rank") <= k).withColumn("rank", F.col("_rank")).drop("_n", "_rank")


def cliff_cut(ranking: DataFrame, least: int = 1, most: int = 10, gap: float = 0.5, ratio: float = 0.25) -> DataFrame:
    """(qid, keep): how many of a ranking's scores come before the first cliff.

    A cliff is a drop to the next score of `gap`, or of `ratio` of the score; it counts from place `least` on.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    rows = ranking.withColumns({"rn": F.row_number().over(w), "drop": F.col("score") - F.lead("score").over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("qid"))})
    end = F.least(F.lit(most), F.col("n"))
    cliff = (F.col("drop") >= gap) | (F.col("drop") / (F.abs("score") + 1e-6) >= ratio)
    first = F.min(F.when((F.col("rn") >= least) & (F.col("rn") < end) & cliff, F.col("rn")))
    return rows.groupBy("qid").agg(F.coalesce(first, F.max(end)).cast("int").alias("keep"))


def cliff_top_k(ranking: DataFrame, **limits: float) -> DataFrame:
    """A ranking up to its first cliff."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return ranking.withColumn("rank", rank).join(cliff_cut(ranking, **limits), "qid").where(F.col("rank") <= F.col("keep")).drop("keep")


def parent_context(hits: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """(qid, context): each hit's parent text, or its own, under a header with source and page, in order of rank."""
    body = F.coalesce(F.nullif("parent_text", F.lit("")), F.col("text"))
    header = F.concat(F.lit("[Source: "), F.coalesce("doc_name", F.lit("unknown")), F.when(F.col("page_number") > 0, F.concat(F.lit(", page "), F.col("page_number"))).otherwise(""), F.lit("]\n"))
    parts = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(header, body).alias("t")))).alias("p"))
    return parts.select("qid", F.array_join(F.col("p.t"), separator).alias("context"))


def image_urls(hits: DataFrame) -> DataFrame:
    """(qid, urls): the distinct URLs in the hits' JSON lists, in order of first sight; what does not parse is skipped."""
    urls = hits.select("qid", "rank", F.posexplode(F.from_json("image_urls", "array<string>")).alias("pos", "url")).where("url is not null and url <> ''")
    first = urls.groupBy("qid", "url").agg(F.min(F.struct("rank", "pos")).alias("at"))
    listed = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "url"))).alias("u"))
    return hits.select("qid").distinct().join(listed, "qid", "left").select("qid", F.coalesce(F.col("u.url"), F.array().cast("array<string>")).alias("urls"))


def channel_union(channels: Mapping[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(qid, channel, n, status): ok or empty for each query and channel that ran."""
    found = [df.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).withColumn("channel", F.lit(name)) for name, df in channels.items()]
    counts = reduce(DataFrame.unionByName, found)
    asked = queries.select("qid").withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    return asked.join(counts, ["qid", "channel"], "left").select("qid", "channel", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "ok").otherwise("empty").alias("status"))


def graph_neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 20) -> DataFrame:
    """Edges (src, dst, label) within some hops of seed nodes (id), nearest first, at most `limit`.

    Repeated edges count once. Each hop reads only the edges that leave the nodes of the one before.
    """
    near, found = seeds.select("id").distinct(), None
    for hop in range(1, hops + 1):
        step = edges.join(near, edges["src"] == near["id"], "left_semi").select("src", "dst", "label").distinct().withColumn("hop", F.lit(hop))
        found = step if found is None else found.unionByName(step)
        near = step.select(F.col("dst").alias("id")).distinct()
    return found.groupBy("src", "dst", "label").agg(F.min("hop").alias("hop")).orderBy("hop", "src", "dst", "label").limit(limit)


def cache_key(question: Column, channels: Column, doc_type: Column, model_code: Column, hyde: Column, role: Column) -> Column:
    """md5 over what an answer depends on; the order of channels does not matter."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", text(question), F.array_join(F.array_sort(channels), ","), text(doc_type), text(model_code), text(hyde), text(role)))


def grounding(reply: Column, least: float = 0.7) -> Column:
    """(is_grounded, confidence) from a checking model's reply: grounded if it says so with enough confidence. A reply that
    cannot be read lets the answer pass, with full confidence."""
    parsed = F.from_json(F.nullif(first_json_object(F.coalesce(reply, F.lit(""))), F.lit("")), "is_grounded boolean, confidence double")
    known = parsed.isNotNull() & (parsed["is_grounded"].isNotNull() | parsed["confidence"].isNotNull())
    sure = F.coalesce(parsed["is_grounded"], F.lit(False)) & (F.coalesce(parsed["confidence"], F.lit(0.0)) >= least)
    return F.struct(F.when(known, sure).otherwise(F.lit(True)).alias("is_grounded"), F.when(known, F.coalesce(parsed["confidence"], F.lit(0.0))).otherwise(F.lit(1.0)).alias("confidence"))


def grounded(answer: Column, context: Column, least: float = 0.7) -> Column:
    """Whether enough of an answer's tokens occur in its context; an empty answer passes."""
    a = F.array_distinct(tokens(answer))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, tokens(context))) / F.size(a) >= least).otherwise(F.lit(True))
