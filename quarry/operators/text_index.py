"""A stored index of texts for BM25: postings by token and block of documents, read instead of the texts.

Documents are dealt into blocks by a hash of their id; a block's postings and lengths are one bucket of a store, so an
upsert or a delete rewrites the blocks of the documents it names, and document frequencies, which are sums over
blocks, stay right. A row holds a token's postings in a block with how many they are, the greatest frequency and
the least length in it: what the token can give to a score there at most, whatever the corpus' mean length is by then.

A query reads the figures of its tokens first, without any posting. It scores the blocks that promise most, and then
of the others only those that could still beat the k-th score found: the rest is skipped.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.sources.store import Store

from .retrieval import _RUNS, B, K1, PAIRS_SENT, ROWS_OUT, asked_terms, bm25_part, spread, term_counts, top_k

#: Documents in a block, about.
PER_BLOCK = 4096
#: Parts that blocks are dealt into, at most.
MOST_PARTS = 4000
#: Blocks that each query opens before it skips any.
FIRST = 1
#: Added to what a block could give, for rounding.
MARGIN = 1e-6
#: What the tables of this version hold; an index that lacks some of it is built again.
COLUMNS = {"postings": ["block", "token", "df", "most", "least", "hits"], "documents": ["block", "id", "dl"]}


class _Block:
    """Counts of one block's texts, and its postings by token in order."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.kind = schema, schema.field("hits").type.value_type
        self.known: dict[str, int] = {}
        self.ids: list = []
        self.dl, self.token, self.at, self.tf = (array("i") for _ in range(4))

    def add(self, key, text: str | None) -> None:
        runs = _RUNS.findall((text or "").lower())
        counts = Counter(runs)
        self.token.extend([self.known.setdefault(w, len(self.known)) for w in counts])
        self.at.extend([len(self.ids)] * len(counts))
        self.tf.extend(counts.values())
        self.ids.append(key)
        self.dl.append(len(runs))

    def add_hits(self, tokens: list[str], lengths: np.ndarray, ids: pa.Array, dl: np.ndarray, tf: np.ndarray, kept: np.ndarray) -> None:
        """Postings that were there, those that are kept."""
        of = np.repeat(np.array([self.known.setdefault(w, len(self.known)) for w in tokens], np.int32), lengths)[kept]
        self.token.frombytes(of.tobytes())
        self.at.frombytes(np.arange(len(self.ids), len(self.ids) + len(of), dtype=np.int32).tobytes())
        self.tf.frombytes(tf[kept].astype(np.int32).tobytes())
        self.dl.frombytes(dl[kept].astype(np.int32).tobytes())
        self.ids += ids.filter(pa.array(kept)).to_pylist()

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        words = sorted(self.known)
        place = np.empty(len(words), np.int64)
        place[[self.known[w] for w in words]] = np.arange(len(words))
        token, at, tf = place[np.array(self.token, np.int64)], np.array(self.at, np.int64), np.array(self.tf, np.int32)
        order = np.argsort(token, kind="stable")
        at, tf, dl = at[order], tf[order], np.array(self.dl, np.int32)[at[order]]
        df = np.bincount(token, minlength=len(words))
        words, df = [w for w, n in zip(words, df, strict=True) if n], df[df > 0]
        ends = np.cumsum(df)
        ids = pa.array(self.ids, self.kind.field("id").type)
        i = 0
        while i < len(words):
            low = ends[i] - df[i]
            j = max(i + 1, int(np.searchsorted(ends, low + ROWS_OUT, side="right")))
            part, begins = slice(low, ends[j - 1]), (ends[i:j] - df[i:j] - low).astype(np.int64)
            hits = pa.StructArray.from_arrays([ids.take(pa.array(at[part])), pa.array(dl[part]), pa.array(tf[part])], fields=list(self.kind))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, ends[j - 1] - low).astype(np.int32)), hits)
            figures = [pa.array(df[i:j], pa.int64()), pa.array(np.maximum.reduceat(tf[part], begins)), pa.array(np.minimum.reduceat(dl[part], begins))]
            columns = [pa.array(np.full(j - i, block, np.int32)), pa.array(words[i:j], pa.string()), *figures, lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            i = j


def _schema(kind: T.DataType) -> T.StructType:
    hit = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("dl int, tf int")])
    return T.StructType([*T.StructType.fromDDL("block int, token string, df long, most int, least int"), T.StructField("hits", T.ArrayType(hit))])


def _tables(store: Store, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and documents of a corpus (id, text). Texts are dealt by block, and a task counts one block at a time, so
    no posting is shuffled; they are read once more for their lengths."""
    block = F.pmod(F.xxhash64("id"), F.lit(store.buckets)).cast("int")
    schema = _schema(corpus.schema["id"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, _Block(arrow)
        for batch in batches:
            for b, key, text in zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if b != now:
                    yield from held.batches(now) if now is not None else ()
                    now, held = b, _Block(arrow)
                held.add(key, text.as_py())
        yield from held.batches(now) if now is not None else ()

    parts = min(2 * max(store.buckets, store.spark.sparkContext.defaultParallelism), MOST_PARTS)
    dealt = corpus.select(block.alias("block"), "id", "text").repartition(parts, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, schema), term_counts(spread(corpus.select("id", "text")), []).select(block.alias("block"), "id", "dl")


def _changed(old: DataFrame, new: DataFrame, kind: T.DataType) -> DataFrame:
    """Postings of blocks without the ids of new (block, id, text, comes), and with its texts that come. A task works on one
    block, whose postings travel as three arrays."""
    schema = _schema(kind)
    arrow = to_arrow_schema(schema)

    def merge(before: pa.Table, named: pa.Table) -> pa.Table:
        held, gone = _Block(arrow), named.column("id")
        for part in before.to_batches(ROWS_OUT):
            ids = part.column("ids").flatten()
            kept = ~pc.is_in(ids, value_set=gone.combine_chunks()).to_numpy(zero_copy_only=False)
            dl, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("dls", "tfs"))
            held.add_hits(part.column("token").to_pylist(), part.column("ids").value_lengths().to_numpy(zero_copy_only=False), ids, dl, tf, kept)
        for key, text, comes in zip(*(named.column(c).to_pylist() for c in ("id", "text", "comes")), strict=True):
            if comes:
                held.add(key, text)
        block = (before if len(before) else named).column("block")[0].as_py()
        return pa.Table.from_batches(held.batches(block), arrow)

    flat = old.select("block", "token", *[F.col(f"hits.{c}").alias(f"{c}s") for c in ("id", "dl", "tf")])
    return flat.groupBy("block").cogroup(new.groupBy("block")).applyInArrow(merge, schema)


def build(corpus: DataFrame, path: str, blocks: int | None = None) -> Store:
    """An index of corpus (id, text) in a folder, a new version of it if there is one. Ids are unique."""
    spark = corpus.sparkSession
    store = Store(spark, path, blocks or max(1, round(corpus.count() / PER_BLOCK)))
    based_on = store.version()
    rows, documents = _tables(store, corpus)
    store.commit([store.replaced("postings", rows, ["block"], dealt=True), store.replaced("documents", documents, ["block"])], based_on)
    return store


def opened(spark: SparkSession, path: str, corpus: DataFrame | None = None) -> Store:
    """The index in a folder. One that is missing, or lacks a column, is built again from corpus; without a corpus that
    is an error. The texts' columns are not looked at otherwise."""
    store = Store(spark, path)
    tables = store.manifest()["tables"]
    whole = all(name in tables and set(columns) <= {f["name"] for f in tables[name]["schema"]["fields"]} for name, columns in COLUMNS.items())
    if whole:
        store.buckets = tables["postings"]["n"]
        return store
    if corpus is None:
        raise FileNotFoundError(f"no index of this form in {path}")
    return build(corpus, path)


def change(store: Store, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
    """A new version with the documents upserts (id, text) in place of those of their ids, and without deletes (id).

    Only the blocks of these documents are read and written; postings of theirs that were there go.
    """
    based_on = store.version()
    kind = store.read("documents").schema["id"].dataType  # blocks are told by a hash of the id, which depends on its type
    upserts = None if upserts is None else upserts.select(F.col("id").cast(kind).alias("id"), "text")
    ids = [d.select(F.col("id").cast(kind).alias("id")) for d in (upserts, deletes) if d is not None]
    gone = (ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])).distinct()
    block = F.pmod(F.xxhash64("id"), F.lit(store.buckets)).cast("int")
    touched = [r[0] for r in gone.select(block).distinct().collect()]  # the store's number of buckets at most
    blocks = store.spark.createDataFrame([(b,) for b in touched], "block int")
    numbers = sorted({r[0] for r in blocks.select(store.bucket(store.manifest()["tables"]["postings"])).collect()})
    old = store.read("postings", buckets=numbers).join(F.broadcast(blocks), "block", "left_semi")
    documents = store.read("documents", buckets=numbers).join(F.broadcast(blocks), "block", "left_semi").join(gone, "id", "left_anti").select("block", "id", "dl")
    named = gone.select(block.alias("block"), "id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("comes"))
    if upserts is not None:
        named = named.unionByName(upserts.select(block.alias("block"), "id", "text", F.lit(True).alias("comes")))
        documents = documents.unionByName(term_counts(spread(upserts.select("id", "text")), []).select(block.alias("block"), "id", "dl"))
    changes = [store.upserted("postings", _changed(old, named, kind), blocks, dealt=True), store.upserted("documents", documents, blocks)]
    return store.commit(changes, based_on)


def search(store: Store, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B, first: int = FIRST) -> DataFrame:
    """(qid, id, rank, score): BM25 top-k as bm25_search gives it, from the newest version. queries: qid, qtext."""
    scored, _ = search_with_skips(store, queries, k, k1, b, first)
    return scored


def search_with_skips(store: Store, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """The ranking, and (qid, block, bound, open): which blocks were opened for each query."""
    version = store.version()
    n, words = store.read("documents", version).agg(F.count(F.lit(1)), F.sum("dl")).first()
    n, avgdl = F.lit(n), F.lit((words or 0) / n if n else 0.0)
    terms, asked = asked_terms(queries)
    few = asked is not None and terms.limit(PAIRS_SENT + 1).count() <= PAIRS_SENT
    sent = F.broadcast if few else (lambda df: df)
    rows = store.read("postings", version)
    if asked is not None:
        rows = rows.where(F.col("token").isin(asked))  # to the scan, which skips by the files' statistics
    figures = rows.select("block", "token", "df", "most", "least").join(sent(terms.select("token").distinct()), "token", "left_semi")
    df = figures.groupBy("token").agg(F.sum("df").alias("all"))
    weighed = sent(terms.join(df, "token"))
    bound = bm25_part(F.col("most"), F.col("least"), F.col("all"), n, avgdl, k1, b)
    promised = figures.join(weighed, "token").groupBy("qid", "block").agg((F.sum(bound) + MARGIN).alias("bound"))
    promised = promised.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "block")))

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = weighed.join(pairs.select("qid", "block"), "qid")
        found = rows.select("block", "token", "hits").join(sent(wanted), ["block", "token"]).select("qid", "all", F.inline("hits"))
        part = bm25_part(F.col("tf"), F.col("dl"), F.col("all"), n, avgdl, k1, b)
        return found.groupBy("qid", "id").agg(F.round(F.sum(part), 9).alias("score"))

    start = scored(promised.where(F.col("place") <= first))
    least = top_k(start, k).where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
    later = promised.where(F.col("place") > first).join(least, "qid", "left")
    blocks = later.withColumn("open", F.coalesce(F.col("bound") >= F.col("kth"), F.lit(True)))
    out = top_k(start.unionByName(scored(blocks.where("open"))), k)
    told = promised.where(F.col("place") <= first).select("qid", "block", "bound", F.lit(True).alias("open")).unionByName(blocks.select("qid", "block", "bound", "open"))
    return out, told
