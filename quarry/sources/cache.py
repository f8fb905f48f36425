"""Answers kept for a while: a keyed table with a time to live, in a store of versions.

A batch of questions is split into hits and misses by one join. An answer remembers the documents it cites, by document
too, so that the upsert of a document forgets the answers that cite it and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Conflict, Store, write_all

#: Seconds that an answer is good for.
TTL = 300
_ANSWERS, _CITED = "key string, answer string, docs array<string>, at timestamp", "doc_id string, key string"


def _ready(store: Store) -> None:
    if not {"answers", "cited"} <= set(store.tables()):
        empty = store.spark.createDataFrame
        write_all(store, {"answers": (empty([], _ANSWERS), ["key"]), "cited": (empty([], _CITED), ["doc_id"])})


def split(store: Store, questions: DataFrame, now: Column, ttl: int = TTL) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): the questions (key, ...) with a fresh answer, and their answer; and those without. A store that
    cannot be read has no answers."""
    try:
        rows = store.read("answers")
    except Exception:  # noqa: BLE001  whatever is wrong with the cache, questions are answered
        return questions.withColumn("answer", F.lit(None).cast("string")).limit(0), questions
    fresh = rows.where((F.col("at") <= now) & (F.col("at") > now - F.make_dt_interval(secs=F.lit(ttl)))).select("key", "answer")
    return questions.join(fresh, "key"), questions.join(fresh.select("key"), "key", "left_anti")


def remember(store: Store, answers: DataFrame) -> bool:
    """Keeps answers (key, answer, docs, at), in place of those of their keys; of a key that comes twice the latest.
    False if another writer was faster: an answer that is not kept is only asked for again."""
    _ready(store)
    based_on = store.version()
    latest = answers.groupBy("key").agg(F.max_by(F.struct("answer", "docs", "at"), F.struct("at", "answer")).alias("a")).select("key", "a.*")
    cited = latest.select(F.explode(F.array_distinct("docs")).alias("doc_id"), "key")
    known = store.read("cited").join(cited.select("doc_id").distinct(), "doc_id", "left_semi")
    both = known.unionByName(cited).distinct()
    changes = [store.upserted("answers", latest, latest.select("key")), store.upserted("cited", both, cited.select("doc_id"))]
    try:
        store.commit(changes, based_on)
    except Conflict:
        return False
    return True


def forget(store: Store, documents: DataFrame) -> None:
    """Forgets the answers that cite one of documents (doc_id): they are about to change."""
    _ready(store)
    based_on = store.version()
    gone = documents.select("doc_id").distinct()
    keys = store.read("cited").join(gone, "doc_id", "left_semi").select("key").distinct()
    store.commit([store.upserted("answers", None, keys), store.upserted("cited", None, gone)], based_on)


def expire(store: Store, now: Column, ttl: int = TTL) -> None:
    """Drops what has run out."""
    _ready(store)
    based_on = store.version()
    old = store.read("answers").where(F.col("at") <= now - F.make_dt_interval(secs=F.lit(ttl)))
    store.commit([store.upserted("answers", None, old.select("key"))], based_on)
