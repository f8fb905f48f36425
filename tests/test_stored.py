"""Indexes, stores, queues, paged scans and caches: what they keep, what they skip, and what is left after a failure."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators import text_index, vector_index
from quarry.sources import cache, paged, queue
from quarry.sources.store import Conflict, Store, write_all
from quarry.streaming import ingest
from tests.conftest import SF

BIG = SF.replace("sf0.001", "sf0.01")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Versioned stores


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, str(tmp_path), 4)
    t = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v string")
    one = write_all(store, {"a": (t("x", "y"), ["id"]), "b": (t("z"), ["id"])})
    store.replaced("a", t("new"), ["id"])  # files of a writer that never came to its commit
    assert store.version() == one and rows(store.read("a"), "v") == [("x",), ("y",)]
    with pytest.raises(Exception, match="no"):
        store.replaced("b", t("q").withColumn("v", F.raise_error(F.lit("no")).cast("string")), ["id"])
    assert rows(store.read("b"), "v") == [("z",)]
    two = write_all(store, {"a": (t("x2"), ["id"]), "b": (t("z2"), ["id"])})
    assert (rows(store.read("a"), "v"), rows(store.read("b"), "v")) == ([("x2",)], [("z2",)])
    assert rows(store.read("a", one), "v") == [("x",), ("y",)]
    assert store.clean() > 0 and store.versions() == [two] and rows(store.read("b"), "v") == [("z2",)]
    assert store.clean() == 0


def test_the_second_of_two_writers_fails(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    t = spark.createDataFrame([(1, "x")], "id int, v string")
    base = write_all(a, {"t": (t, ["id"])})
    change = b.upserted("t", t, t, base)
    a.commit([a.upserted("t", None, t, base)], base)
    with pytest.raises(Conflict):
        b.commit([change], base)
    assert a.read("t").count() == 0


def test_upserts_rewrite_the_buckets_they_touch(spark, tmp_path):
    store = Store(spark, str(tmp_path), 16)
    docs = spark.range(200).select(F.concat(F.lit("d"), F.col("id") % 40).alias("doc_id"), F.col("id").alias("chunk"))
    one = write_all(store, {"chunks": (docs, ["doc_id"])})
    new = spark.createDataFrame([("d1", 1000), (None, 7)], "doc_id string, chunk long")
    two = store.commit([store.upserted("chunks", new, new)], one)
    then, now = (store.manifest(v)["tables"]["chunks"]["buckets"] for v in (one, two))
    assert sum(then.get(b) != now[b] for b in now) <= 2  # those of d1 and null
    got = {(r.doc_id, r.chunk) for r in store.read("chunks").collect()}
    assert got == {(r.doc_id, r.chunk) for r in docs.where("doc_id <> 'd1'").collect()} | {("d1", 1000), (None, 7)}
    assert store.read("chunks", buckets=[]).count() == 0


# Dense search and the index of vectors


def test_searches_start_no_job_while_they_are_planned(spark):
    corpus = spark.read.parquet(f"{BIG}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    texts = spark.read.parquet(f"{BIG}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    asked = corpus.where("id < 5").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"), F.lit("the and").alias("qtext"))
    sc = spark.sparkContext
    jobs = lambda g: len(sc.statusTracker().getJobIdsForGroup(g))
    try:
        sc.setJobGroup("dense", "plan")
        R.dense_search(corpus, asked)
        R.dense_search(corpus.join(texts, "id"), asked)
        sc.setJobGroup("bm25", "plan")
        R.bm25_search(texts, asked)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs("dense") <= 4 and jobs("bm25") <= 4  # bounded counts of the queries, and collects of their terms; the joins do not run


def test_tiles_bound_a_product(spark, monkeypatch):
    monkeypatch.setattr(R, "CORPUS_TILE", 16)
    monkeypatch.setattr(R, "QUERY_TILE", 4)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(100, 6))
    v[7] = v[8]
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(100, None), (101, [0.0] * 6), (102, [1.0]), (103, [1.0, None] * 3), (104, [float("nan")] * 6)]
    corpus = spark.createDataFrame(data, "id int, vector array<double>").repartition(3)
    made = R.tiles(corpus, "id", "vector", 16, "").collect()
    assert max(len(t.ids) for t in made) == 16 and sum(len(t.ids) for t in made) == 101
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {q: sorted(((-round(float(s), 12), i) for i, s in enumerate(unit @ unit[q])))[:5] for q in range(9)}
    out = R.dense_search(corpus, corpus.where("id < 9 or id > 99").select(F.col("id").alias("qid"), F.col("vector").alias("qvector")), 5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.id)
    assert {q: [i for _, i in w] for q, w in want.items()} == {q: g for q, g in got.items() if q < 9} and got[102] == [102]


def test_vector_index_prunes_and_recalls(spark, tmp_path):
    """Clustered vectors: recall at 4 of 40 cells, with the files of the others never read."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 16))
    corpus = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "id int, vector array<double>, label int")
    vector_index.build(corpus, str(tmp_path / "i"), cells=40)
    asked = corpus.where("id < 6").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    exact = {(r.qid, r.id) for r in R.dense_search(corpus, asked, 10).collect()}
    found = vector_index.search(spark, str(tmp_path / "i"), asked, 10, nprobe=4)
    assert len(exact & {(r.qid, r.id) for r in found.collect()}) / len(exact) >= 0.9
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    files = [m for m in _scans(found) if m[0] > 0]
    assert files and max(n for n, _ in files) <= 4 * 6 and spark.read.parquet(str(tmp_path / "i" / "vectors")).select("cell").distinct().count() > 30
    every = vector_index.search(spark, str(tmp_path / "i"), asked, 10, nprobe=40, filters={"label": [1, 2]})
    want = R.dense_search(corpus, asked, 10, {"label": [1, 2]})
    assert rows(every, "qid", "rank", "id", "score") == rows(want, "qid", "rank", "id", "score")


def _scans(df):
    """(partitions read, 0) of the scans of an executed plan that has partition filters."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec" and node.metrics().contains("numPartitions"):
            out.append((node.metrics().apply("numPartitions").value(), 0))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return out


def test_vector_index_of_odd_vectors(spark, tmp_path):
    data = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 1.0]), (7, [1.0, None])]
    corpus = spark.createDataFrame(data, "id int, vector array<double>")
    vector_index.build(corpus, str(tmp_path / "i"), cells=9)
    asked = corpus.select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    out = vector_index.search(spark, str(tmp_path / "i"), asked, 5).collect()
    assert sorted((r.qid, r.id) for r in out) == [(1, 1), (1, 6), (6, 1), (6, 6)]


# The index of texts


def _texts(spark, n=600):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 20)) + (f" rare{i % 7}" if i % 50 == 0 else "") for i in range(n)]
    return spark.createDataFrame([*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "w1 " * 5000)], "id long, text string").repartition(3)


def test_text_index_skips_blocks_and_changes(spark, tmp_path):
    corpus = _texts(spark)
    store = text_index.build(corpus, str(tmp_path / "t"), blocks=12)
    asked = spark.createDataFrame([(1, "rare3"), (2, "w1 w2 rare0"), (3, "nothing here"), (4, None), (5, "rare1 w5")], "qid int, qtext string")
    for k in (2, 1):
        got, told = text_index.search_with_skips(store, asked, k)
        assert rows(got, "qid", "rank", "id", "score") == rows(R.bm25_search(corpus, asked, k), "qid", "rank", "id", "score")
    skipped = {r.qid: r.n for r in told.where("not open").groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert skipped[2] > 3 and skipped[5] > 3
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    # Documents replaced, added and deleted: as an index of what is there then, and the old version as it was.
    before = store.version()
    new = spark.createDataFrame([(0, "w1 rare3 rare3"), (9000, "rare3 w2"), (5, "")], "id int, text string")
    text_index.change(store, new, spark.createDataFrame([(100,), (77777,)], "id int"))
    now = corpus.where("id not in (0, 5, 100)").unionByName(new.select(F.col("id").cast("long").alias("id"), "text"))
    assert rows(text_index.search(store, asked, 50), "qid", "rank", "id", "score") == rows(R.bm25_search(now, asked, 50), "qid", "rank", "id", "score")
    assert store.read("documents").count() == now.count() and store.read("documents", before).count() == corpus.count()


def test_text_index_shuffles_texts_not_postings(spark, tmp_path, monkeypatch):
    plans = []
    real = Store._written
    monkeypatch.setattr(Store, "_written", lambda self, rows, table, dealt=False: plans.append((dealt, rows._jdf.queryExecution().executedPlan().toString())) or real(self, rows, table, dealt))
    text_index.build(_texts(spark, 50), str(tmp_path / "t"), blocks=3)
    dealt, plan = plans[0]
    assert dealt and plan.index("MapInArrow") < plan.index("Exchange") and "Aggregate" not in plan  # counted after the shuffle


def test_text_index_that_lacks_a_column_is_built_again(spark, tmp_path):
    corpus, path = _texts(spark, 50), str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        text_index.opened(spark, path)
    store = text_index.opened(spark, path, corpus)
    assert text_index.opened(spark, path).version() == store.version() == 1  # known columns: kept
    write_all(store, {"postings": (store.read("postings").drop("most"), ["block"]), "documents": (store.read("documents"), ["block"])})
    assert text_index.opened(spark, path, corpus).version() == 3 and "most" in store.read("postings").columns


# Queue


def test_queue_is_bounded_and_keeps_groups_apart(spark, tmp_path):
    queue.register(spark)
    path = str(tmp_path / "q")
    put = lambda a, b: spark.range(a, b, 1, 2).write.format(queue.FORMAT).option("path", path).mode("append").save()
    put(0, 300)
    put(300, 1250)
    held = {r.id for r in spark.read.format(queue.FORMAT).schema("id long").option("path", path).load().collect()}
    assert len(held) == 1000 and held >= set(range(300, 1250))
    seen = {}

    def consume(group, upto=None, checkpoint=None):
        got = []
        stream = spark.readStream.format(queue.FORMAT).schema("id long").option("path", path).option("group", group).option("perBatch", 400).load()
        q = stream.writeStream.foreachBatch(lambda df, n: got.append([r.id for r in df.collect()])).option("checkpointLocation", str(tmp_path / (checkpoint or group))).start()
        q.processAllAvailable()
        q.stop()
        queue.settle(q, path, group)
        seen.setdefault(group, []).extend(got)
        return [x for b in got for x in b]

    assert sorted(consume("a")) == sorted(held) and max(map(len, seen["a"])) <= 400
    put(2000, 2010)
    assert sorted(consume("a", checkpoint="a-new")) == list(range(2000, 2010))  # from the last acknowledgement, without its checkpoint
    assert len(consume("b")) == 1000  # another group has its own place
    assert queue.Folder({"path": path}).group("a") == queue.Folder({"path": path}).group("a")


def test_queue_does_not_show_what_was_aborted(spark, tmp_path):
    queue.register(spark)
    path = str(tmp_path / "q")
    bad = spark.range(0, 100, 1, 4).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.lit("y")).cast("string"))
    with pytest.raises(Exception, match="no"):
        bad.write.format(queue.FORMAT).option("path", path).mode("append").save()
    assert queue.Folder({"path": path}).entries() == []
    folder = queue.Folder({"path": path})
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1, 2]})
    for _ in range(2):  # a commit that Spark repeats is there once
        folder.commit([folder.pending(iter([batch]), batch.schema)], "s_0")
    assert [(e.first, e.n) for e in folder.entries()] == [(0, 2)]


def test_ingestion_tells_stages_and_isolates_a_bad_job(spark, tmp_path):
    path, log, dead = str(tmp_path / "q"), str(tmp_path / "log"), tmp_path / "dead"
    jobs = spark.createDataFrame([(str(i), f"d{i}", "bad" if i == 2 else f"text {i}") for i in range(5)], "job_id string, doc_id string, text string")
    assert ingest.enqueue(jobs, path) and not ingest.enqueue(jobs, "nofs://nowhere/q")
    build = lambda df: df.select("doc_id", F.when(F.col("text") == "bad", F.raise_error(F.lit("unreadable")).cast("string")).otherwise(F.col("text")).alias("text"))
    slept = []
    ingest.drained(ingest.run(ingest.jobs(spark, path), build, str(tmp_path / "index"), str(dead), str(tmp_path / "ck"), log=log, sleep=slept.append))
    assert {r.doc_id: r.text for r in ingest.current(spark, str(tmp_path / "index")).collect()} == {f"d{i}": f"text {i}" for i in (0, 1, 3, 4)}
    status = {r.doc_id: (r.stage, r.progress) for r in ingest.job_status(spark, log).collect()}
    assert status == {"d2": ("failed", None)} | {f"d{i}": ("index", 100) for i in (0, 1, 3, 4)}
    assert [r.doc_id for r in spark.read.json(f"{dead}/0").collect()] == ["d2"] and len(slept) == 2 and 0.5 <= slept[0] <= 1 <= slept[1] <= 2
    assert "unreadable" in ingest.job_status(spark, log).where("stage = 'failed'").first().error
    assert spark.range(1).select(ingest.decoded(F.lit(b'{"job_id": "7"}'))["job_id"].alias("j")).first().j == "7"


# Paged scan


def test_paged_scan_pushes_filters_and_adds_up(spark, tmp_path):
    paged.register(spark)
    whole = spark.createDataFrame([(i if i % 10 else None, i % 7, f"t{i}") for i in range(5000)], "k long, v int, t string")
    whole.repartition(3).write.parquet(str(tmp_path / "p"))
    scan = spark.read.format(paged.FORMAT).option("path", str(tmp_path / "p")).option("key", "k").option("ranges", 8).option("page", 100).load()
    assert rows(scan, "k", "v", "t") == rows(whole, "k", "v", "t") and scan.rdd.getNumPartitions() == 9
    some = scan.where("v = 3 and k > 1000 and t like '%1'")
    assert rows(some, "k", "t") == rows(whole.where("v = 3 and k > 1000 and t like '%1'"), "k", "t")
    reader = paged.PagedReader({"path": str(tmp_path / "p"), "key": "k"}, whole.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    left = list(reader.pushFilters([EqualTo(("v",), 3), StringContains(("t",), "1"), GreaterThan(("k",), 4000)]))
    assert [type(f).__name__ for f in left] == ["StringContains"] and len(reader.pushed) == 2
    parts = reader.partitions()
    pages = [len(b) for p in parts for b in reader.read(p)]
    assert sum(pages) == whole.where("v = 3 and k > 4000").count() and max(pages) <= paged.PAGE
    assert [p.low for p in parts][1:-1] == [p.high for p in parts][:-2]


# Cache


def test_cache_hits_expires_and_forgets(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    store = Store(spark, str(tmp_path / "c"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "key string")
    hits, misses = cache.split(store, asked, F.lit(at(0)))
    assert hits.count() == 0 and misses.count() == 4  # a cache that is not there answers nothing
    answers = spark.createDataFrame([("a", "1", ["x", "y", "x"], at(0)), ("b", "2", ["y"], at(100)), ("b", "old", [], at(50)), ("d", "4", None, at(0))], "key string, answer string, docs array<string>, at timestamp")
    assert cache.remember(store, answers)
    hits, misses = cache.split(store, asked, F.lit(at(299)))
    assert rows(hits, "key", "answer") == [("a", "1"), ("b", "2")] and rows(misses, "key") == [("c",), ("c",)]
    assert rows(cache.split(store, asked, F.lit(at(300)))[0], "key") == [("b",)]
    cache.forget(store, spark.createDataFrame([("x",)], "doc_id string"))
    assert rows(cache.split(store, asked, F.lit(at(200)))[0], "key") == [("b",)]
    cache.remember(store, spark.createDataFrame([("e", "5", ["y"], at(210))], "key string, answer string, docs array<string>, at timestamp"))
    cache.expire(store, F.lit(at(300)))
    assert rows(store.read("answers"), "key") == [("b",), ("e",)]
    cache.forget(store, spark.createDataFrame([("y",)], "doc_id string"))
    assert rows(store.read("answers"), "key") == []
