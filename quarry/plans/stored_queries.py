"""Registered queries over what is stored first: indexes, versioned tables, queues, caches, and streams with state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import layout, metrics, patterns, text_index, vector_index
from quarry.plans.queries import _BM25, _DENSE, _events, _logged, _texts, _vectors, query
from quarry.sources import cache, paged, queue
from quarry.sources import catalog as C
from quarry.sources.star import STAR, read
from quarry.sources.store import Store, fresh_folder, write_all
from quarry.streaming import alerts, ingest, state

# Indexes.


def _ivf(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    corpus, asked = _vectors(spark, sf_dir)
    path = fresh_folder(spark, "ivf")
    vector_index.build(corpus, path, cells=64)
    return path, asked


@query()
def ivf_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors in the 16 nearest of 64 cells."""
    path, asked = _ivf(spark, sf_dir)
    return vector_index.search(spark, path, asked, nprobe=16)


@query(f"SELECT qid, id, rank, round(score, 6) AS score FROM {_DENSE.format(' AND e.label IN (1, 2, 3)')}")
def ivf_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells and a filter on the indexed rows: the exact ranking."""
    path, asked = _ivf(spark, sf_dir)
    return vector_index.search(spark, path, asked, nprobe=64, filters={"label": [1, 2, 3]}).withColumn("score", F.round("score", 6))


_RANKED = f"SELECT qid, id, round(score, 9) AS score FROM {_BM25} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 20"


@query(_RANKED)
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from stored postings; no text is read by the search."""
    corpus, asked = _texts(spark, sf_dir)
    return text_index.search(text_index.build(corpus, fresh_folder(spark, "text")), asked).select("qid", "id", "score")


@query(_RANKED.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN source = 'src5' THEN text || ' ' || text ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src3') docs"))
def bm25_after_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the documents of one source were deleted and those of another replaced."""
    corpus, asked = _texts(spark, sf_dir)
    store = text_index.build(corpus, fresh_folder(spark, "text"))
    documents = read(spark, sf_dir, "documents")
    doubled = documents.where("source = 'src5'").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" "), "text").alias("text"))
    text_index.change(store, doubled, documents.where("source = 'src3'").select(F.col("doc_id").alias("id")))
    return text_index.search(store, asked).select("qid", "id", "score")


# Sources and stores.


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('F', 'O')")
def paged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan by key ranges in pages, its filters pushed to the store."""
    paged.register(spark)
    rows = spark.read.format(paged.FORMAT).option("path", f"{sf_dir}/orders.parquet").option("key", "o_orderkey").load()
    return rows.where("o_totalprice > 200000 and o_orderstatus in ('F', 'O')").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT doc_id, source FROM documents")
def queued_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a queue and a consumer group."""
    path, out = fresh_folder(spark, "queue"), fresh_folder(spark, "consumed")
    rows = read(spark, sf_dir, "documents").select("doc_id", "source")
    ingest.enqueue(rows, path, most=1 << 40)
    jobs = ingest.jobs(spark, path, "workers", 1 << 40, rows.schema)
    q = jobs.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(rows.schema).parquet(out)


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END AS o_totalprice, 2 AS version FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, 1 FROM orders""")
def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions of a table that had rows replaced and others deleted in one commit."""
    store = Store(spark, fresh_folder(spark, "store"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = write_all(store, {"orders": (orders, ["o_orderkey"])})
    new = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", 2 * F.col("o_totalprice"))
    second = store.commit([store.upserted("orders", new, orders.where("o_orderstatus in ('F', 'P')").select("o_orderkey"))], first)
    return store.read("orders", first).withColumn("version", F.lit(1)).unionByName(store.read("orders", second).withColumn("version", F.lit(2)))


@query("""SELECT conv_id, CASE WHEN last > (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') THEN answer END AS answer FROM (
 SELECT conv_id, arg_max(text, turn) AS answer FROM conversations GROUP BY 1) c LEFT JOIN (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) e ON e.user_id = c.conv_id""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations answered from a cache: what is older than a day has run out, what cites a changed document is gone."""
    turns = read(spark, sf_dir, "conversations")
    last = _events(spark, sf_dir).groupBy(F.col("user_id").alias("conv_id")).agg(F.max("ts").alias("at"))
    now = _events(spark, sf_dir).agg(F.max("ts")).first()[0]
    cited = F.collect_set(F.when(F.col("role") == "system", F.concat(F.lit("d"), F.col("conv_id"))))
    answers = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), cited.alias("docs")).join(last, "conv_id")
    store = Store(spark, fresh_folder(spark, "cache"))
    key = F.col("conv_id").cast("string").alias("key")
    cache.remember(store, answers.select(key, "answer", "docs", "at"))
    cache.forget(store, turns.where("role = 'system'").select(F.concat(F.lit("d"), F.col("conv_id")).alias("doc_id")))
    hits, misses = cache.split(store, turns.select("conv_id").distinct().withColumn("key", F.col("conv_id").cast("string")), F.lit(now), 86400)
    return hits.select("conv_id", "answer").unionByName(misses.select("conv_id", F.lit(None).cast("string").alias("answer")))


_SYNCED = [(t.name, c.name) for t in STAR.tables for c in t.columns if c.sync]


@query(" UNION ALL ".join(f"SELECT DISTINCT '{t}.{c}.' || {c} AS id, '{t}' AS table_name, '{c}' AS column_name, {c} AS value FROM {t} WHERE {c} IS NOT NULL" for t, c in _SYNCED))
def value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all columns that the catalog keeps in sync, from the tables themselves."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [C.distinct_values(read(spark, sf_dir, t), t, c) for t, c in _SYNCED])


_RUNS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_VALUES = " UNION ALL ".join(f"SELECT DISTINCT '{t}.{c}.' || {c} AS id, {c} AS value FROM {t} WHERE {c} IS NOT NULL" for t, c in _SYNCED)


@query(f"""WITH v AS ({_VALUES}), d AS (SELECT id, {_RUNS.format('value')} AS ts FROM v), t AS (SELECT id, unnest(ts) AS token FROM d), tf AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM d), q AS (SELECT k, unnest(list_distinct({_RUNS.format('k')})) AS token FROM (SELECT DISTINCT c_mktsegment AS k FROM customer)),
r AS (SELECT k, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / a))), 9) AS score FROM q JOIN tf USING (token) JOIN df USING (token) JOIN d ON d.id = tf.id, s GROUP BY 1, 2)
SELECT id, max(score) AS score FROM r GROUP BY 1""")
def value_recall_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all synced columns that share a word with a business line."""
    from quarry.plans.recall import recall_values

    lines = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("keyword")).distinct()
    return recall_values(lines.withColumn("pos", F.xxhash64("keyword")), value_index(spark, sf_dir))


@query(f"""WITH t AS (SELECT item_id AS id, unnest({_RUNS.format('text')}) AS token FROM benchmark), tf AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT id, token, round(tf * ln((SELECT count(*) FROM benchmark) / df), 6) AS weight FROM tf JOIN df USING (token) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(tf * ln((SELECT count(*) FROM benchmark) / df), 6) DESC, token) <= 10),
l AS (SELECT id, list(token ORDER BY weight DESC, token) AS ts FROM w GROUP BY 1)
SELECT item_id AS id, text || ' | ' || array_to_string(list_filter(ts, lambda x: x <> text), ' | ') AS keywords FROM benchmark LEFT JOIN l ON id = item_id""")
def question_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its keywords, the question first."""
    from quarry.plans.recall import extracted_keywords

    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return extracted_keywords(asked).select("id", F.array_join("keywords", " | ").alias("keywords"))


_PROFILED = [(t.name, c.name, c.role) for t in STAR.tables for c in t.columns]


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS id, '{t}' AS table_name, '{r}' AS role, count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, c, r in _PROFILED))
def catalog_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All catalog columns with their tables' figures."""
    profiles = C.profile(STAR, {t.name: read(spark, sf_dir, t.name) for t in STAR.tables})
    return STAR.frames(spark)["columns"].select("id", "table_name", "role").join(profiles, "id")


# Graphs, metrics, layouts.


@query("""SELECT DISTINCT c_custkey AS n0, o_orderkey AS n1, l_suppkey AS n2, s_nationkey AS n3 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name LIKE '%1%'""")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -placed-> order -supplied by-> supplier -in-> nation, with conditions on both ends."""
    t = lambda n: read(spark, sf_dir, n)
    edge = lambda df, a, b: df.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"))
    edges = {"placed": edge(t("orders"), "o_custkey", "o_orderkey"), "holds": edge(t("lineitem"), "l_orderkey", "l_suppkey"), "in": edge(t("supplier"), "s_suppkey", "s_nationkey")}
    nodes = {"customer": t("customer").withColumn("id", F.col("c_custkey").cast("long")), "nation": t("nation").withColumn("id", F.col("n_nationkey").cast("long"))}
    steps = (patterns.Step("placed", "order"), patterns.Step("holds", "supplier"), patterns.Step("in", "nation"))
    where = {0: F.col("c_mktsegment") == "BUILDING", -1: F.col("n_name").like("%1%")}
    return patterns.match(patterns.Graph(edges, nodes), patterns.Pattern("customer", steps), where)


@query(r"""WITH t AS (SELECT conv_id AS id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS q, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS a,
 list(text) FILTER (role = 'system') AS cs, coalesce(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS c FROM conversations GROUP BY 1),
k AS (SELECT id, list_distinct(regexp_extract_all(lower(q), '[\p{L}\p{N}]+')) AS q, list_distinct(regexp_extract_all(lower(a), '[\p{L}\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(c), '[\p{L}\p{N}]+')) AS c,
 list_transform(cs, lambda x: list_distinct(regexp_extract_all(lower(x), '[\p{L}\p{N}]+'))) AS cs FROM t),
s AS (SELECT CASE WHEN len(q) > 0 THEN len(list_intersect(q, a))::DOUBLE / len(q) ELSE 0 END AS r, list_avg(list_transform(cs, lambda x: CASE WHEN len(q) > 0 THEN len(list_intersect(q, x))::DOUBLE / len(q) ELSE 0 END)) AS v,
 CASE WHEN len(a) > 0 THEN len(list_intersect(a, c))::DOUBLE / len(a) ELSE 0 END AS g FROM k)
SELECT 'answer_relevance' AS metric, count(r) AS n, round(avg(r), 9) AS mean FROM s UNION ALL SELECT 'context_relevance', count(v), round(avg(v), 9) FROM s UNION ALL SELECT 'groundedness', count(g), round(avg(g), 9) FROM s""")
def triad_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triad as registered metrics over JSON records, contexts judged one by one, and their means."""
    log = _logged(spark, sf_dir).withColumn("answer", F.coalesce("answer", F.lit("")))
    records = log.select(F.col("id").alias("record_id"), F.to_json(F.struct("question", "answer", "contexts")).alias("record"))
    return metrics.rollup(metrics.evaluated(records, metrics.triad())).withColumn("mean", F.round("mean", 9))


@query("""WITH p AS (SELECT o_orderkey AS doc_id, 500 + o_orderkey % 300 AS w, 700 + o_orderkey % 200 AS h FROM orders),
b AS (SELECT l_orderkey * 8 + l_linenumber AS block_id, l_orderkey AS doc_id, l_linenumber % 2 AS k, l_partkey % 700 AS x, l_suppkey % 800 AS y, l_quantity * 9 AS dx, l_quantity * 3 AS dy FROM lineitem),
q AS (SELECT block_id, doc_id, k, w, h, x * w / 842.0 - CASE k WHEN 0 THEN 0 ELSE 6 END AS a, y * w / 842.0 - CASE k WHEN 0 THEN 0 ELSE 14 END AS b, (x + dx) * w / 842.0 + CASE k WHEN 0 THEN 30 ELSE 20 END AS c,
 (y + dy) * w / 842.0 + CASE k WHEN 0 THEN 60 ELSE 18 END AS d FROM b JOIN p USING (doc_id)),
t AS (SELECT l_orderkey AS doc_id, l_partkey % 500 AS x0, l_suppkey % 700 AS y0, l_partkey % 500 + 90 AS x1, l_suppkey % 700 + l_quantity AS y1 FROM lineitem),
s AS (SELECT block_id, max(x1) AS r, max(y1) AS l FROM q JOIN t ON q.doc_id = t.doc_id AND k = 0 AND x0 < c AND x1 > a AND y0 < d AND y1 > b GROUP BY 1),
e AS (SELECT block_id, greatest(a, 0) AS x0, greatest(b, 0) AS y0, least(greatest(c, coalesce(r, c)), w) AS x1, least(greatest(d, coalesce(l, d)), h) AS y1 FROM q LEFT JOIN s USING (block_id))
SELECT block_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM e WHERE x1 - x0 >= 20 AND y1 - y0 >= 20""")
def page_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and formulas on pages whose boxes come from order lines."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    pages = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"), (500 + F.col("o_orderkey") % 300).alias("width"), (700 + F.col("o_orderkey") % 200).alias("height"))
    x, y, dx = F.col("l_partkey") % 700, F.col("l_suppkey") % 800, F.col("l_quantity")
    box = F.array(*[c.cast("double") for c in (x, y, x + dx * 9, y + dx * 3)])
    kind = F.when(F.col("l_linenumber") % 2 == 0, "table").otherwise("formula")
    blocks = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("block_id"), F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), kind.alias("kind"), box.alias("bbox"))
    left, top = F.col("l_partkey") % 500, F.col("l_suppkey") % 700
    texts = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), left.alias("x0"), top.alias("y0"), (left + 90).alias("x1"), (top + dx).alias("y1"))
    return layout.crops(blocks, pages, texts).select("block_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


# Streams with state.


def _stream(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """df as a stream of files of a folder, and a folder for its results."""
    folder = fresh_folder(spark, "stream")
    df.write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).parquet(f"{folder}/in"), folder


def _run(stream: DataFrame, folder: str) -> DataFrame:
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1), h AS (SELECT start, start - INTERVAL 1 HOUR * row_number() OVER (ORDER BY start) AS run FROM w WHERE n >= 10)
SELECT min(start) AS since, max(start) + INTERVAL 1 HOUR AS until FROM h GROUP BY run HAVING max(start) + INTERVAL 1 HOUR - min(start) >= INTERVAL 3 HOUR""")
def firing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that have to hold for three hours, on a stream of hourly counts; those resolved when all is replayed."""
    state.configured(spark)
    events = _events(spark, sf_dir).select("ts")
    later = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))  # moves the watermark past the last window
    rows, folder = _stream(spark, events.unionByName(later))
    hourly = alerts.stream_of(rows, "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    windows = hourly.select(F.col("w.start").alias("start"), (F.col("n") >= 10).alias("holds"), F.window_time("w").alias("ts"))
    return _run(state.firing_stream(windows, dt.timedelta(hours=1), dt.timedelta(hours=3)), folder).where("state = 'resolved'").select("since", "until")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM g),
k AS (SELECT *, max(life) OVER (PARTITION BY user_id) AS now, max(ts) OVER (PARTITION BY user_id) AS last FROM r)
SELECT user_id, event_id FROM k WHERE life = now AND last > (SELECT max(ts) FROM events) - INTERVAL 1 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10""")
def conversation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten events of users that were active within a day, out of the state of a stream."""
    state.configured(spark)
    events = _events(spark, sf_dir)
    rows, folder = _stream(spark, events.select("user_id", F.col("event_id").alias("turn"), "ts", F.col("event_type").alias("text")))
    _run(state.conversation_stream(alerts.stream_of(rows, "0 seconds"), "user_id", seconds=86400), folder)
    return state.kept_turns(spark, f"{folder}/state", "user_id").select("user_id", F.col("turn").alias("event_id"))


@query()
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of every six hours, sliding by one, from hourly sketches."""
    rows = alerts.sketches(_events(spark, sf_dir), "value", "1 hour", "event_type")
    return alerts.sliding_quantiles(rows, [0.5, 0.95], "6 hours", "1 hour", "event_type")
