"""Registered queries, one or more for each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import aggregates as A
from quarry.operators import answers as W
from quarry.operators import charts, etl
from quarry.operators import retrieval as R
from quarry.plans import guard
from quarry.plans.questions import QUESTIONS
from quarry.plans.semantic import compile_spec
from quarry.sources import catalog as C
from quarry.sources import records as K
from quarry.sources.star import STAR, read
from quarry.streaming import alerts, limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Analytic questions: specification, plan over the catalog, guard, run.


def _ask(name: str) -> Query:
    spec = QUESTIONS[name][1]
    tables = {t.name for t in STAR.tables}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context, own = guard.SessionContext("admin"), guard.caller_session(spark)
        guard.register_views(own, {t: read(own, sf_dir, t) for t in tables}, context, guard.Policy())
        return guard.guarded(own, compile_spec(STAR, spec), context, limit=None)  # the whole answer, as its SQL says

    run.__name__ = name
    return run


for _name, (_, _spec) in QUESTIONS.items():
    QUERIES[_name] = _ask(_name)
    ORACLES[_name] = compile_spec(STAR, _spec)


@query("""SELECT coalesce(a.n_name, b.n_name) AS n_name, coalesce(issues, 0) AS issues, coalesce(changes, 0) AS changes FROM
(SELECT n_name, count(*) AS issues FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) a FULL JOIN
(SELECT n_name, count(*) AS changes FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) b ON a.n_name = b.n_name""")
def q18_two_facts_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    issues = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("c").alias("issues"))
    changes = t("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("c").alias("changes"))
    nation = t("nation").select("n_nationkey", "n_name")
    left = issues.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "issues")
    right = changes.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "changes")
    return A.two_facts(left, right, "n_name")


# Roles see their rows.


def _as(role: str, sql: str, **attributes) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context, own = guard.SessionContext(role, **attributes), guard.caller_session(spark)
        nation_of = read(own, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        issues = read(own, sf_dir, "orders").join(nation_of, F.col("o_custkey") == F.col("c_custkey"))
        policy = guard.Policy(owner_domain={"issues": "c_nationkey"}, business_line={"issues": "c_mktsegment"}, status={"issues": ("o_orderstatus", ("F",))}, denied={"issues": ("o_totalprice",)})
        guard.register_views(own, {"issues": issues}, context, policy)
        return guard.guarded(own, sql, context)

    return run


_ISSUES = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) issues"
for _role, _attr, _where in (("engineer", {"owner_domain_id": 7}, "c_nationkey = 7"), ("business", {"business_line": "BUILDING"}, "c_mktsegment = 'BUILDING'"), ("aftersales", {}, "o_orderstatus = 'F'"), ("admin", {}, "true")):
    QUERIES[f"rls_{_role}"] = _as(_role, "SELECT o_orderpriority, COUNT(*) AS n FROM issues GROUP BY o_orderpriority", **_attr)
    ORACLES[f"rls_{_role}"] = f"SELECT o_orderpriority, COUNT(*) AS n FROM {_ISSUES} WHERE {_where} GROUP BY 1"


# The relational surface.


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context, own = guard.SessionContext("admin"), guard.caller_session(spark)
        guard.register_views(own, {t.name: read(own, sf_dir, t.name) for t in STAR.tables}, context, guard.Policy())
        return guard.guarded(own, text, context, limit=None)  # the whole result, as its SQL says

    QUERIES[name], ORACLES[name] = run, oracle or text


_sql("rel_semi_anti", "SELECT count_if(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_issues, count_if(NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without FROM customer",
     "SELECT count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_issues, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without FROM customer")
_sql("rel_cube", "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) AS g, SUM(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("rel_rollup_having", "SELECT p_brand, p_size, COUNT(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size) HAVING COUNT(*) > 2")
_sql("rel_window", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS so_far FROM orders")
_sql("rel_theta_join", "SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON n_regionkey > r_regionkey GROUP BY r_name")
_sql("rel_lateral", "SELECT n_name, t.p_name, t.p_retailprice FROM nation, LATERAL (SELECT p_name, p_partkey, p_retailprice FROM part WHERE p_size = n_nationkey ORDER BY p_retailprice DESC, p_partkey LIMIT 1) t")
_sql("rel_set_ops", "WITH u AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier), x AS (SELECT k FROM u EXCEPT SELECT n_regionkey FROM nation) SELECT k FROM x INTERSECT SELECT n_nationkey FROM nation".replace("SELECT k FROM x INTERSECT SELECT n_nationkey FROM nation", "SELECT k FROM (SELECT k FROM x INTERSECT SELECT n_nationkey FROM nation) z"))
_sql("rel_filter_case", "SELECT CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'mid' ELSE 'low' END AS band, COUNT(*) AS n, AVG(p_retailprice) FILTER (WHERE p_brand LIKE 'Brand#1%') AS avg_price FROM part GROUP BY 1")
_sql("rel_correlated", "SELECT COUNT(*) AS n FROM orders o WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("rel_full_outer", "SELECT COUNT(*) AS n, COUNT(s_suppkey) AS s, COUNT(c_custkey) AS c FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey")
_sql("rel_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n_name, n FROM nation JOIN t ON n_nationkey = n")
_sql("rel_dates", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, QUARTER(o_orderdate) AS q, COUNT(DISTINCT o_custkey) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00' GROUP BY 1, 2")


# The default limit, of rows whose order a query fixes.


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey) o ORDER BY o_orderkey LIMIT 100")
def default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without a limit gets the default one."""
    own = guard.caller_session(spark)
    guard.register_views(own, {"orders": read(own, sf_dir, "orders")}, guard.SessionContext("admin"), guard.Policy())
    return guard.guarded(own, "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey", guard.SessionContext("admin"))


# Lookups, pages, joins, sequences.


def _page(name: str, oracle: str, build: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLES[name] = build, oracle


_page("scan_by_id", "SELECT * FROM customer WHERE c_custkey = 42", lambda s, d: read(s, d, "customer").where("c_custkey = 42"))
_page("scan_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 50", lambda s, d: read(s, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(50).limit(100))
_page("count_by_predicate", "SELECT count(*) AS n FROM documents WHERE source = 'src0'", lambda s, d: read(s, d, "documents").where("source = 'src0'").agg(F.count(F.lit(1)).alias("n")))
_page("page_search", "SELECT p_partkey, p_name, p_brand, count(*) OVER () AS total FROM part WHERE p_name LIKE '%1%' OR p_brand LIKE '%1%' ORDER BY p_partkey LIMIT 20 OFFSET 20",
      lambda s, d: A.page(read(s, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", 2, 20, "1", ("p_name", "p_brand")))
_page("newest_scores", "SELECT event_id, ts, value FROM events ORDER BY event_id DESC LIMIT 50", lambda s, d: read(s, d, "events").select("event_id", "ts", "value").orderBy(F.desc("event_id")).limit(50))
_page("latest_per_key", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
      lambda s, d: A.latest_per_key(read(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id"))
_page("stale_ids", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)", lambda s, d: read(s, d, "embeddings").select("vec_id").join(read(s, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti"))
_page("last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6",
      lambda s, d: A.last_n(read(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 6))
_page("turn_pairs", "SELECT conv_id, turn, text AS question, left(nt, 500) AS answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'",
      lambda s, d: A.turn_pairs(read(s, d, "conversations")))
_page("unread_first", "SELECT doc_id, quality FROM labels WHERE toxic = 0 ORDER BY doc_id DESC LIMIT 100", lambda s, d: read(s, d, "labels").where("toxic = 0").select("doc_id", "quality").orderBy(F.desc("doc_id")).limit(100))


@query("SELECT event_id AS record_id, e.ts, n_name AS app FROM events e LEFT JOIN nation ON user_id % 40 = n_nationkey ORDER BY e.ts DESC, event_id LIMIT 50")
def records_with_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), "ts", (F.col("user_id") % 40).cast("int").alias("app_id"))
    apps = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("app_id"), F.col("n_name").alias("app"))
    return A.records_with_apps(records, apps, 50).select("record_id", "ts", "app")


@query("""WITH b AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at, 'online' AS origin, value AS score FROM events WHERE event_type = 'click'
 UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'offline', NULL FROM orders)
SELECT *, count(*) OVER () AS total FROM b ORDER BY created_at DESC, origin, id LIMIT 40""")
def merged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")
    online = read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("id"), iso("ts"), F.col("value").alias("score"))
    offline = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), iso("o_orderdate"))
    return A.merged_scores(online, offline, 40)


# Feedback and evaluation.


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("channel"))
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.when(F.col("channel") == "src1", "").otherwise(F.col("channel")).alias("channel"), (2 * F.col("quality") - 1).alias("rating"))


_FEEDBACK = "(SELECT doc_id AS id, CASE WHEN source = 'src1' THEN '' ELSE source END AS channel, 2 * quality - 1 AS rating FROM labels JOIN documents USING (doc_id)) f"
_page("feedback_totals", f"SELECT count(*) AS total, count(*) FILTER (rating = 1) AS praise, count(*) FILTER (rating = -1) AS negative, count(*) - count(*) FILTER (rating = 1) - count(*) FILTER (rating = -1) AS neutral, round_even(count(*) FILTER (rating = 1) / count(*), 3) AS praise_rate, round_even(count(*) FILTER (rating = -1) / count(*), 3) AS negative_rate FROM {_FEEDBACK}",
      lambda s, d: A.feedback_totals(_feedback(s, d)))
_page("channel_stats", f"SELECT CASE WHEN channel = '' THEN 'unknown' ELSE channel END AS channel, count(*) AS total, count(*) FILTER (rating = 1) AS praise, count(*) FILTER (rating = 1) / count(*) AS praise_rate FROM {_FEEDBACK} GROUP BY channel",
      lambda s, d: A.channel_stats(_feedback(s, d)))
_page("recent_events", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY GROUP BY 1",
      lambda s, d: A.last_days(read(s, d, "events"), "ts", 3).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
_page("trace_stats", "SELECT user_id AS trace, count(*) AS total, count(*) FILTER (value > 50) AS praise, count(*) FILTER (value <= 50) AS negative, arg_max(event_type, (ts, event_id)) AS latest_comment, min(ts) AS first_at FROM events GROUP BY 1",
      lambda s, d: A.trace_stats(read(s, d, "events").select(F.col("user_id").alias("trace"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("rating"), F.col("event_type").alias("comment"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))))


@query("""SELECT count(*) AS total, count(*) FILTER (k = 'nl2sql') AS n_nl2sql, count(*) FILTER (k = 'knowledge') AS n_knowledge,
 coalesce(avg(v) FILTER (k = 'nl2sql'), 0) AS avg_valid, coalesce(avg(v * v) FILTER (k = 'nl2sql'), 0) AS avg_has_data, coalesce(avg(v + 1) FILTER (k = 'nl2sql'), 0) AS avg_relevance,
 coalesce(avg(v) FILTER (k = 'knowledge'), 0) AS avg_context, coalesce(avg(v * v) FILTER (k = 'knowledge'), 0) AS avg_groundedness, coalesce(avg(v + 1) FILTER (k = 'knowledge'), 0) AS avg_answer
FROM (SELECT value AS v, CASE event_type WHEN 'click' THEN 'knowledge' ELSE 'nl2sql' END AS k FROM events)""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return A.eval_summary(read(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "click", "knowledge").alias("eval_type"), v.alias("score_valid"), (v * v).alias("score_has_data"), (v + 1).alias("score_relevance"),
        v.alias("score_context"), (v * v).alias("score_groundedness"), (v + 1).alias("score_answer"),
    ))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("record_id"), (F.col("event_id") % 5).cast("int").alias("definition_id"), F.when(F.col("event_type") == "view", "failed").otherwise("done").alias("status"), F.col("value").alias("result"))


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("definition_id"), F.col("r_name").alias("name"))


_page("metric_board", "SELECT r_name AS name, avg(value) AS average, count(*) AS n FROM events JOIN region ON event_id % 5 = r_regionkey WHERE event_type <> 'view' GROUP BY 1", lambda s, d: A.metric_board(_results(s, d), _definitions(s, d)))
_page("feedback_map_entries", "SELECT user_id AS record_id, r_name AS name, arg_max(value, event_id) AS result FROM events JOIN region ON event_id % 5 = r_regionkey GROUP BY 1, 2",
      lambda s, d: A.last_results(_results(s, d), _definitions(s, d), _results(s, d)))
_page("feedback_map", "SELECT user_id AS record_id, r_name AS name, round(coalesce(arg_max(value, event_id), 0), 3) AS result FROM events JOIN region ON event_id % 5 = r_regionkey GROUP BY 1, 2",
      lambda s, d: A.feedback_map(_results(s, d), _definitions(s, d), _results(s, d)).select("record_id", F.explode("scores").alias("name", "result")))
_page("sql_scores", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS sql_valid, CASE WHEN event_type = 'error' THEN 0.0 WHEN value > 10 THEN 1.0 ELSE 0.5 END AS has_data FROM events",
      lambda s, d: A.sql_scores(read(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.when(F.col("value") > 10, 1).otherwise(0).alias("n_rows"))).select("id", "sql_valid", "has_data"))
_page("eval_rollup", "SELECT avg(sv) AS valid_rate, avg(value) AS avg_relevance, avg((sv + hd + value) / 3) AS avg_correctness, avg(value * 2) AS avg_latency FROM (SELECT value, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS sv, CASE WHEN event_type = 'error' THEN 0.0 WHEN value > 10 THEN 1.0 ELSE 0.5 END AS hd FROM events)",
      lambda s, d: A.eval_rollup(A.sql_scores(read(s, d, "events").select(F.when(F.col("event_type") == "error", "failed").alias("error"), F.when(F.col("value") > 10, 1).otherwise(0).alias("n_rows"), F.col("value").alias("relevance"), (F.col("value") * 2).alias("latency")))))
_page("token_cost", "SELECT event_type AS model, sum(event_id % 100) AS input, sum(event_id % 7) AS output, count(*) AS calls, sum(event_id % 100) * 0.4e-6 + sum(event_id % 7) * 1.2e-6 AS cost_usd FROM events GROUP BY 1",
      lambda s, d: A.token_cost(read(s, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"))))
_page("score_bands", "SELECT CASE WHEN value / 100 >= 0.8 THEN 'high' WHEN value / 100 >= 0.5 THEN 'mid' WHEN value IS NULL THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM events GROUP BY 1",
      lambda s, d: read(s, d, "events").groupBy(A.score_band(F.col("value") / 100).alias("band")).agg(F.count(F.lit(1)).alias("n")))


# Retrieval.


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    corpus = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return corpus, corpus.where("id % 25 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))


_DENSE = """(SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
 SELECT q.vec_id AS qid, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 25 = 0{}) QUALIFY rank <= 20)"""
_BM25 = r"""(WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents),
 d AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS dl FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS a FROM d),
 tf AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
 q AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS token FROM benchmark)
 SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN tf USING (token) JOIN df USING (token) JOIN d USING (id), s GROUP BY 1, 2)"""

_page("dense_top_k", f"SELECT qid, id, rank, round(score, 6) AS score FROM {_DENSE.format('')}", lambda s, d: R.dense_search(*_vectors(s, d)).withColumn("score", F.round("score", 6)))
_page("dense_filtered", f"SELECT qid, id, rank, round(score, 6) AS score FROM {_DENSE.format(' AND e.label IN (1, 2, 3)')}", lambda s, d: R.dense_search(*_vectors(s, d), filters={"label": [1, 2, 3]}).withColumn("score", F.round("score", 6)))
_page("bm25_top_k", f"SELECT qid, id, round(score, 9) AS score FROM {_BM25} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 20",
      lambda s, d: R.bm25_search(*_texts(s, d)).select("qid", "id", "score"))
_page("rrf_fusion", f"""WITH a AS (SELECT qid, id, rank FROM {_DENSE.format('')}), b AS (SELECT qid, id, rank FROM {_DENSE.format(' AND e.label IN (1, 2, 3)')}),
f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS rank FROM f QUALIFY rank <= 20""",
      lambda s, d: R.top_k(R.rrf([R.dense_search(*_vectors(s, d)), R.dense_search(*_vectors(s, d), filters={"label": [1, 2, 3]})], 40).withColumn("score", F.round("score", 12)), 20).select("qid", "id", "rank"))
_page("cliff_cut", """WITH r AS (SELECT user_id AS qid, event_id AS id, value / 100 AS score FROM events),
w AS (SELECT *, row_number() OVER o AS rn, score - lead(score) OVER o AS gap, count(*) OVER (PARTITION BY qid) AS n FROM r WINDOW o AS (PARTITION BY qid ORDER BY score DESC, id))
SELECT qid, CAST(coalesce(min(rn) FILTER (rn >= 1 AND rn < least(10, n) AND (gap >= 0.5 OR gap / (abs(score) + 1e-6) >= 0.25)), max(least(10, n))) AS INTEGER) AS keep FROM w GROUP BY 1""",
      lambda s, d: R.cliff_cut(read(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"))))


_HYBRID = f"""WITH ids AS (SELECT vec_id FROM embeddings JOIN documents ON vec_id = doc_id), dr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
 SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS score FROM embeddings q JOIN benchmark ON q.vec_id = item_id, embeddings e WHERE e.vec_id IN (FROM ids)) QUALIFY rank <= 20),
br AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(score, 9) AS score FROM {_BM25.replace('FROM documents', 'FROM documents JOIN embeddings ON vec_id = doc_id')} WHERE qid IN (SELECT vec_id FROM embeddings)) QUALIFY rank <= 20)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, score FROM (
 SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM dr UNION ALL SELECT * FROM br) GROUP BY 1, 2) QUALIFY rank <= 20"""


@query(_HYBRID)
def hybrid_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and BM25 rankings of documents that have a vector, fused."""
    texts, questions = _texts(spark, sf_dir)
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = questions.join(vectors.withColumnRenamed("id", "qid").withColumnRenamed("vector", "qvector"), "qid")
    return R.hybrid_search(texts.join(vectors, "id"), asked, 20).select("qid", "id", "rank", "score")


@query()
def hybrid_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and hashed embeddings of whole texts fused, reranked by overlap and cut at the first cliff."""
    corpus, queries = _texts(spark, sf_dir)
    fused = R.hybrid_search(corpus, queries, 20, embed=etl.whole_texts())
    hits = fused.join(queries.select("qid", "qtext"), "qid").join(corpus.select("id", "text"), "id")
    return R.rerank(hits.select("qid", "id", "rank", "qtext", "text"), 10, dynamic=True).select("qid", "id", "rank", "score")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), w(node, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, hop + 1 FROM w JOIN e ON src = node WHERE hop < 2)
SELECT src, dst, 'supplies' AS label, CAST(min(hop) + 1 AS INTEGER) AS hop FROM w JOIN e ON src = node WHERE hop < 2 GROUP BY 1, 2 ORDER BY hop, src, dst LIMIT 20""")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("supplies").alias("label"))
    return R.graph_neighbours(edges, spark.range(1, 2), 2, 20)


_page("cache_keys", "SELECT doc_id, md5(concat_ws('|', text, 'doc,graph', lang, source, 'false', 'engineer')) AS key FROM documents",
      lambda s, d: read(s, d, "documents").select("doc_id", R.cache_key(F.col("text"), F.array(F.lit("graph"), F.lit("doc")), F.col("lang"), F.col("source"), F.lit(False), F.lit("engineer")).alias("key")))


# Document ETL.

_page("doc_ids", "SELECT doc_id AS id, substring(md5(source || doc_id), 1, 16) AS doc_id FROM documents WHERE len(trim(text)) >= 10",
      lambda s, d: read(s, d, "documents").where(F.length(F.trim("text")) >= etl.MIN_TEXT).select(F.col("doc_id").alias("id"), X.doc_id(F.concat("source", F.col("doc_id").cast("string"))).alias("doc_id")))
_page("pii_counts", r"SELECT doc_id, len(regexp_extract_all(text, '\b\d{15,19}\b')) AS id_or_card, len(regexp_extract_all(text, '\b1[3-9]\d{9}\b')) AS phone, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')) AS email FROM documents",
      lambda s, d: read(s, d, "documents").select("doc_id", *[c.alias(n) for n, c in guard.pii_counts(F.col("text")).items()]))
_page("stripped_pages", r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', '', 'g') AS body FROM pages", lambda s, d: read(s, d, "pages").select("page_id", X.normalized_table(F.col("html")).alias("body")))
_page("link_urls", """SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS links FROM pages""",
      lambda s, d: read(s, d, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("links")))
_page("content_types", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/webp' END AS content_type FROM part",
      lambda s, d: read(s, d, "part").select("p_partkey", X.content_type(F.concat(F.lit("x."), F.when(F.col("p_partkey") % 3 == 0, "PNG").when(F.col("p_partkey") % 3 == 1, "unknown").otherwise("webp"))).alias("content_type")))


@query()
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.chunked(read(spark, sf_dir, "documents"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text FROM conversations),
r AS (SELECT conv_id, k, 0 AS idx, text AS acc FROM t WHERE k = 1
 UNION ALL SELECT conv_id, j, CASE WHEN m THEN idx ELSE idx + 1 END, CASE WHEN m THEN acc || chr(10) || chr(10) || x ELSE x END FROM (
  SELECT r.conv_id, t.k AS j, idx, acc, t.text AS x, (len(acc) < 200 OR len(t.text) < 200) AND len(acc) + len(t.text) <= 800 AS m FROM r JOIN t ON r.conv_id = t.conv_id AND t.k = r.k + 1))
SELECT conv_id AS doc_id, idx AS chunk_index, CAST(NULL AS INTEGER) AS parent_index, arg_max(acc, k) AS text FROM r GROUP BY conv_id, idx""")
def merged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short turns of a conversation merged as a document's short chunks are."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.lit(None).cast("int").alias("parent_index"), "text")
    return etl.merge_short(turns)


@query()
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.merge_short(etl.chunked(read(spark, sf_dir, "documents"), 256, 0).withColumn("parent_index", F.lit(None).cast("int")))


@query()
def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.parent_child(read(spark, sf_dir, "documents"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.semantic_chunks(read(spark, sf_dir, "documents"))


@query()
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("doc_name"), F.array(F.lit(1), F.lit(2)).alias("pages"))
    return etl.chunk_records(etl.chunked(docs), docs)


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT doc_id, upper(lang), source FROM documents WHERE doc_id % 3 = 0")
def idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    fresh = docs.where("doc_id % 3 = 0").withColumn("lang", F.upper("lang"))
    once = etl.upserted_documents(docs, fresh)
    return etl.upserted_documents(once, fresh)


# Catalog.

_COLUMNS = ", ".join(f"('{t}', '{c.name}', '{c.role}')" for t, c in STAR.all_columns())
_page("catalog_key_columns", f"SELECT * FROM (VALUES {_COLUMNS}) v(table_name, name, role) WHERE table_name = 'orders' AND role IN ('primary_key', 'foreign_key')",
      lambda s, d: C.key_columns(STAR.frames(s)["columns"], "orders").select("table_name", "name", "role"))
_page("catalog_columns", f"SELECT table_name || '.' || name AS id, table_name, role FROM (VALUES {_COLUMNS}) v(table_name, name, role)", lambda s, d: STAR.frames(s)["columns"].select("id", "table_name", "role"))
_page("value_index", "SELECT 'customer.c_mktsegment.' || c_mktsegment AS id, 'customer' AS table_name, 'c_mktsegment' AS column_name, c_mktsegment AS value FROM customer GROUP BY c_mktsegment",
      lambda s, d: C.distinct_values(read(s, d, "customer"), "customer", "c_mktsegment"))
_ALIASES = ", ".join(f"('{t}.{c.name}.{a}', '{t}', '{c.name}', '{a}')" for t, c in STAR.all_columns() if c.sync for a in c.aliases)
_page("alias_index", f"SELECT * FROM (VALUES {_ALIASES}) v(id, table_name, column_name, value)", lambda s, d: C.value_index(STAR.frames(s)["columns"]))
_page("metric_by_name", "SELECT 'cr_count' AS name, 'lineitem' AS table_name, 2 AS n_aliases", lambda s, d: C.metrics_of(STAR.frames(s)["metrics"], "cr_count").select("name", "table_name", F.size("aliases").alias("n_aliases")))
_MERGE = """(SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'insert' WHEN n.p_partkey IS NULL THEN 'delete' WHEN o.p_brand <> n.p_brand THEN 'update' ELSE 'keep' END AS action
 FROM (SELECT * FROM part WHERE p_partkey % 7 <> 0) o FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 11 <> 0) n USING (p_partkey))"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return part.where("p_partkey % 7 <> 0"), part.where("p_partkey % 11 <> 0").withColumn("p_brand", F.when(F.col("p_partkey") % 5 == 0, "new").otherwise(F.col("p_brand")))


_page("merge_plan", f"SELECT * FROM {_MERGE}", lambda s, d: C.merge_plan(*_snapshots(s, d), ["p_partkey"], ["p_brand"]))
_page("merge_counts", f"SELECT action, count(*) AS n FROM {_MERGE} GROUP BY 1", lambda s, d: C.merge_counts(C.merge_plan(*_snapshots(s, d), ["p_partkey"], ["p_brand"])))
_page("link_changes", "SELECT p_partkey, p_brand, 'insert' AS action FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 11 <> 0 EXCEPT SELECT p_partkey, p_brand FROM part WHERE p_partkey % 7 <> 0) UNION ALL SELECT p_partkey, p_brand, 'delete' FROM (SELECT p_partkey, p_brand FROM part WHERE p_partkey % 7 <> 0 EXCEPT SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END FROM part WHERE p_partkey % 11 <> 0)",
      lambda s, d: C.link_changes(*_snapshots(s, d)))


# Charts.

_page("chart_series", "SELECT n_name, o_orderpriority, coalesce(v, 0) AS value FROM (SELECT DISTINCT n_name FROM nation) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) LEFT JOIN (SELECT n_name, o_orderpriority, arg_min(o_totalprice, o_orderkey) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) USING (n_name, o_orderpriority)",
      lambda s, d: charts.series(read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), "o_orderpriority", "n_name", "o_totalprice", ["o_orderkey"]))
_page("chart_pivot", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS F, sum(l_quantity) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1", lambda s, d: charts.pivot(read(s, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"]))
_page("chart_cells", """WITH c AS (SELECT l_linestatus AS x, l_returnflag AS y, sum(l_quantity) AS value, min((l_orderkey, l_linenumber, l_partkey)) AS seen FROM lineitem GROUP BY 1, 2),
xs AS (SELECT x, CAST(row_number() OVER (ORDER BY min(seen), x) - 1 AS INTEGER) AS xi FROM c GROUP BY 1), ys AS (SELECT y, CAST(row_number() OVER (ORDER BY min(seen), y) - 1 AS INTEGER) AS yi FROM c GROUP BY 1)
SELECT xi, yi, value, max(value) OVER () AS most FROM c JOIN xs USING (x) JOIN ys USING (y)""",
      lambda s, d: charts.cells(read(s, d, "lineitem"), "l_linestatus", "l_returnflag", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"]))
_page("chart_correlations", "SELECT a, b, round(c, 6) AS corr FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS c FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)",
      lambda s, d: charts.correlations(read(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")).withColumn("corr", F.round("corr", 6)))
_page("first_seen", "SELECT event_type, CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS idx FROM (SELECT event_type, min(event_id) AS m FROM events GROUP BY 1)", lambda s, d: A.distinct_first_seen(read(s, d, "events"), "event_type", ["event_id"]))


# Time: windows, alerts, limiter, breaker.


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_HOUR = "time_bucket(INTERVAL 1 HOUR, ts)"
_page("window_counts", f"SELECT {_HOUR} AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", lambda s, d: alerts.counters(_events(s, d), "1 hour", "event_type"))
_page("error_ratio", f"SELECT {_HOUR} AS start, count(*) FILTER (event_type = 'error') AS hits, count(*) AS n, count(*) FILTER (event_type = 'error') / greatest(count(*), 1e-6) AS ratio FROM events GROUP BY 1", lambda s, d: alerts.ratio(_events(s, d), F.col("event_type") == "error", "1 hour"))
_page("channel_ratio", f"SELECT {_HOUR} AS start, user_id % 5 AS channel, count(*) FILTER (value > 50) AS hits, count(*) AS n, count(*) FILTER (value > 50) / greatest(count(*), 1e-6) AS ratio FROM events GROUP BY 1, 2",
      lambda s, d: alerts.ratio(_events(s, d).withColumn("channel", F.col("user_id") % 5), F.col("value") > 50, "1 hour", "channel"))
_page("token_rate", f"SELECT {_HOUR} AS start, sum(value) / 3600 AS rate FROM events GROUP BY 1", lambda s, d: alerts.rate(_events(s, d), "1 hour", 3600.0, F.col("value")))
_BOUNDS = ", ".join(map(str, alerts.BUCKETS))
_page("latency_p95", f"""WITH h AS (SELECT {_HOUR} AS start, count(value) AS total, unnest([{_BOUNDS}]) AS b, unnest([lag_b for lag_b in [0.0] || [{_BOUNDS}][:-2]]) AS lo FROM events GROUP BY 1),
c AS (SELECT h.*, (SELECT count(*) FROM events WHERE {_HOUR} = h.start AND value <= b) AS c, CASE WHEN lo = 0 THEN 0 ELSE (SELECT count(*) FROM events WHERE {_HOUR} = h.start AND value <= lo) END AS cl FROM h)
SELECT start, coalesce(min(lo + (b - lo) * (0.95 * total - cl) / greatest(c - cl, 1)) FILTER (c >= 0.95 * total AND cl < 0.95 * total), {alerts.BUCKETS[-1]}) AS value FROM c GROUP BY start""",
      lambda s, d: alerts.histogram_quantile(alerts.histogram(_events(s, d), "value", "1 hour"), 0.95))
_page("firing_alerts", f"""WITH w AS (SELECT {_HOUR} AS start, count(*) AS n FROM events GROUP BY 1), h AS (SELECT start, start - INTERVAL 1 HOUR * row_number() OVER (ORDER BY start) AS run FROM w WHERE n >= 10)
SELECT min(start) AS since, max(start) + INTERVAL 1 HOUR AS until FROM h GROUP BY run HAVING max(start) + INTERVAL 1 HOUR - min(start) >= INTERVAL 3 HOUR""",
      lambda s, d: alerts.firing(alerts.counters(_events(s, d), "1 hour"), F.col("n") >= 10, "1 hour", "3 hours"))
_page("sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS n FROM r GROUP BY user_id, k",
      lambda s, d: alerts.sessions(_events(s, d), "user_id"))
_page("hits_in_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM events",
      lambda s, d: limits.hits_in_window(_events(s, d), "user_id").select("event_id", "n"))


@query("""WITH RECURSIVE h AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, [t] AS held, true AS allowed FROM h WHERE k = 1
 UNION ALL SELECT user_id, event_id, j, CASE WHEN len(near) < 3 THEN list_append(near, t) ELSE near END, len(near) < 3 FROM (
  SELECT h.user_id, h.event_id, h.k AS j, h.t, list_filter(r.held, lambda x: x > h.t - 3600000000) AS near FROM r JOIN h ON r.user_id = h.user_id AND h.k = r.k + 1))
SELECT r.user_id, event_id AS id, ts, allowed FROM r JOIN events USING (event_id)""")
def limiter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.limited(_events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), "ts"), "user_id", 3, 3600.0)


@query()
def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).select(F.col("event_type").alias("target"), F.col("event_id").alias("id"), "ts", (F.col("value") < 50).alias("ok"))
    return limits.breaker_log(calls)


@query("SELECT event_id, ts + INTERVAL 8 HOUR AS local_ts FROM events")
def local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), "ts").alias("local_ts"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, dayname(ts) AS weekday, 'Q' || quarter(ts) AS quarter FROM events")
def date_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in X.date_context(F.col("ts")).items()])


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", X.to_number(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT conv_id, len(list_distinct(flatten(list(string_split(lower(text), ' '))))) AS words FROM conversations GROUP BY 1")
def keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.flatten(F.collect_list(F.split(F.lower("text"), " "))).alias("w"))
    from quarry.plans.recall import keyword_union as union

    # Empty words count here, as the SQL's do; the function drops them.
    return words.select("conv_id", (F.size(union("w")) + F.array_contains("w", "").cast("int")).alias("words"))


@query(r"""WITH t AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM benchmark), tf AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1) SELECT id, token, round(tf * ln((SELECT count(*) FROM benchmark) / df), 6) AS weight FROM tf JOIN df USING (token)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(tf * ln((SELECT count(*) FROM benchmark) / df), 6) DESC, token) <= 10""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.recall import tfidf_keywords

    return tfidf_keywords(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), 10)


@query()
def column_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.recall import recall_columns

    return recall_columns(spark.createDataFrame([("issues by business line", 0), ("severity", 1)], "keyword string, pos int"), STAR.frames(spark)["columns"])


@query()
def value_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.recall import recall_values

    return recall_values(spark.createDataFrame([("building machinery", 0)], "keyword string, pos int"), C.distinct_values(read(spark, sf_dir, "customer"), "customer", "c_mktsegment"))


# Answers from channels: user turns stand for document hits, assistant turns for graph records, system turns for SQL.


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = read(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "qid", "turn": "rank"})
    hits = turns.where("role = 'user'").select("qid", "rank", "text", F.when(F.col("rank") % 2 == 0, "").otherwise(F.col("text")).alias("parent_text"), F.col("role").alias("doc_name"), F.col("rank").alias("page_number"))
    return hits, turns.where("role = 'assistant'").select("qid", "rank", F.to_json(F.struct("text")).alias("record")), turns.where("role = 'system'").groupBy("qid").agg(F.min("text").alias("answer"))


_page("evidence_parts", """WITH d AS (SELECT conv_id AS qid, string_agg('[Source: user' || CASE WHEN turn > 0 THEN ', page ' || turn ELSE '' END || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS d,
 count(*) FILTER (len(text) > 0) AS n, sum(len(left(text, 500))) AS c FROM conversations WHERE role = 'user' GROUP BY 1),
g AS (SELECT conv_id AS qid, '[' || string_agg(CAST(json_object('text', text) AS VARCHAR), ', ' ORDER BY turn) || ']' AS g FROM conversations WHERE role = 'assistant' GROUP BY 1),
s AS (SELECT conv_id AS qid, min(text) AS s FROM conversations WHERE role = 'system' GROUP BY 1 HAVING min(text) <> '')
SELECT qid, concat_ws(chr(10), left(d, 1000), left(g, 1000), left(s, 1000)) AS evidence, len(concat_ws(chr(10) || chr(10), '### Documents' || chr(10) || d, '### Knowledge graph' || chr(10) || g, '### Operational data' || chr(10) || s)) AS n_sources,
 CAST(coalesce(n, 0) + CASE WHEN g IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_chunks, coalesce(c, 0) + coalesce(len(left(g, 2000)), 0) AS n_chunk_chars FROM d FULL JOIN g USING (qid) FULL JOIN s USING (qid)""",
      lambda s, d: W.evidence(*_channels(s, d)).select("qid", "evidence", F.length("sources").cast("long").alias("n_sources"), F.size("chunks").alias("n_chunks"), F.length(F.array_join("chunks", "")).cast("long").alias("n_chunk_chars")))
_page("channel_states", """WITH q AS (SELECT DISTINCT conv_id AS qid FROM conversations), u AS (SELECT conv_id AS qid, role, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT qid, 'doc_rag' AS channel, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status FROM q LEFT JOIN (SELECT * FROM u WHERE role = 'user') USING (qid)
UNION ALL SELECT qid, 'graph_rag', 0, 'failed' FROM q
UNION ALL SELECT qid, 'nl2sql', CASE WHEN n > 0 THEN 1 ELSE 0 END, CASE WHEN n > 0 THEN 'ok' ELSE 'skipped' END FROM q LEFT JOIN (SELECT * FROM u WHERE role = 'system') USING (qid)""",
      lambda s, d: W.channel_status(W.run_channels({"doc_rag": lambda: _channels(s, d)[0], "graph_rag": lambda: s.table("no_such_graph").select("qid"), "nl2sql": lambda: _channels(s, d)[2]}), read(s, d, "conversations").select(F.col("conv_id").alias("qid"))))
_page("composed_answers", "SELECT conv_id AS qid, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS answer FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 10) GROUP BY 1",
      lambda s, d: W.composed(read(s, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), "text")))
_OVERLAP = r"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0.0 END"
_page("triad_scores", r"""WITH t AS (SELECT conv_id AS id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS q, left(coalesce(arg_max(text, turn) FILTER (role = 'assistant'), ''), 2000) AS a,
 count(*) FILTER (role = 'system') AS n, left(coalesce(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) FILTER (role = 'system'), ''), 3000) AS c FROM conversations GROUP BY 1),
k AS (SELECT id, n, list_distinct(regexp_extract_all(lower(q), '[\p{L}\p{N}]+')) AS q, list_distinct(regexp_extract_all(lower(a), '[\p{L}\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(c), '[\p{L}\p{N}]+')) AS c FROM t)
SELECT id, """ + _OVERLAP.format(a="q", b="a") + " AS answer_relevance, CASE WHEN n = 0 THEN 0.0 ELSE " + _OVERLAP.format(a="q", b="c") + " END AS context_relevance, CASE WHEN n = 0 THEN 0.0 ELSE " + _OVERLAP.format(a="a", b="c") + " END AS groundedness, n = 0 AS grounded_skipped FROM k",
      lambda s, d: W.triad(_logged(s, d)).select("id", "answer_relevance", "context_relevance", "groundedness", "grounded_skipped"))


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda role, c: F.when(F.col("role") == role, F.col(c))
    first = F.coalesce(F.min_by(of("user", "text"), of("user", "turn")), F.lit(""))
    contexts = F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text"))))["text"]
    by = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id"))
    return by.agg(first.alias("question"), F.max_by(of("assistant", "text"), of("assistant", "turn")).alias("answer"), contexts.alias("contexts"))


# Records that services keep.

_page("updated_rows", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'renamed ' || p_partkey ELSE p_name END AS p_name, p_size FROM part WHERE p_brand <> 'Brand#11' UNION ALL SELECT -s_suppkey, NULL, NULL FROM supplier",
      lambda s, d: K.inserted(K.deleted(K.updated(read(s, d, "part").select("p_partkey", "p_name", "p_size"), read(s, d, "part").where("p_size > 25").select("p_partkey", F.concat(F.lit("renamed "), "p_partkey").alias("p_name")), "p_partkey"), read(s, d, "part").where("p_brand = 'Brand#11'"), "p_partkey"), read(s, d, "supplier").select((-F.col("s_suppkey")).alias("p_partkey"))))
_page("score_records", "SELECT doc_id, left(text, 500) AS question, left(text, 2000) AS summary, source, CAST(NULL AS VARCHAR) AS eval_type FROM documents",
      lambda s, d: K.evolved(K.score_records(read(s, d, "documents").select("doc_id", F.col("text").alias("question"), F.col("text").alias("summary"), "source")), {"source": "int", "eval_type": "string"}))
_page("feedback_records", "SELECT event_id, nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS comment, value FROM events",
      lambda s, d: K.feedback_records(read(s, d, "events").select("event_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("comment"), "value")))
_page("marked_read", "SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) OR lang = 'en' AS is_read FROM documents",
      lambda s, d: K.marked_read(read(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("is_read")), read(s, d, "labels").select(F.col("doc_id").alias("id"))))
_page("audit_records", "SELECT doc_id, left(text, 80) AS question, source FROM documents", lambda s, d: K.audit_records(read(s, d, "documents").select("doc_id", F.col("text").alias("question"), "source")))
_page("kept_history", """SELECT user_id, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events)
WHERE nth <= 10 AND last > (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
      lambda s, d: K.kept_history(read(s, d, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts", seconds=86400).select("user_id", "event_id"))


@query("""WITH o AS (SELECT p_partkey AS k, p_brand AS b FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_partkey AS k, p_brand AS b FROM part WHERE p_partkey % 11 <> 0)
SELECT metric, column_id FROM (SELECT 'm' || l_partkey AS metric, 'c' || l_suppkey AS column_id FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) l
WHERE metric IN (SELECT 'm' || k FROM n) AND column_id IN (SELECT 'c' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)""")
def catalog_links_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a catalog after a build that drops some metrics and columns: those of dropped ones are gone."""
    metrics = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("m"), "p_partkey").alias("name"), "p_brand")
    columns = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("c"), "s_suppkey").alias("id"), "s_name")
    links = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), "l_partkey").alias("metric"), F.concat(F.lit("c"), "l_suppkey").alias("column_id")).distinct()
    old = {"metrics": metrics.where("k % 7 <> 0"), "columns": columns, "links": links.limit(0)}
    new = {"metrics": metrics.where("k % 11 <> 0"), "columns": columns.where("k % 3 <> 0"), "links": links}
    return C.applied(old, new, {"metrics": ["name"], "columns": ["id"]}, {"metrics": ["p_brand"], "columns": ["s_name"]})[0]["links"]


@query("""SELECT start, count(*) AS increase FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events WHERE event_type = 'error') GROUP BY 1 HAVING count(*) > 3""")
def failures_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.increase(_events(spark, sf_dir), F.col("event_type") == "error", "2 hours", "1 hour").where("increase > 3")

_page("soft_deleted", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'deleted' ELSE 'ready' END AS status FROM documents",
      lambda s, d: etl.soft_deleted(read(s, d, "documents").select("doc_id", F.lit("ready").alias("status")), read(s, d, "labels").where("toxic = 1")))
_page("registered_documents", """SELECT substring(md5('d' || p_partkey), 1, 16) AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'queued' ELSE 'ready' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'd' || p_partkey END AS doc_name FROM part""",
      lambda s, d: etl.registered(read(s, d, "part").select(X.doc_id(F.concat(F.lit("d"), "p_partkey")).alias("doc_id"), F.lit("ready").alias("status")),
                                  read(s, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("d"), "p_partkey").alias("doc_name"))).select("doc_id", "status", "doc_name"))


from quarry.plans import stored_queries  # noqa: E402, F401  registers its queries too
