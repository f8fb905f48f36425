"""Channels, retrieval as it is configured, catalogs from files and charts."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import answers as W
from quarry.operators import charts, etl
from quarry.operators import retrieval as R
from quarry.sources import catalog as C

CATALOG = """
tables:
  - name: orders
    role: fact
    columns:
      - {name: o_orderkey, role: primary_key, type: long}
      - {name: o_status, aliases: [status, state], sync: true}
      - {name: o_bare}
  - name: empty
metrics:
  - {name: n, table_name: orders, relevant_columns: [orders.o_orderkey]}
"""


def test_a_channel_that_fails_in_its_job_leaves_the_others(spark):
    slept, calls = [], []

    def flaky():
        calls.append(1)
        return spark.range(2).select("id", F.raise_error(F.lit("first")).cast("string").alias("x")) if len(calls) == 1 else spark.range(2)

    found = W.run_channels(
        {"good": lambda: spark.range(3), "udf": lambda: spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")), "missing": lambda: spark.table("no_such"), "flaky": flaky}, attempts=2, sleep=slept.append,
    )
    assert found["good"].count() == 3 and found["udf"] is None and found["missing"] is None and found["flaky"].count() == 2 and len(calls) == 2 and len(slept) == 3


def test_a_slow_channel_is_cancelled(spark):
    def slow():
        wait = F.udf(lambda x: time.sleep(60) or x, "long")
        return spark.range(1).select(wait("id").alias("id"))

    began = time.time()
    found = W.run_channels({"slow": slow, "good": lambda: spark.range(3)}, timeout=8.0)
    assert found["slow"] is None and found["good"].count() == 3 and time.time() - began < 50


def test_grounding_needs_confidence_and_fails_open(spark):
    rows = ['{"is_grounded": true, "confidence": 0.7}', 'so: {"is_grounded": true, "confidence": 0.69} ...', '{"is_grounded": false, "confidence": 0.9}', "no json", None, '{"is_grounded": true}']
    out = spark.createDataFrame([(r,) for r in rows], "r string").select(R.grounding(F.col("r")).alias("g")).collect()
    assert [(x.g.is_grounded, x.g.confidence) for x in out] == [(True, 0.7), (False, 0.69), (False, 0.9), (True, 1.0), (True, 1.0), (False, 0.0)]
    said = spark.createDataFrame([("a b c", "a b c d"), ("a b c", "a x"), ("", "a")], "a string, c string")
    assert [r[0] for r in said.select(R.grounded(F.col("a"), F.col("c"))).collect()] == [True, False, True]


def test_retrieval_as_it_is_configured(spark):
    corpus = spark.createDataFrame([(1, "red apple pie", [1.0, 0.0]), (2, "green pear", [0.0, 1.0]), (3, "red pear", [0.7, 0.7])], "id long, text string, vector array<double>")
    asked = spark.createDataFrame([(9, "red apple", [0.0, 1.0])], "qid long, qtext string, qvector array<double>")
    ids = lambda **o: [r.id for r in R.retrieve(corpus, asked, **o).orderBy("rank").collect()]
    supposed = lambda q: q.select("qid", F.array(F.lit(1.0), F.lit(0.0)).alias("qvector"))
    assert ids(top=3, hybrid=False, reranked=False) == [2, 3, 1]
    assert ids(top=3, hybrid=False, reranked=False, hyde=supposed)[0] in (1, 3)
    assert ids(top=2, hyde=supposed) == [1, 3] and ids(top=1, filters={"id": [2, 3]}) == [3]
    assert ids(top=2, dynamic=True)[0] == 1
    few = spark.createDataFrame([(1, 5, 1, "q", "x"), (1, 6, 2, "q", "q")], "qid int, id int, rank int, qtext string, text string")
    assert [r.id for r in R.rerank(few, 5).orderBy("rank").collect()] == [5, 6] and [r.id for r in R.rerank(few, 1).orderBy("rank").collect()] == [6]


def test_chunkers_by_strategy(spark):
    docs = spark.createDataFrame([("d", "One sentence here. Another one there.\n\nA second paragraph. " * 20)], "doc_id string, text string")
    for strategy in (*etl.CHUNKERS, None, "unknown"):
        assert etl.chunker(strategy)(docs).count() > 0
    assert etl.chunker("unknown") is etl.chunker(None) is etl.chunked
    assert etl.with_stage(docs, "parse", 5).select("stage", "progress").first() == ("parse", 5)


def test_catalog_from_yaml(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(CATALOG)
    found = C.Catalog.from_file(str(path))
    bare = found.table("orders").columns[2]
    assert (bare.role, bare.type, bare.description, bare.aliases, bare.examples, bare.sync) == ("dimension", "string", "", (), (), False)
    assert found.table("empty").columns == () and found.metric("n").relevant_columns == ("orders.o_orderkey",)
    frames = found.frames(spark)
    assert sorted(r.id for r in C.value_index(frames["columns"]).collect()) == ["orders.o_status.state", "orders.o_status.status"]
    (tmp_path / "empty.yml").write_text("")
    assert C.Catalog.from_file(str(tmp_path / "empty.yml")).tables == ()
    texts = frames["columns"].select(C.embedding_text(F.col("name"), F.col("description"), F.col("aliases")).alias("t")).collect()
    assert "o_status; status, state" in [r.t for r in texts]
    profile = {r.id: (r.n_rows, r.n_values, r.n_distinct) for r in C.profile(found, {"orders": spark.createDataFrame([(1, "a", None), (2, "a", 1)], "o_orderkey int, o_status string, o_bare int")}).collect()}
    assert profile == {"orders.o_orderkey": (2, 2, 2), "orders.o_status": (2, 2, 1), "orders.o_bare": (2, 1, 1)}


def test_collections_are_upserted_and_cleaned(spark):
    index = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    rows = spark.createDataFrame([(2, "new"), (4, "d")], "id int, v string")
    out = C.upserted(index, rows)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "new"), (3, "c"), (4, "d")]
    assert sorted(r.id for r in C.without_stale(out, rows.unionByName(rows)).collect()) == [2, 4]


def test_chart_options(spark):
    rows = [("b", "x", 2.0), ("a", "x", 1.5), ("b", "y", 3.0), ("b", "x", 9.0)]
    df = spark.createDataFrame(rows, "c string, g string, v double").coalesce(1)
    bar = charts.option(df, "bar", "c", "v", by="g")
    assert bar == {"type": "bar", "x": ["b", "a"], "series": [{"name": "x", "data": [2, 1.5]}, {"name": "y", "data": [3, 0]}]}
    heat = charts.option(df, "heatmap", "c", "v", by="g")
    assert heat["x"] == ["b", "a"] and heat["y"] == ["x", "y"] and heat["max"] == 11 and [0, 0, 11] in heat["data"] and isinstance(heat["max"], int)
    assert charts.option(df, "unknown")["type"] == "table" and charts.option(df, "scatter", "v", "v")["data"][0] == [2, 2]
    assert [charts.number(v) for v in ("3.0", "2.5", None, "x", float("nan"))][:4] == [3, 2.5, 0, 0]
    with pytest.raises(ValueError, match="more than 3 rows"):
        charts.option(df, "bar", rows=3)
    odd = spark.createDataFrame([(bytearray(b"hi"), 1)], "b binary, n int")
    assert charts.serializable(odd).first().b == "hi"


def test_urls_without_a_host_go(spark):
    texts = ["x http://...url.../ y", 'see "https://..a/b" now', "keep http://a..b/c", "line\nhttp://..x z", "http://..a and http://..ab", None]
    df = spark.createDataFrame([(t, []) for t in texts], "t string, v array<string>")
    assert [r[0] for r in df.select(X.sanitized_images(F.col("t"), F.col("v"))).collect()] == ["x y", 'see "" now', "keep http://a..b/c", "line\n z", " and", None]


def test_small_functions(spark):
    r = spark.range(1).select(X.score_text(F.lit(0.456)).alias("s"), X.ellipsis(F.lit("x" * 101)).alias("e"), F.length(X.trace_id()).alias("n"), X.client_key(F.lit(""), F.lit("h")).alias("k")).first()
    assert (r.s, r.e, r.n, r.k) == ("0.46", "x" * 100 + "...", 12, "h")
    share = spark.range(20_000).where(X.sampled(F.col("id"), 0.1)).count() / 20_000
    assert 0.08 < share < 0.12
