"""Every registered query with an oracle gives DuckDB's rows; the others run."""

import datetime
import decimal
import math

import pytest

from quarry.plans import queries as q
from tests.conftest import SF


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else str(v)


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted([norm(r[c]) for c in order] for r in df.collect())
    theirs = sorted([norm(r[names.index(c)]) for c in order] for r in cur.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, duck, name):
    compare(q.QUERIES[name](spark, SF), duck, q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_relational_queries_give_all_rows(spark):
    large = SF.replace("sf0.001", "sf0.1")
    n = spark.read.parquet(f"{large}/orders.parquet").count()
    assert n > 100_000 and q.QUERIES["rel_window"](spark, large).count() == n


def test_graph_reads_all_edges(spark, duck):
    large = SF.replace("sf0.001", "sf0.1")
    sql = f"""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM '{large}/lineitem.parquet'), n AS (SELECT dst AS node FROM e WHERE src = 1)
    SELECT src, dst, 'supplies' AS label, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT *, 1 AS hop FROM e WHERE src = 1 UNION ALL SELECT *, 2 FROM e WHERE src IN (FROM n)) GROUP BY 1, 2 ORDER BY hop, src, dst LIMIT 20"""
    compare(q.QUERIES["graph_neighbours"](spark, large), duck, sql)


def test_feedback_map_holds_all_records(spark):
    records = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert q.QUERIES["feedback_map"](spark, SF).select("record_id").distinct().count() == records


def test_hybrid_search_embeds_whole_documents(spark, tmp_path):
    docs = [(1, "zeta pad pad"), (2, "pad " * 2000 + "zeta " * 4000)]  # all of zeta comes after character 6,000
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "zeta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = q.QUERIES["hybrid_reranked"](spark, str(tmp_path)).collect()
    assert {r.id: r["rank"] for r in out} == {2: 1, 1: 2}
