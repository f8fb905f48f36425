import base64
import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import etl
from quarry.plans import ask, guard
from quarry.sources.star import STAR, read
from tests.conftest import SF


@pytest.fixture
def views(spark):
    guard.register_views(spark, {t.name: read(spark, SF, t.name) for t in STAR.tables}, guard.SessionContext("admin"), guard.Policy())


@pytest.mark.parametrize(("question", "has", "n"), [
    ("How many issues are there?", "COUNT(*) AS issue_count FROM orders", 1), ("Issues by business line", "GROUP BY customer.c_mktsegment", 5),
    ("Number of issues per responsible domain", "nation.n_name", None), ("Monthly trend of change requests in the last 3 months", "INTERVAL 3 MONTH", None),
    ("Distribution of change requests by change status", "OVER () AS share", 2), ("Config items by category", "GROUP BY nation.n_name", None),
])
def test_questions(spark, views, question, has, n):
    a = ask.ask(spark, question, STAR, guard.SessionContext("admin"))
    assert a.error is None and has in a.sql
    rows = a.rows.collect()
    assert rows and (n is None or len(rows) == n) and ask.summary(a.rows)


def test_no_metric_and_no_right(spark, views):
    assert ask.ask(spark, "What is the weather?", STAR, guard.SessionContext("admin")).error
    assert ask.ask(spark, "How many issues?", STAR, guard.SessionContext("customer")).rows is None


def test_follow_up(spark, views):
    c = ask.Conversation()
    assert c.drill("true") is None
    c.add(ask.ask(spark, "Issues by business line", STAR, guard.SessionContext("admin")))
    assert c.drill("c_mktsegment = 'BUILDING'").count() == 1
    for _ in range(20):
        c.add(c.answers[-1])
    assert len(c.answers) == ask.HISTORY


def test_content_lists(spark):
    good = json.dumps([{"type": "table", "page_idx": 1, "bbox": [0, 5, 1, 1], "table_body": "<table></table>"}, {"type": "equation", "text": "$$x$$"}, {"type": "text", "text": "no"}])
    rows = etl.parsed_blocks(spark.createDataFrame([(1, good), (2, "broken"), (3, None)], "doc_id int, raw string")).collect()
    assert sorted((r.doc_id, r.kind, r.page_idx, r.y) for r in rows) == [(1, "equation", 0, 0.0), (1, "table", 1, 5.0)]


def test_parsers_fall_back(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a text that is long enough")
    (tmp_path / "b.txt").write_text("short")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    out = {r.path[-5:]: r.text for r in etl.parse_files(files, fallback=lambda data: "fallback").collect()}
    assert out == {"a.txt": "a text that is long enough", "b.txt": "fallback"}


def test_decoding_and_names(spark):
    data = base64.b64encode(b"img").decode()
    df = spark.createDataFrame([(data,), (f"data:image/png;base64,{data}",)], "d string")
    assert [bytes(r[0]) for r in df.select(X.decoded_image(F.col("d"))).collect()] == [b"img", b"img"]
    docs = etl.ingest_records(spark.createDataFrame([("a.PNG",)], "doc_name string")).first()
    assert docs.content_type == "image/png" and len(docs.doc_id) == 16 and docs.status == "queued"
    keys = spark.createDataFrame([("u", "h"), ("", "h"), (None, None)], "u string, h string").select(X.client_key(F.col("u"), F.col("h"))).collect()
    assert [r[0] for r in keys] == ["u", "h", "anon"]
