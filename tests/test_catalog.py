"""Catalogs committed to a store, and evaluation over questions."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.plans import evaluate, guard
from quarry.sources import catalog as C
from quarry.sources.star import STAR, read
from quarry.sources.store import Store
from tests.conftest import SF


def told(counts):
    return {(r.table, r.action): r.n for r in counts.collect()}


def test_catalogs_are_committed_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"), 4)
    frames = STAR.frames(spark)
    first = told(C.committed(store, frames))
    assert {a for _, a in first} == {"rebuild"} and first["columns", "rebuild"] == len(STAR.all_columns()) and store.version() == 1
    assert {a for _, a in told(C.committed(store, frames))} == {"keep"}
    # One column changes, a metric goes and its links with it, a table comes; a dry run tells the same and changes nothing.
    new = dict(frames)
    new["columns"] = frames["columns"].withColumn("description", F.when(F.col("id") == "orders.o_custkey", "who").otherwise(F.col("description")))
    new["metrics"] = frames["metrics"].where("name <> 'cr_count'")
    new["tables"] = frames["tables"].unionByName(spark.createDataFrame([("extra", "dim", "")], C.TABLE_SCHEMA))
    at = store.version()
    dry = told(C.committed(store, new, dry_run=True))
    assert store.version() == at and dry["columns", "update"] == 1 and dry["metrics", "delete"] == 1 and dry["tables", "insert"] == 1
    assert told(C.committed(store, new)) == dry and store.version() == at + 1
    for t in C.KEYS:
        want = new[t] if t != "links" else new[t].where("metric <> 'cr_count'")
        assert sorted(map(str, store.read(t).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert store.read("metrics", at).where("name = 'cr_count'").count() == 1  # the version before is whole too


def test_a_stored_catalog_of_another_form_is_rebuilt(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"), 2)
    frames = STAR.frames(spark)
    C.committed(store, frames | {"tables": frames["tables"].withColumn("name", F.xxhash64("name"))} | {"links": frames["links"]})
    assert not C.compatible(store.read("tables"), frames["tables"], ["name"])
    assert {a for _, a in told(C.committed(store, frames))} == {"rebuild"}
    assert C.compatible(store.read("tables"), frames["tables"], ["name"]) and told(C.committed(store, frames, rebuild=True))["tables", "rebuild"] == 7


def test_evaluation_of_questions(spark, tmp_path):
    guard.register_views(spark, {t.name: read(spark, SF, t.name) for t in STAR.tables}, guard.SessionContext("admin"), guard.Policy())
    asked = spark.createDataFrame([(2, "Issues by business line"), (1, "How many issues are there?"), (3, "What is the weather like?"), (4, "Monthly trend of change requests")], "index int, question string")
    out = evaluate.evaluate(spark, asked, STAR, guard.SessionContext("admin"), output=str(tmp_path / "r")).orderBy("index").collect()
    assert [r["index"] for r in out] == [1, 2, 3, 4] and [r.sql_valid for r in out] == [1.0, 1.0, 0.0, 1.0] and [r.has_data for r in out] == [1.0, 1.0, 0.0, 1.0]
    assert out[2].relevance == 0.0 and out[2].error and out[2].correctness == 0.0 and all(r.latency > 0 for r in out)
    assert out[1].correctness == pytest.approx(round((2 + out[1].relevance) / 3, 2)) and out[1].n_rows == 5
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(x["index"] for x in lines) == [1, 2, 3, 4] and "summary" in lines[0]
    assert evaluate.run_questions(spark, asked, STAR, guard.SessionContext("admin"), limit=1).count() == 1
