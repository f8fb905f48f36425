import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming import alerts, ingest, limits

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_limiter_counts_accepted_hits_only(spark):
    rows = [("a", i, at(t)) for i, t in enumerate([0, 1, 2, 3, 10, 10.5, 70])] + [("b", 9, at(3))]
    out = {r.id: r.allowed for r in limits.limited(spark.createDataFrame(rows, "key string, id int, ts timestamp"), "key", 3, 10.0).collect()}
    assert out == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 9: True}


def test_limiter_of_nothing(spark):
    assert limits.limited(spark.createDataFrame([], "key string, id int, ts timestamp"), "key").count() == 0


def test_breaker():
    b = limits.Breaker(2, 10)
    assert [b.record(False, 0), b.record(False, 1), b.record(True, 2)] == ["failed", "failed", "rejected"]
    assert b.state(11) == "half_open" and b.record(False, 11) == "failed" and b.state(12) == "open"
    assert b.record(True, 21) == "ok" and b.state(21) == "closed" and b.failures == 0
    c = limits.Breaker(2)
    c.record(False, 0), c.record(True, 1), c.record(False, 2)
    assert c.state(2) == "closed"


def test_replays_carry_state_over_batches(spark):
    """A busy key's log passes in small batches and no operator gathers a key."""
    rng = random.Random(0)
    rows = [(rng.choice(["busy", "busy", "busy", "quiet", None]), i, at(i + rng.random()), rng.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame(rows, "target string, id int, ts timestamp, ok boolean").repartition(5)
    expected, hits, breakers, held = {}, {}, {}, {}
    for k, i, t, ok in rows:
        b, s = breakers.setdefault(k, limits.Breaker(3, 20.0)), (t - T0).total_seconds()
        expected[i] = (b.record(ok, s), b.state(s))
        held[k] = [x for x in held.get(k, []) if x > s - 10.0]
        hits[i] = len(held[k]) < 3
        held[k] += [s] * hits[i]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        log, allowed = limits.breaker_log(df, "target", 3, 20.0), limits.limited(df, "target", 3, 10.0)
        assert {r.id: (r.outcome, r.state) for r in log.collect()} == expected
        assert {r.id: r.allowed for r in allowed.collect()} == hits
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for out in (log, allowed):
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_retry():
    calls, slept = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert limits.with_retry(call, 3, sleep=slept.append, rand=lambda: 0.5) == "ok" and slept == [0.5, 1.0]
    with pytest.raises(KeyError):
        limits.with_retry(lambda: {}["x"], 2, retry_on=(ValueError,), sleep=slept.append)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, at(60 * i), "error" if i % 3 == 0 else "ok") for i in range(50)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string")
    df.write.parquet(str(tmp_path / "in"))
    stream = alerts.stream_of(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    counts = alerts.counters(stream, "10 minutes", "kind")
    q = counts.writeStream.format("memory").queryName("window_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("window_counts").collect()) == sorted(alerts.counters(df, "10 minutes", "kind").collect())


def test_limiter_stream(spark, tmp_path):
    rows = [("a", i, at(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "key string, id int, ts timestamp").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = limits.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", 3, 10.0)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {r.id: r.allowed for r in spark.table("limited").collect()} == {i: i < 3 for i in range(6)}


def test_ingestion_is_idempotent(spark, tmp_path):
    queue, index = str(tmp_path / "q"), str(tmp_path / "index")
    job = lambda d, t: spark.createDataFrame([(d, t)], "doc_id string, text string")
    for k, (d, t) in enumerate([("d1", "one"), ("d2", "two"), ("d1", "one again")]):
        assert ingest.enqueue(job(d, t), queue)
        ingest.drained(ingest.run(ingest.jobs(spark, queue), lambda df: df.select("doc_id", "text"), index, str(tmp_path / "dead"), str(tmp_path / "ck")))
    assert sorted((r.doc_id, r.text) for r in ingest.current(spark, index).collect()) == [("d1", "one again"), ("d2", "two")]


def test_failures_are_set_aside(spark, tmp_path):
    queue, dead = str(tmp_path / "q"), tmp_path / "dead"
    ingest.enqueue(spark.createDataFrame([("d", "x")], "doc_id string, text string"), queue)
    ingest.drained(ingest.run(ingest.jobs(spark, queue), lambda df: df.select(F.raise_error(F.lit("no"))), str(tmp_path / "i"), str(dead), str(tmp_path / "ck"), attempts=1))
    assert spark.read.json(f"{dead}/0").count() == 1


def test_firing(spark):
    rows = [(at(3600 * h), n) for h, n in [(0, 5), (1, 9), (2, 9), (3, 9), (5, 9)]]
    out = alerts.firing(spark.createDataFrame(rows, "start timestamp, n int"), F.col("n") > 8, "1 hour", "3 hours").collect()
    assert [(r.since, r.until) for r in out] == [(at(3600), at(4 * 3600))]


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(T0, 100, [0, 50, 100] + [100] * 8)], "start timestamp, total long, counts array<long>")
    assert abs(alerts.histogram_quantile(df, 0.75).first().value - (0.1 + 0.15 * 0.5)) < 1e-12


def test_increase_slides(spark):
    rows = [(at(600 * i), "bad" if i % 2 else "ok") for i in range(12)]
    out = alerts.increase(spark.createDataFrame(rows, "ts timestamp, kind string"), F.col("kind") == "bad", "1 hour", "30 minutes").collect()
    want = {}
    for t, kind in rows:
        for s in range(-3600, 7200, 1800):
            if kind == "bad" and at(s) <= t < at(s + 3600):
                want[at(s)] = want.get(at(s), 0) + 1
    assert {r.start: r.increase for r in out} == want


def test_copies_within_the_watermark_are_dropped(spark, tmp_path):
    rows = [(1, at(0)), (1, at(5)), (2, at(6)), (1, at(60))]
    df = spark.createDataFrame(rows, "id int, ts timestamp").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = alerts.deduplicated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "id")
    stream.writeStream.format("memory").queryName("deduplicated").outputMode("append").trigger(availableNow=True).start().awaitTermination(90)
    assert sorted(r.id for r in spark.table("deduplicated").collect()) == [1, 2]


def test_streams_are_matched(spark, tmp_path):
    asked = spark.createDataFrame([("a", at(0), "q1"), ("b", at(10), "q2")], "key string, ts timestamp, text string")
    told = spark.createDataFrame([("a", at(30), "r1"), ("a", at(400), "late"), ("b", at(5), "before")], "key string, ts timestamp, text string")
    asked.write.parquet(str(tmp_path / "a"))
    told.write.parquet(str(tmp_path / "b"))
    read = lambda n: spark.readStream.schema(asked.schema).parquet(str(tmp_path / n))
    alerts.matched(read("a"), read("b"), "key", "60 seconds").writeStream.format("memory").queryName("matched").outputMode("append").trigger(availableNow=True).start().awaitTermination(90)
    assert [(r.key, r.text, r.other_text) for r in spark.table("matched").collect()] == [("a", "q1", "r1")]
