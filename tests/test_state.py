"""Alerts and conversations as streams with state, sketches, patterns, metrics and crops against plain versions."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import layout, metrics, patterns
from quarry.operators import retrieval as R
from quarry.streaming import alerts, state

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def replay(spark, tmp_path, batches, schema, make, name):
    """Batches as files, one a trigger; the rows that a stream gives."""
    state.configured(spark)
    folder = tmp_path / name
    (folder / "in").mkdir(parents=True)
    import os

    for i, rows in enumerate(batches):
        path = folder / "in" / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps(r, default=str) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    return spark.table(name).collect(), str(folder / "ck")


def test_held_alerts_equal_those_of_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [{"host": h, "ts": at(60 * m + rng.randrange(60))} for h in ("a", "b", "c") for m in range(90) for _ in range(rng.choice([0, 1, 3, 3, 3]))]
    rows.sort(key=lambda r: r["ts"])
    batches = [rows[i : i + 90] for i in range(0, len(rows), 90)] + [[{"host": "z", "ts": at(86400)}], [{"host": "z", "ts": at(2 * 86400)}]]

    def make(stream):
        counts = alerts.stream_of(stream, "5 seconds").groupBy(F.window("ts", "1 minute").alias("w"), "host").agg(F.count(F.lit(1)).alias("n"))
        windows = counts.select(F.col("w.start").alias("start"), "host", (F.col("n") >= 3).alias("holds"), F.window_time("w").alias("ts"))
        return state.firing_stream(windows, dt.timedelta(minutes=1), dt.timedelta(minutes=3), "host")

    out, _ = replay(spark, tmp_path, batches, "host string, ts timestamp", make, "held")
    df = spark.createDataFrame([(r["host"], r["ts"]) for r in rows], "host string, ts timestamp")
    want = {(r.host, r.since, r.until) for r in alerts.firing(alerts.counters(df, "1 minute", "host"), F.col("n") >= 3, "1 minute", "3 minutes", "host").collect()}
    assert want and {(r.host, r.since, r.until) for r in out if r.state == "resolved"} == want
    fired = [(r.host, r.since, r.until) for r in out if r.state == "firing"]
    assert sorted(fired) == sorted((h, s, s + dt.timedelta(minutes=3)) for h, s, _ in want)


def test_conversations_are_kept_for_a_while(spark, tmp_path):
    """Ten turns at most, for half an hour after the last one, out of the state after all batches, against a plain replay."""
    rng = random.Random(7)
    rows, t = [], 0
    for i in range(150):
        t += rng.choice([10, 60, 400, 1799, 2500])
        rows.append({"user": rng.choice("abcd"), "turn": i, "ts": at(t), "text": f"t{i}"})
    rows.append({"user": "z", "turn": 999, "ts": at(t + 900), "text": "last"})
    make = lambda s: state.conversation_stream(alerts.stream_of(s, "0 seconds"), "user")
    out, ck = replay(spark, tmp_path, [rows[i : i + 20] for i in range(0, len(rows), 20)], "user string, turn long, ts timestamp, text string", make, "turns")
    held, last = {}, {}
    for r in rows:
        k = r["user"]
        held[k] = (held.get(k, []) if k in last and (r["ts"] - last[k]).total_seconds() < 1800 else [])[-9:] + [(r["turn"], r["text"])]
        last[k] = r["ts"]
    want = {(k, n, x) for k, v in held.items() if last[k] + dt.timedelta(seconds=1800) > at(t + 900) for n, x in v}
    assert {(r.user, r.turn, r.text) for r in state.kept_turns(spark, ck, "user").collect()} == want
    assert max(r.n for r in out) <= 10 and any(r.n == 0 for r in out)


def test_sketches_merge_within_an_error(spark):
    rng = random.Random(1)
    rows = [(at(rng.randrange(6 * 3600)), rng.choice("ab"), rng.lognormvariate(0, 1)) for _ in range(20_000)] + [(at(5), "a", None)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    out = alerts.sliding_quantiles(alerts.sketches(df, "value", "10 minutes", "kind"), [0.5, 0.95], "2 hours", "1 hour", "kind").collect()
    assert len(out) == 2 * 7
    for r in out:
        values = sorted(v for t, k, v in rows if k == r.kind and v is not None and r.start <= t < r.start + dt.timedelta(hours=2))
        assert r.n == len(values)
        for q, x in zip((0.5, 0.95), r["values"], strict=True):
            assert abs(sum(v <= x for v in values) / len(values) - q) < 0.02


# Patterns


def _graph(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "src int, dst int")
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "id int, name string")
    return patterns.Graph({"knows": edges((1, 2), (2, 1), (2, 3), (3, 4), (1, 2), (None, 3), (4, 4)), "owns": edges((4, 100), (3, 101))}, {"person": nodes})


def test_paths_do_not_repeat_a_node(spark):
    g = _graph(spark)
    step = patterns.Step("knows", "person", times=(1, 3))
    out = patterns.match(g, patterns.Pattern("person", (step, patterns.Step("owns", "thing"))), None)
    assert sorted([x for x in r if x is not None] for r in out.collect()) == [[1, 2, 3, 4, 100], [1, 2, 3, 101], [2, 3, 4, 100], [2, 3, 101], [3, 4, 100]]
    back = patterns.match(g, patterns.Pattern("thing", (patterns.Step("owns", "person", back=True), patterns.Step("knows", "person", back=True))), {-1: F.col("name") == "n2"})
    assert [tuple(r) for r in back.collect()] == [(101, 3, 2)]


@pytest.mark.parametrize("sent", [0, 4 << 20])
def test_edges_are_dealt_by_their_bytes(spark, tmp_path, monkeypatch, sent):
    rng = random.Random(3)
    tables = {"knows": [(rng.randrange(400), rng.randrange(400)) for _ in range(900)] * 3, "owns": [(rng.randrange(400), rng.randrange(50)) for _ in range(200)] * 2}
    for name, rows in tables.items():
        spark.createDataFrame(rows, "src int, dst int").coalesce(1).write.parquet(str(tmp_path / name))
    edges = {name: spark.read.parquet(str(tmp_path / name)) for name in tables}
    nodes = {"person": spark.createDataFrame([(i, f"n{i % 7}") for i in range(400)], "id int, name string")}
    monkeypatch.setattr(patterns, "SENT_BYTES", sent)
    monkeypatch.setattr(patterns, "PART_BYTES", R.read_bytes(edges["knows"]) // 20)
    steps = (patterns.Step("knows", "person"), patterns.Step("knows", "person"), patterns.Step("owns", "thing"))
    out = patterns.match(patterns.Graph(edges, nodes), patterns.Pattern("person", steps), {0: F.col("name") == "n1"})
    knows, owns = set(tables["knows"]), set(tables["owns"])
    want = {(a, b, d, t) for a, b in knows if a % 7 == 1 and b != a for c, d in knows if c == b and d not in (a, b) for p, t in owns if p == d}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) > 20
    if not sent:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)} == {-(-R.read_bytes(edges["knows"]) // patterns.PART_BYTES)}
        scans = [p.split("FileScan")[0].rsplit("Exchange", 1)[-1] for p in plan.split("Batched: ")[:-1]]
        assert scans and not any("HashAggregate" in p for p in scans)  # nothing is made distinct before it is dealt


def test_the_first_pattern_with_an_answer(spark):
    g, p = _graph(spark), lambda label: patterns.Pattern("person", (patterns.Step(label, "thing"),))
    which, rows = patterns.first_answer(g, [(p("unknown"), {}), (p("owns"), {0: F.col("name") == "n9"}), (p("owns"), {})], listed=1)
    assert which == 2 and [tuple(r) for r in rows.collect()] == [(3, 101)]
    assert patterns.first_answer(g, [(p("unknown"), {})] * 3 + [(p("owns"), {})]) is None  # three attempts
    with pytest.raises(ValueError):
        patterns.match(g, patterns.Pattern("person", (patterns.Step("knows", "person", times=(0, 1)),)))


# Metrics


def test_metrics_over_records(spark):
    rows = [(1, '{"question": "red car", "answer": "a red car", "contexts": ["red", "blue car", null, "none"]}'), (2, '{"question": "x", "answer": "y"}'), (3, "no json"), (4, None)]
    df = spark.createDataFrame(rows, "record_id int, record string")
    out = {(r.record_id, r.metric): r.score for r in metrics.evaluated(df, metrics.triad()).collect()}
    assert out[1, "answer_relevance"] == 1.0 and abs(out[1, "context_relevance"] - 1 / 3) < 1e-12 and abs(out[1, "groundedness"] - 2 / 3) < 1e-12
    assert out[2, "answer_relevance"] == 0.0 and out[2, "context_relevance"] is None and len(out) == 12
    most = metrics.Metric("best", lambda a, b: metrics.overlap(a, b), {"a": metrics.Selector("$.question"), "b": metrics.Selector("$.contexts", each=True)}, F.array_max)
    assert metrics.evaluated(df.where("record_id = 1").withColumn("record", F.parse_json("record")), [most]).first().score == 0.5
    valid = spark.createDataFrame([('{"error": "no table"}',), ('{"error": null}',), ("{}",)], "r string").select(metrics.sql_valid(F.col("r")).alias("v"))
    assert [r.v for r in valid.collect()] == [0.0, 1.0, 1.0]
    assert {r.metric: r.n for r in metrics.rollup(metrics.evaluated(df, metrics.triad())).collect()}["context_relevance"] == 1


# Crops


def test_crops_equal_a_plain_version(spark):
    rng = random.Random(3)
    pages = [("d", p, 600.0 + 10 * p, 800.0) for p in range(4)]
    blocks = [(i, "d", rng.randrange(5), rng.choice(["table", "formula", "text"]), [float(rng.randrange(0, 900)) for _ in range(2)]) for i in range(80)]
    blocks = [(i, d, p, k, [*b, b[0] + rng.randrange(200), b[1] + rng.randrange(100)]) for i, d, p, k, b in blocks] + [(90, "d", 0, "table", None), (91, "d", 0, "table", [1.0, None, 2.0, 3.0])]
    texts = [("d", rng.randrange(4), float(x := rng.randrange(600)), float(y := rng.randrange(800)), x + 80.0, y + 30.0) for _ in range(60)]
    want = {}
    for i, _, p, k, b in blocks:
        if k == "text" or p > 3 or b is None or None in b:
            continue
        w, h = pages[p][2:]
        x0, y0, x1, y1 = (v * w / 842.0 for v in b)
        if k == "formula":
            x0, y0, x1, y1 = x0 - 6, y0 - 14, x1 + 20, y1 + 18
        else:
            x1, y1 = x1 + 30, y1 + 60
            met = [t for t in texts if t[1] == p and t[2] < x1 and t[4] > x0 and t[3] < y1 and t[5] > y0]
            x1, y1 = max([x1, *(t[4] for t in met)]), max([y1, *(t[5] for t in met)])
        box = max(x0, 0.0), max(y0, 0.0), min(x1, w), min(y1, h)
        if box[2] - box[0] >= 20 and box[3] - box[1] >= 20:
            want[i] = box
    out = layout.crops(
        spark.createDataFrame(blocks, "block_id int, doc_id string, page int, kind string, bbox array<double>"), spark.createDataFrame(pages, "doc_id string, page int, width double, height double"),
        spark.createDataFrame(texts, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"),
    ).collect()
    assert {r.block_id for r in out} == set(want) and all(abs(a - b) < 1e-9 for r in out for a, b in zip((r.x0, r.y0, r.x1, r.y1), want[r.block_id], strict=True))
