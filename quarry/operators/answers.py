"""From what channels found to an answer and its scores: status, evidence, composition, dispatch, the triad.

Channels give DataFrames: document hits (qid, rank, text, parent_text, doc_name, page_number), graph records (qid, rank,
record) with JSON records, and SQL answers (qid, answer).
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import score_in, tokens
from quarry.sources.store import fresh_folder
from quarry.streaming.limits import with_retry

from .retrieval import overlap_score, parent_context

# Characters of evidence for each channel, of a chunk and of a graph that go to evaluation.
EVIDENCE_MAX, CHUNK_MAX, GRAPH_MAX = 1000, 500, 2000
# Characters of an answer and of the joined contexts that are judged; contexts of a composed answer.
ANSWER_MAX, CONTEXTS_MAX, CONTEXTS = 2000, 3000, 10
# What a question is about if rewriting it fails, and the filter of a channel.
DEFAULT_INTENT = "knowledge_qa"
CHANNEL_FILTERS: Mapping[str, Mapping[str, object]] = {"doc_rag": {}, "change_review": {"doc_type": "spec_doc"}}

Channel = Callable[[], DataFrame]


def run_channels(channels: Mapping[str, Channel], attempts: int = 1, timeout: float | None = None, sleep: Callable[[float], None] = time.sleep) -> dict[str, DataFrame | None]:
    """What each channel gives, as written tables; None for one that fails, which leaves the others as they are.

    Channels run at the same time. A channel's result is written where it is asked for, so what goes wrong in its jobs
    is seen as well as what goes wrong while it is planned. A channel is tried `attempts` times with growing pauses; one
    that takes longer than `timeout` seconds in all has its jobs cancelled.
    """
    sc = SparkContext.getOrCreate()

    def one(channel: Channel) -> DataFrame | None:
        tag = f"channel-{uuid.uuid4().hex}"
        sc.addJobTag(tag)
        late = threading.Event()
        timer = threading.Timer(timeout, lambda: (late.set(), sc.cancelJobsWithTag(tag))) if timeout else None
        if timer:
            timer.start()

        def written() -> DataFrame:
            if late.is_set():
                raise TimeoutError
            df = channel()
            path = fresh_folder(df.sparkSession, "channel")
            df.write.parquet(path)
            return df.sparkSession.read.schema(df.schema).parquet(path)

        try:
            return with_retry(written, attempts, sleep=sleep)  # type: ignore[return-value]
        except Exception:  # noqa: BLE001  whatever a channel fails of, its status says so
            return None
        finally:
            if timer:
                timer.cancel()
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(max(1, len(channels))) as pool:
        running = {name: pool.submit(one, channel) for name, channel in channels.items()}
        return {name: r.result() for name, r in running.items()}


def channel_status(found: Mapping[str, DataFrame | None], queries: DataFrame, texts: tuple[str, ...] = ("nl2sql",)) -> DataFrame:
    """(qid, channel, n, status) for each query and channel: failed, ok, or empty; for channels that give one text
    (qid, answer), a missing or empty one is skipped."""
    rows = []
    for name, df in found.items():
        asked = queries.select("qid").distinct().withColumn("channel", F.lit(name))
        if df is None:
            rows.append(asked.withColumns({"n": F.lit(0).cast("long"), "status": F.lit("failed")}))
            continue
        given = df.where("answer <> ''").select("qid").distinct() if name in texts else df
        counts = given.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        none = "skipped" if name in texts else "empty"
        n = F.coalesce("n", F.lit(0).cast("long"))
        rows.append(asked.join(counts, "qid", "left").select("qid", "channel", n.alias("n"), F.when(n > 0, "ok").otherwise(none).alias("status")))
    return reduce(DataFrame.unionByName, rows)


def evidence(documents: DataFrame, graph: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, sources, evidence, chunks): all that was found under headings; the start of each channel's part; and the
    texts to evaluate against, document hits (parent text or own) in order of rank and then the graph."""
    context = parent_context(documents).withColumnRenamed("context", "d")
    body = F.coalesce(F.nullif("parent_text", F.lit("")), F.col("text"))
    hits = documents.where(F.length(body) > 0).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.left(body, F.lit(CHUNK_MAX)).alias("t")))).alias("c"))
    records = graph.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "record"))).alias("r"))
    records = records.select("qid", F.concat(F.lit("["), F.array_join("r.record", ", "), F.lit("]")).alias("g"))
    said = answers.where("answer <> ''").groupBy("qid").agg(F.min("answer").alias("s"))
    all_ = context.join(hits, "qid", "full_outer").join(records, "qid", "full_outer").join(said, "qid", "full_outer")
    headed = [F.concat(F.lit(f"### {title}\n"), F.col(c)) for title, c in (("Documents", "d"), ("Knowledge graph", "g"), ("Operational data", "s"))]
    start = [F.left(c, F.lit(EVIDENCE_MAX)) for c in ("d", "g", "s")]
    graph_chunk = F.when(F.col("g").isNotNull(), F.array(F.left("g", F.lit(GRAPH_MAX)))).otherwise(F.array().cast("array<string>"))
    chunks = F.concat(F.coalesce(F.col("c.t"), F.array().cast("array<string>")), graph_chunk)
    return all_.select("qid", F.concat_ws("\n\n", *headed).alias("sources"), F.concat_ws("\n", *start).alias("evidence"), chunks.alias("chunks"))


def composed(contexts: DataFrame, n: int = CONTEXTS) -> DataFrame:
    """(qid, answer): the extractive default for a generator, the first n contexts (qid, rank, text) joined."""
    first = contexts.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "text"))), 1, n).alias("c"))
    return first.select("qid", F.array_join("c.text", "\n\n").alias("answer"))


def dispatched(channel: str, search: Callable[[Mapping[str, object]], DataFrame], graph: Channel) -> list[DataFrame]:
    """The retrievals that a channel asks for: documents under its filter, the graph, or both."""
    if channel == "graph_rag":
        return [graph()]
    if channel == "fusion":
        return [search({}), graph()]
    if channel not in CHANNEL_FILTERS:
        raise ValueError(f"unknown channel {channel}")
    return [search(CHANNEL_FILTERS[channel])] + ([graph()] if channel == "change_review" else [])


def rewritten(question: Column, reply: Column) -> Column:
    """(queries, intent) from a rewriter's reply, JSON with or without a fence; without queries the question itself."""
    body = F.regexp_replace(F.regexp_replace(reply, r"(?s)^.*?```(json)?", ""), r"(?s)```.*$", "")
    parsed = F.from_json(body, "queries array<string>, intent string")
    queries = F.when(F.size(parsed["queries"]) > 0, parsed["queries"]).otherwise(F.array(question))
    return F.struct(queries.alias("queries"), F.coalesce(parsed["intent"], F.lit(DEFAULT_INTENT)).alias("intent"))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b holds: the default judge."""
    return overlap_score(a, b)


def triad(log: DataFrame, judge: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """log (id, question, answer, contexts) with answer_relevance, context_relevance and groundedness.

    Answers and joined contexts are judged up to a length. Without contexts groundedness is skipped: 0.0 and
    grounded_skipped.
    """
    answer = F.left(F.coalesce("answer", F.lit("")), F.lit(ANSWER_MAX))
    context = F.left(F.coalesce(F.array_join("contexts", "\n---\n"), F.lit("")), F.lit(CONTEXTS_MAX))
    none = F.coalesce(F.size("contexts") <= 0, F.lit(True))
    return log.withColumns({
        "answer_relevance": judge(F.col("question"), answer),
        "context_relevance": F.when(none, F.lit(0.0)).otherwise(judge(F.col("question"), context)),
        "groundedness": F.when(none, F.lit(0.0)).otherwise(judge(answer, context)), "grounded_skipped": none,
    })


def judged(reply: Column) -> Column:
    """(score, reason) from a judging model's reply, for a judge that asks one."""
    return score_in(reply)


#: Metrics by name, over columns of texts: what an evaluation can be asked to compute.
METRICS: dict[str, Callable[..., Column]] = {"overlap": overlap, "tokens": lambda t: F.size(tokens(t))}


def computed_metrics(rows: DataFrame, wanted: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """rows with the metrics named, each applied to its columns."""
    if unknown := sorted(set(wanted) - set(METRICS)):
        raise ValueError(f"unknown metrics {unknown}")
    return rows.withColumns({name: METRICS[name](*map(F.col, columns)) for name, columns in wanted.items()})
