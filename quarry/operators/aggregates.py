"""Feedback, evaluation and conversation aggregates, and the joins, pages and sequences around them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import round_half_even

PRICE_IN, PRICE_OUT = 0.4e-6, 1.2e-6


def feedback_totals(feedback: DataFrame) -> DataFrame:
    """total, praise (rating 1), negative (-1), neutral and the rates to 3 places, 0 without rows; one pass."""
    counts = feedback.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("rating") == 1).alias("praise"), F.count_if(F.col("rating") == -1).alias("negative"))
    rate = lambda c: round_half_even(F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(0.0)), 3)
    return counts.select("*", (F.col("total") - F.col("praise") - F.col("negative")).alias("neutral"), rate("praise").alias("praise_rate"), rate("negative").alias("negative_rate"))


def last_days(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows within so many days of the last one: a look-back that does not depend on the clock."""
    last = rows.agg(F.max(ts).alias("_last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col(ts) >= F.col("_last") - F.make_interval(days=F.lit(days))).drop("_last")


def channel_stats(feedback: DataFrame) -> DataFrame:
    """Counts and praise by channel; a null or empty channel shows as unknown, after grouping."""
    by = feedback.groupBy("channel").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("rating") == 1, 1).otherwise(0)).alias("praise"))
    return by.select(F.coalesce(F.nullif("channel", F.lit("")), F.lit("unknown")).alias("channel"), "total", "praise", (F.col("praise") / F.col("total")).alias("praise_rate"))


def trace_stats(feedback: DataFrame) -> DataFrame:
    """For each trace its counts, latest comment and first time. feedback: trace, rating, comment, created_at, id."""
    return feedback.groupBy("trace").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("rating") == 1).alias("praise"), F.count_if(F.col("rating") == -1).alias("negative"),
        F.max_by("comment", F.struct("created_at", "id")).alias("latest_comment"), F.min("created_at").alias("first_at"),
    )


def linked_feedback(feedback: DataFrame, trace: str, rating: int, comment: str) -> DataFrame:
    """feedback with the first row of a trace patched: a rating other than 0 replaces, a comment is appended after ` | `."""
    first = feedback.where(F.col("trace") == trace).agg(F.min("id").alias("_first"))  # one row, found by a filter
    hit = (F.col("trace") == trace) & (F.col("id") == F.col("_first"))
    joined = F.concat_ws(" | ", F.nullif("comment", F.lit("")), F.nullif(F.lit(comment), F.lit("")))
    out = feedback.crossJoin(F.broadcast(first))
    out = out.withColumn("rating", F.when(hit & (F.lit(rating) != 0), F.lit(rating)).otherwise(F.col("rating")))
    return out.withColumn("comment", F.when(hit, F.nullif(joined, F.lit(""))).otherwise(F.col("comment"))).drop("_first")


def eval_summary(scores: DataFrame) -> DataFrame:
    """Filtered aggregates over online scores; a null eval_type counts as nl2sql."""
    kind = F.coalesce("eval_type", F.lit("nl2sql"))
    mean = lambda c, t: F.coalesce(F.avg(F.when(kind == t, F.col(c))), F.lit(0.0))
    return scores.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind == "nl2sql").alias("n_nl2sql"), F.count_if(kind == "knowledge").alias("n_knowledge"),
        mean("score_valid", "nl2sql").alias("avg_valid"), mean("score_has_data", "nl2sql").alias("avg_has_data"), mean("score_relevance", "nl2sql").alias("avg_relevance"),
        mean("score_context", "knowledge").alias("avg_context"), mean("score_groundedness", "knowledge").alias("avg_groundedness"), mean("score_answer", "knowledge").alias("avg_answer"),
    )


def metric_board(results: DataFrame, definitions: DataFrame) -> DataFrame:
    """Average and count by metric name, of results that are done."""
    done = results.where(F.col("status") == "done").join(definitions, "definition_id")
    return done.groupBy("name").agg(F.avg("result").alias("average"), F.count(F.lit(1)).alias("n"))


def last_results(results: DataFrame, definitions: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, name, result): the last result (by id) of each metric of the given records."""
    own = results.join(records.select("record_id").distinct(), "record_id", "left_semi").join(definitions, "definition_id")
    return own.groupBy("record_id", "name").agg(F.max_by("result", "id").alias("result"))


def feedback_map(results: DataFrame, definitions: DataFrame, records: DataFrame) -> DataFrame:
    """For each record a map from metric to its last result (by id), rounded to 3 places; null or 0 results are 0."""
    last = last_results(results, definitions, records)
    return last.groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.round(F.coalesce("result", F.lit(0.0)), 3))))).alias("scores"))


def sql_scores(log: DataFrame) -> DataFrame:
    """sql_valid (1 or 0) and has_data (0 on an error, 1 with rows, else a half) of a query log (error, n_rows)."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    return log.withColumns({"sql_valid": F.when(ok, 1.0).otherwise(0.0), "has_data": F.when(~ok, 0.0).when(F.col("n_rows") > 0, 1.0).otherwise(0.5)})


def eval_rollup(scored: DataFrame) -> DataFrame:
    """Valid rate and means of relevance, correctness (mean of the three scores) and latency."""
    correct = (F.col("sql_valid") + F.col("has_data") + F.col("relevance")) / 3
    return scored.agg(F.avg("sql_valid").alias("valid_rate"), F.avg("relevance").alias("avg_relevance"), F.avg(correct).alias("avg_correctness"), F.avg("latency").alias("avg_latency"))


def context_relevance(scores: DataFrame) -> DataFrame:
    """Mean relevance over the contexts of each question. scores: qid, contexts (array of doubles)."""
    return scores.select("qid", F.explode_outer("contexts").alias("s")).groupBy("qid").agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("context_relevance"))


def token_cost(usage: DataFrame, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> DataFrame:
    """Tokens, calls and price by model; null usage is 0."""
    tokens = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    by = usage.groupBy("model").agg(tokens("prompt_tokens").alias("input"), tokens("completion_tokens").alias("output"), F.count(F.lit(1)).alias("calls"))
    return by.withColumn("cost_usd", F.col("input") * price_in + F.col("output") * price_out)


def page(rows: DataFrame, id_col: str, number: int = 1, size: int = 20, keyword: str = "", search: Iterable[str] = ()) -> DataFrame:
    """One page in order of id, with `total` of all that match `%keyword%` in any searched field. Size is 1 to 100."""
    size, number = min(max(size, 1), 100), max(number, 1)
    if keyword and (fields := list(search)):
        match = F.col(fields[0]).like(f"%{keyword}%")
        for f in fields[1:]:
            match = match | F.col(f).like(f"%{keyword}%")
        rows = rows.where(match)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(id_col).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: an aggregate, which combines on the map side where a window would not."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def records_with_apps(records: DataFrame, apps: DataFrame, limit: int) -> DataFrame:
    return records.join(apps, "app_id", "left").orderBy(F.desc("ts"), "record_id").limit(limit)


def merged_scores(online: DataFrame, offline: DataFrame, limit: int) -> DataFrame:
    """Both kinds of scores newest first by their ISO time, cut to limit, with `total` of all."""
    both = online.withColumn("origin", F.lit("online")).unionByName(offline.withColumn("origin", F.lit("offline")), allowMissingColumns=True)
    total = both.agg(F.count(F.lit(1)).alias("total"))
    return both.orderBy(F.desc("created_at"), "origin", "id").limit(limit).crossJoin(F.broadcast(total))


def turn_pairs(turns: DataFrame, cut: int = 500) -> DataFrame:
    """Each user turn with the assistant turn that follows it, the answer cut."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.withColumns({"_role": F.lead("role").over(w), "_text": F.lead("text").over(w)})
    return nxt.where((F.col("role") == "user") & (F.col("_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), F.left("_text", F.lit(cut)).alias("answer"))


def two_facts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two facts by one dimension: each aggregated first, then joined, so that neither multiplies the other."""
    return left.join(right, key, "full_outer").fillna(0)


def distinct_first_seen(rows: DataFrame, column: str, order: Iterable[str]) -> DataFrame:
    """Distinct values with the place of the first row that has each, numbered from 0 by it: a row for each category of a
    chart in one task."""
    first = rows.groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("idx", F.row_number().over(Window.orderBy("_first", column)) - 1).drop("_first")


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "mid").when(score.isNotNull(), "low").otherwise("mid")
