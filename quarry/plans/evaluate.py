"""Evaluation over a table of questions: each is answered, scored and timed, and the scores are a table to roll up."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.aggregates import sql_scores
from quarry.operators.answers import overlap
from quarry.plans import guard
from quarry.plans.ask import ask, summary
from quarry.sources.catalog import Catalog
from quarry.sources.records import report

RESULT = "index int, question string, sql string, error string, n_rows long, summary string, latency double"


def run_questions(spark: SparkSession, questions: DataFrame, catalog: Catalog, context: guard.SessionContext, limit: int | None = None) -> DataFrame:
    """(index, question, sql, error, n_rows, summary, latency in ms) for questions (index, question), up to `limit` of
    them in order of index. Every question is a query of its own; one that fails has its error."""
    out = []
    asked = questions.select("index", "question").orderBy("index")
    for row in (asked if limit is None else asked.limit(limit)).toLocalIterator():
        began = time.perf_counter()
        sql, error, n, told = "", None, 0, ""
        try:
            answer = ask(spark, row["question"], catalog, context)
            sql, error = answer.sql, answer.error
            if answer.rows is not None:
                n, told = answer.rows.count(), summary(answer.rows)
        except Exception as e:  # noqa: BLE001  a question's failure is its result
            error = str(e)
        out.append((row["index"], row["question"], sql, error or None, n, told, 1000 * (time.perf_counter() - began)))
    return spark.createDataFrame(out, RESULT)


def scored(results: DataFrame, judge: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """results with sql_valid, has_data, relevance and correctness, the mean of the three to two places. Only what ran and
    has something to show is judged; the rest has a relevance of 0."""
    rows = sql_scores(results)
    shown = (F.col("sql_valid") > 0) & (F.coalesce("summary", F.lit("")) != "")
    rows = rows.withColumn("relevance", F.when(shown, F.coalesce(judge(F.col("question"), F.col("summary")), F.lit(0.0))).otherwise(F.lit(0.0)))
    return rows.withColumn("correctness", F.round((F.col("sql_valid") + F.col("has_data") + F.col("relevance")) / 3, 2))


def evaluate(spark: SparkSession, questions: DataFrame, catalog: Catalog, context: guard.SessionContext, limit: int | None = None, output: str | None = None, judge: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """Questions answered and scored; with `output`, written there as lines of JSON too."""
    rows = scored(run_questions(spark, questions, catalog, context, limit), judge)
    if output:
        report(rows).coalesce(1).write.mode("overwrite").text(output)
    return rows
