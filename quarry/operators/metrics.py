"""Metrics over records whose shape is known when they are read: selectors are paths into a VARIANT.

A metric is a function over selected values, and how it treats a path to many values: once for each, and the scores
are aggregated, or once for all of them together. Everything is one projection over the records.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import overlap


@dataclass(frozen=True)
class Selector:
    """A path in a record. each: the value is a list, and the metric is computed for every one of its texts; joined: it is
    a list, and the metric gets its texts as one."""

    path: str
    each: bool = False
    joined: str | None = None

    def of(self, record: Column) -> Column:
        if self.each or self.joined is not None:
            texts = F.filter(F.try_variant_get(record, self.path, "array<string>"), lambda t: t.isNotNull())
            return texts if self.each else F.array_join(texts, self.joined)
        return F.try_variant_get(record, self.path, "string")


def mean(scores: Column) -> Column:
    """The mean of an array; null of none."""
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores))


@dataclass(frozen=True)
class Metric:
    name: str
    function: Callable[..., Column]
    selectors: Mapping[str, Selector]
    aggregate: Callable[[Column], Column] = mean

    def of(self, record: Column) -> Column:
        many = [n for n, s in self.selectors.items() if s.each]
        if len(many) > 1:
            raise ValueError(f"{self.name}: one selector goes through a list at most")
        given = {n: s.of(record) for n, s in self.selectors.items() if not s.each}
        if not many:
            return self.function(**given).cast("double")
        values = self.selectors[many[0]].of(record)
        return self.aggregate(F.transform(values, lambda v: self.function(**given, **{many[0]: v}).cast("double")))


def triad(judge: Callable[[Column, Column], Column] = overlap) -> list[Metric]:
    """Answer to question, each context to question, contexts to answer."""
    asked, said = Selector("$.question"), Selector("$.answer")
    return [
        Metric("answer_relevance", lambda prompt, response: judge(prompt, response), {"prompt": asked, "response": said}),
        Metric("context_relevance", lambda question, context: judge(question, context), {"question": asked, "context": Selector("$.contexts", each=True)}),
        Metric("groundedness", lambda source, statement: judge(statement, source), {"source": Selector("$.contexts", joined="\n---\n"), "statement": said}),
    ]


def sql_valid(response: Column) -> Column:
    """1 unless the response, JSON of a query's run, tells an error."""
    error = F.get_json_object(response, "$.error")
    return F.when(F.coalesce(error, F.lit("")) != "", 0.0).otherwise(1.0)


def evaluated(records: DataFrame, metrics: list[Metric], record: str = "record") -> DataFrame:
    """records (record_id, and a JSON text or VARIANT) as (record_id, metric, score), a row for each metric. A text that
    is not JSON has null scores."""
    kind = dict(records.dtypes)[record]
    value = F.col(record) if kind == "variant" else F.try_parse_json(F.col(record))
    parsed = records.select("record_id", value.alias("r"))
    scores = F.array(*[F.struct(F.lit(m.name).alias("metric"), m.of(F.col("r")).alias("score")) for m in metrics])
    return parsed.select("record_id", F.inline(scores))


def rollup(scores: DataFrame) -> DataFrame:
    """(metric, n, mean) over records; null scores do not count."""
    return scores.groupBy("metric").agg(F.count("score").alias("n"), F.avg("score").alias("mean"))
