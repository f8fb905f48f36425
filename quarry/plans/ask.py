"""Question to answer: a rule planner over the catalog's aliases, the guard, and the pieces of an answer.

A model can take the planner's place: anything that maps a question and an error to SQL goes into `guard.run_query`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import charts
from quarry.sources.catalog import Catalog

from . import guard
from .semantic import QuerySpec, compile_spec

SUMMARY_ROWS, HISTORY = 20, 10
_SPANS = {"day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER", "year": "YEAR"}


@dataclass(frozen=True)
class Answer:
    question: str
    sql: str
    rows: DataFrame | None
    chart: str
    error: str | None = None


def _named(text: str, names: dict[str, str]) -> str | None:
    """What the longest name in a text stands for."""
    hits = [n for n in names if re.search(rf"\b{re.escape(n)}\b", text)]
    return names[max(hits, key=len)] if hits else None


def plan(question: str, catalog: Catalog) -> QuerySpec:
    """A specification from a question's words: a metric, `by` or `per` a column, the last so many months, a trend.

    ValueError if no metric is named.
    """
    text = " ".join(re.findall(r"[\w-]+", question.lower()))
    metric = _named(text, {a: m.name for m in catalog.metrics for a in (*m.aliases, m.name.replace("_", " "))})
    if metric is None:
        raise ValueError("the question names no metric")
    m = catalog.metric(metric)
    table = catalog.table(m.table_name)
    own = {c.name for c in table.columns}
    columns: dict[str, str] = {}
    for name, c in sorted(catalog.all_columns(), key=lambda x: x[1].name in own):
        columns |= {a: f"{name}.{c.name}" for a in (*c.aliases, c.name)}
    spec = QuerySpec(m.table_name, metric)
    if by := re.search(r"\b(?:by|per|each)\b(.*)", text):
        if dim := _named(by[1], columns):
            spec = replace(spec, dims=(dim,), order=(f"{metric} DESC",))
    date = next((f"{table.name}.{c.name}" for c in table.columns if c.role == "date"), None)
    if date and (last := re.search(r"\blast (?:(\d+) )?(day|week|month|quarter|year)s?\b", text)):
        spec = replace(spec, since=(date, f"{last[1] or 1} {_SPANS[last[2]]}"))
    if date and (trend := re.search(r"\b(daily|weekly|monthly|quarterly|yearly)\b", text)):
        grain = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}[trend[1]]
        spec = replace(spec, dims=((date, grain), *spec.dims), order=(grain,))
    return replace(spec, share=True) if re.search(r"\b(share|distribution|proportion)\b", text) else spec


def ask(spark: SparkSession, question: str, catalog: Catalog, context: guard.SessionContext) -> Answer:
    """The answer to a question under a caller's rights; views of the tables are registered before. Nothing runs yet,
    but for a count of categories where a chart depends on it."""
    try:
        sql = compile_spec(catalog, plan(question, catalog))
    except ValueError as e:
        return Answer(question, "", None, "table", str(e))
    rows, error = guard.run_query(spark, lambda _: sql, context)
    return Answer(question, sql, rows, charts.recommend(rows) if rows is not None else "table", error)


def summary(rows: DataFrame) -> str:
    """The first rows as text."""
    shown = charts.serializable(rows).limit(SUMMARY_ROWS).collect()
    lines = ["; ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in shown]
    return "\n".join(lines) if lines else "no rows"


class Conversation:
    """The last answers of a session; a follow-up narrows the last one's rows."""

    def __init__(self):
        self.answers: list[Answer] = []

    def add(self, answer: Answer) -> None:
        self.answers = [*self.answers, answer][-HISTORY:]

    def drill(self, condition: str) -> DataFrame | None:
        return self.answers[-1].rows.where(condition) if self.answers and self.answers[-1].rows is not None else None
