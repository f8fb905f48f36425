"""From a question to the part of the catalog it is about: keywords, recalled columns, metrics and values, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.etl import hashed_embedding
from quarry.operators.retrieval import bm25_search, dense_search
from quarry.sources.catalog import KEY_ROLES, Catalog, embedding_text

# Words that say nothing about a question's subject.
STOP_WORDS = ("a", "an", "and", "are", "by", "does", "each", "for", "has", "have", "how", "in", "is", "last", "many", "of", "over", "per", "show", "the", "there", "to", "what", "which", "with")


def tfidf_keywords(texts: DataFrame, n: int = 10) -> DataFrame:
    """(id, token, weight): the n tokens of each text (id, text) with the largest tf * ln(N / df), ties by token."""
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    tf = texts.select("id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, "token").crossJoin(F.broadcast(total)).select("id", "token", F.round(F.col("tf") * F.log(F.col("total") / F.col("df")), 6).alias("weight"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "token"))
    return weighted.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def question_keywords(question: Column) -> Column:
    """The whole question first, then its distinct words without stop words."""
    words = F.filter(tokens(question), lambda t: ~t.isin(*STOP_WORDS))
    return F.array_distinct(F.concat(F.array(question), words))


def keyword_union(*lists: Column) -> Column:
    """The keywords of several lists, each once, in order of first sight."""
    return F.array_distinct(F.filter(F.concat(*lists), lambda w: w.isNotNull() & (w != "")))


def extracted_keywords(texts: DataFrame, n: int = 10) -> DataFrame:
    """(id, keywords) of questions (id, text): the question itself first, then its n tokens of the largest weight."""
    listed = tfidf_keywords(texts, n).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "token")))["token"].alias("ts"))
    none = F.array().cast("array<string>")
    return texts.join(listed, "id", "left").select("id", keyword_union(F.array("text"), F.coalesce("ts", none)).alias("keywords"))


def _recalled(keywords: DataFrame, items: DataFrame, k: int, least: float) -> DataFrame:
    """For each item the best place and score among the keywords that recall it among their k nearest."""
    asked = keywords.select(F.col("pos").alias("qid"), hashed_embedding(F.col("keyword")).alias("qvector"))
    near = dense_search(items.select("id", hashed_embedding(F.col("text")).alias("vector")), asked, k).where(F.col("score") >= least)
    return near.groupBy("id").agg(F.min_by("score", "qid").alias("score"), F.min("qid").alias("pos"))


def recall_columns(keywords: DataFrame, columns: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """(id, score, pos) of the columns that keywords (keyword, pos) recall; the first keyword to recall one counts.

    The hashed embedder gives lower scores than a trained one; `least` fits it.
    """
    return _recalled(keywords, columns.select("id", embedding_text(F.col("name"), F.col("description"), F.col("aliases")).alias("text")), k, least)


def recall_metrics(keywords: DataFrame, metrics: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    return _recalled(keywords, metrics.select(F.col("name").alias("id"), embedding_text(F.col("name"), F.col("description"), F.col("aliases")).alias("text")), k, least)


def recall_values(keywords: DataFrame, values: DataFrame, k: int = 10) -> DataFrame:
    """(id, score): values that share a word with a keyword, by BM25, each once."""
    corpus = values.select("id", F.col("value").alias("text"))
    ids = corpus.withColumn("_n", F.xxhash64("id"))
    found = bm25_search(ids.select(F.col("_n").alias("id"), "text"), keywords.select(F.col("pos").alias("qid"), F.col("keyword").alias("qtext")), k)
    best = found.groupBy(F.col("id").alias("_n")).agg(F.max("score").alias("score"))
    return best.join(ids, "_n").select("id", "score")


def merged_info(catalog: Catalog, columns: list[str], metrics: list[str], values: list[tuple[str, str]]) -> tuple[dict[str, list[str]], dict[str, list[str]], list[str]]:
    """(columns by table, example values by column, metrics) to plan with.

    Tables come from the recalled columns, the metrics' relevant columns and the values; all their keys are kept.
    Nothing recalled means all tables; no metric means all metrics.
    """
    chosen = [m for m in catalog.metrics if m.name in metrics] or list(catalog.metrics)
    wanted = dict.fromkeys([*columns, *(c for m in chosen if m.name in metrics for c in m.relevant_columns), *(c for c, _ in values)])
    tables = dict.fromkeys(c.partition(".")[0] for c in wanted) or {t.name: None for t in catalog.tables}
    by_table = {}
    for name in tables:
        table = catalog.table(name)
        own = [c.name for c in table.columns if f"{name}.{c.name}" in wanted or c.role in KEY_ROLES or not wanted]
        by_table[name] = own
    examples: dict[str, list[str]] = {}
    for column, value in values:
        if value not in examples.setdefault(column, []):
            examples[column].append(value)
    return by_table, examples, [m.name for m in chosen]


def pruned(catalog: Catalog, by_table: dict[str, list[str]], selection: object) -> dict[str, list[str]]:
    """by_table as far as selection (table -> columns) names it, keys kept; an invalid selection keeps all."""
    if not isinstance(selection, dict) or not selection:
        return by_table
    out = {}
    for name, own in by_table.items():
        keys = catalog.table(name).key_columns()
        if name in selection and (kept := [c for c in own if c in selection[name] or c in keys]):
            out[name] = kept
    return out or by_table


def pruned_metrics(metrics: list[str], selection: object) -> list[str]:
    """The metrics that a selection (a list of names) keeps; an invalid or empty selection keeps all."""
    if not isinstance(selection, list) or not selection:
        return metrics
    return [m for m in metrics if m in selection]


def prompt_context(catalog: Catalog, by_table: dict[str, list[str]], examples: dict[str, list[str]], metrics: list[str], most: int = 5) -> str:
    """The part of the catalog a planner is told: tables, their columns with up to `most` example values, metrics."""
    lines = []
    for name, columns in by_table.items():
        table = catalog.table(name)
        lines.append(f"table {name}: {table.description}")
        for c in table.columns:
            if c.name in columns:
                shown = [*examples.get(f"{name}.{c.name}", []), *c.examples][:most]
                lines.append(f"  {c.name} {c.type} {c.role}" + (f" -> {c.ref_table}.{c.ref_column}" if c.ref_table else "") + (f" e.g. {', '.join(shown)}" if shown else ""))
    return "\n".join([*lines, *(f"metric {m.name} = {m.expression} of {m.table_name}" for m in catalog.metrics if m.name in metrics)])
