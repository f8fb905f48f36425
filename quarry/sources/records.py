"""Rows that services keep: inserts, updates and deletes as new states of a table, and the records they write.

Each function gives the next state of a table; writing it is the caller's `write`, to a folder of its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Lengths at which stored fields are cut; turns and seconds that a conversation is kept.
SCORE_LIMITS = {"question": 500, "sql": 2000, "summary": 2000, "error": 500, "reason": 500}
AUDIT_MAX, KEPT_TURNS, KEPT_SECONDS = 80, 10, 1800


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table and rows; columns that one lacks are null there."""
    return table.unionByName(rows, allowMissingColumns=True)


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the values of changes (key and some columns, a row for each key) where its key is among them."""
    new = [c for c in changes.columns if c != key]
    told = changes.select(key, F.struct(*new).alias("_new"))
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
    return table.join(told, key, "left").select(*map(value, table.columns))


def deleted(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def evolved(table: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """table with the columns (name to type) it lacks, null; those it has stay as they are."""
    have = {c.lower() for c in table.columns}
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c.lower() not in have}) if any(c.lower() not in have for c in columns) else table


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table in a folder, or an empty one of the schema where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def cut(rows: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    return rows.withColumns({c: F.left(c, F.lit(n)) for c, n in limits.items() if c in rows.columns})


def score_records(scores: DataFrame) -> DataFrame:
    """Scores as they are stored: long fields cut."""
    return cut(scores, SCORE_LIMITS)


def feedback_records(feedback: DataFrame) -> DataFrame:
    """Feedback as it is stored: empty texts are null."""
    return feedback.select(*[F.nullif(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in feedback.dtypes])


def notifications(updates: DataFrame) -> DataFrame:
    """An unread notification for each update (doc_name, doc_type, category, action)."""
    return updates.select("doc_name", "doc_type", "category", "action", F.lit(False).alias("is_read"))


def marked_read(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Notifications (id, is_read, ...) with those of ids (id) read."""
    told = ids.select("id").distinct().withColumn("_read", F.lit(True))
    return rows.join(told, "id", "left").withColumn("is_read", F.coalesce("_read", "is_read")).select(*rows.columns)


def audit_records(log: DataFrame) -> DataFrame:
    return cut(log, {"question": AUDIT_MAX, "answer": AUDIT_MAX})


def kept_history(turns: DataFrame, key: str, order: str, ts: str, now: Column | None = None, most: int = KEPT_TURNS, seconds: int = KEPT_SECONDS) -> DataFrame:
    """What a store with a time to live holds: each key's last `most` turns, if the last one is younger than `seconds` at
    `now`; without `now`, at the last turn of all keys. A key that has run out has no rows."""
    by = Window.partitionBy(key)
    rows = turns.withColumns({"_nth": F.row_number().over(by.orderBy(F.desc(order))), "_last": F.max(ts).over(by)}).where(F.col("_nth") <= most)
    if now is None:
        rows = rows.crossJoin(F.broadcast(turns.agg(F.max(ts).alias("_now"))))  # one row
    limit = F.make_dt_interval(secs=F.lit(seconds))
    return rows.where(F.col("_last") > (F.col("_now") if now is None else now) - limit).select(*turns.columns)


def history(store: DataFrame, key: str, value: str, wanted: str) -> list[dict]:
    """The JSON list kept under a key; an empty one if there is none or it does not parse."""
    row = store.where(F.col(key) == wanted).select(F.from_json(value, "array<map<string,string>>").alias("v")).limit(1).first()
    return [dict(x) for x in row["v"]] if row and row["v"] else []


def report(rows: DataFrame) -> DataFrame:
    """Each row as one line of JSON, nested values included: what an evaluation writes with `write.text`."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
