"""Queue ingestion as a stream: jobs of a bounded queue, an idempotent upsert for each batch, failures set aside, and a
log of every job's stages."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.sources import queue as Q

JOB_SCHEMA = "job_id string, doc_id string, object_name string, doc_name string, doc_type string, category string, business_line string, model_code string, chunk_strategy string, parser string, text string"
# Attempts at a job, the longest pause between two, characters of an error; progress of stages in percent.
ATTEMPTS, LONGEST, ERROR_MAX = 3, 8.0, 2000
PROGRESS = {"parse": 5, "index": 100}


def decoded(payload: Column, kind: str = JOB_SCHEMA) -> Column:
    """A job from its payload, a JSON text or its UTF-8 bytes; null if it is none."""
    return F.from_json(payload.cast("string"), kind)


def backoff(attempt: int, rand: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt after a number of them: doubling up to a limit, times half to all of itself."""
    return min(LONGEST, 2.0 ** (attempt - 1)) * (0.5 + 0.5 * rand())


def enqueue(jobs: DataFrame, queue: str, most: int = Q.MOST) -> bool:
    """Appends jobs; False if the queue cannot be written. The queue keeps its last `most` jobs."""
    try:
        Q.register(jobs.sparkSession)
        fields = T.StructType.fromDDL(JOB_SCHEMA).names
        if set(jobs.columns) <= set(fields):
            jobs = jobs.select(*[F.col(c) if c in jobs.columns else F.lit(None).cast("string").alias(c) for c in fields])
        jobs.write.format(Q.FORMAT).option("path", queue).option("most", most).mode("append").save()
    except Exception:  # noqa: BLE001  the caller is told, whatever the sink's error is
        return False
    return True


def jobs(spark: SparkSession, queue: str, group: str = "workers", per_batch: int = Q.PER_BATCH, schema: str | T.StructType = JOB_SCHEMA) -> DataFrame:
    """The queue as a consumer group sees it: what it has not acknowledged yet, up to per_batch jobs at once."""
    Q.register(spark)
    return spark.readStream.format(Q.FORMAT).schema(schema).option("path", queue).option("group", group).option("perBatch", per_batch).load()


def _log(rows: DataFrame, log: str | None, stage: str, error: str | None = None) -> None:
    """A row for each job and stage it came to."""
    if log:
        told = rows.select("job_id", "doc_id", F.lit(stage).alias("stage"), F.lit(PROGRESS.get(stage)).cast("int").alias("progress"), F.lit(error and error[:ERROR_MAX]).cast("string").alias("error"), F.current_timestamp().alias("at"))
        told.withColumn("order", F.lit(time.time_ns())).write.mode("append").parquet(log)


def run(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame], index: str, dead: str, checkpoint: str, attempts: int = ATTEMPTS, log: str | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> StreamingQuery:
    """Processes all that is queued: each batch replaces its documents in `index`, a Parquet folder per batch version.

    A batch is tried `attempts` times with growing pauses. If it fails, its jobs are built one by one, so that one bad
    document does not take the others with it; those that fail again are written to `dead`. All are acknowledged.
    Replays of a batch overwrite its version. With a `log`, jobs tell the stages they come to.
    """

    def tried(df: DataFrame, path: str, times: int) -> str | None:
        for n in range(1, times + 1):
            try:
                build(df).write.mode("overwrite").parquet(path)
                return None
            except Exception as e:  # noqa: BLE001
                error = str(e)
                if n < times:
                    sleep(backoff(n))
        return error

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            at = f"{index}/version={epoch}"
            _log(df, log, "parse")
            if (error := tried(df, f"{at}/part=all", attempts)) is None:
                return _log(df, log, "index")
            for i, row in enumerate(df.collect()):  # a batch is a few jobs
                one = df.sparkSession.createDataFrame([row], df.schema)
                if df.count() > 1:
                    error = tried(one, f"{at}/part={i}", 1)
                if error is None:
                    _log(one, log, "index")
                else:
                    one.write.mode("append" if i else "overwrite").json(f"{dead}/{epoch}")
                    _log(one, log, "failed", error)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def drained(query: StreamingQuery) -> None:
    """Waits until all that was queued is processed, and stops."""
    query.processAllAvailable()
    query.stop()


def job_status(spark: SparkSession, log: str) -> DataFrame:
    """(job_id, doc_id, stage, progress, error): the latest of each job."""
    rows = spark.read.parquet(log)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("doc_id", "stage", "progress", "error"), F.struct("order", "at")).alias("r")).select("job_id", "r.*")


def current(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of each document's last version."""
    rows = spark.read.parquet(index).drop("part")
    last = rows.groupBy("doc_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["doc_id", "version"])
