"""Counters, rates, quantiles and alerts over event time. The same functions work on batches and streams.

Events have `ts` as TIMESTAMP. An alert is a condition on windows that holds without a gap for a while.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the latency buckets in seconds.
BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0)


def counters(events: DataFrame, width: str, *labels: str, slide: str | None = None) -> DataFrame:
    """(start, labels..., n) per window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), *labels).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *labels, "n")


def ratio(events: DataFrame, hit: Column, width: str, *labels: str, slide: str | None = None) -> DataFrame:
    """(start, labels..., hits, n, ratio): share of the events that are hits."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    by = events.groupBy(w.alias("w"), *labels).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("start"), *labels, "hits", "n", (F.col("hits") / F.greatest(F.col("n").cast("double"), F.lit(1e-6))).alias("ratio"))


def rate(events: DataFrame, width: str, seconds: float, value: Column | None = None, *labels: str) -> DataFrame:
    """(start, labels..., rate): events, or the sum of value, per second."""
    total = F.count(F.lit(1)) if value is None else F.sum(value)
    by = events.groupBy(F.window("ts", width).alias("w"), *labels).agg(total.alias("n"))
    return by.select(F.col("w.start").alias("start"), *labels, (F.col("n") / seconds).alias("rate"))


def increase(events: DataFrame, hit: Column, width: str, slide: str, *labels: str) -> DataFrame:
    """(start, labels..., increase): how many hits each sliding window has; windows without any are not there."""
    by = events.where(hit).groupBy(F.window("ts", width, slide).alias("w"), *labels).agg(F.count(F.lit(1)).alias("increase"))
    return by.select(F.col("w.start").alias("start"), *labels, "increase")


def histogram(events: DataFrame, value: str, width: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(start, total, counts): cumulative counts of values up to each bound."""
    below = F.array(*[F.count_if(F.col(value) <= b) for b in bounds])
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count(value).alias("total"), below.alias("counts")).select(F.col("w.start").alias("start"), "total", "counts")


def histogram_quantile(hist: DataFrame, q: float, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(start, value): the quantile by linear interpolation inside its bucket; beyond all bounds the last one."""
    target = F.lit(q) * F.col("total")
    at = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(len(bounds) - 1)), lambda i: F.get("counts", i) >= target))
    ends = F.array(*map(F.lit, bounds))
    low = F.when(at > 0, F.get(ends, at - 1)).otherwise(F.lit(0.0))
    c_low = F.when(at > 0, F.get("counts", at - 1)).otherwise(F.lit(0))
    value = low + (F.get(ends, at) - low) * (target - c_low) / F.greatest(F.get("counts", at) - c_low, F.lit(1))
    return hist.select("start", F.when(F.col("total") > 0, F.coalesce(value, F.lit(bounds[-1]))).alias("value"))


def sketches(events: DataFrame, value: str, width: str, *labels: str, k: int = 400) -> DataFrame:
    """(start, labels..., n, sketch): a quantile sketch of each window, which can be merged with others. Nulls do not
    count."""
    by = events.where(F.col(value).isNotNull()).groupBy(F.window("ts", width).alias("w"), *labels)
    return by.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch")).select(F.col("w.start").alias("start"), *labels, "n", "sketch")


def sliding_quantiles(rows: DataFrame, q: list[float], width: str, slide: str, *labels: str) -> DataFrame:
    """(start, labels..., n, values): quantiles over sliding windows from the sketches of short ones (see sketches), whose
    width divides slide and width. A short window's sketch goes to each sliding window that holds it; events do not."""
    by = rows.groupBy(F.window("start", width, slide).alias("w"), *labels).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    values = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(x))) for x in q])
    return by.select(F.col("w.start").alias("start"), *labels, "n", values.alias("values"))


def firing(windows: DataFrame, condition: Column, width: str, at_least: str, *labels: str) -> DataFrame:
    """(labels..., since, until): runs of windows, one after the other, in which a condition holds for `at_least`.

    A label's windows meet in one task; there is one for each `width` of time, however many events it has."""
    by = Window.partitionBy(*labels).orderBy("start")
    step = F.expr(f"INTERVAL {width}")
    held = windows.where(condition).withColumn("_new", F.when(F.col("start") == F.lag("start").over(by) + step, 0).otherwise(1))
    runs = held.withColumn("_run", F.sum("_new").over(by)).groupBy(*labels, "_run").agg(F.min("start").alias("since"), (F.max("start") + step).alias("until"))
    return runs.where(F.col("until") - F.col("since") >= F.expr(f"INTERVAL {at_least}")).drop("_run")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """(key, since, until, n): events of a key less than `gap` apart."""
    by = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def stream_of(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream with `ts` as event time and a bound on lateness."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def deduplicated(stream: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key; state is kept as long as a copy may come late."""
    return stream_of(stream, late).dropDuplicatesWithinWatermark(list(keys))


def matched(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Events (key, ts, ...) of a stream with those of another that follow within a time; state expires with it."""
    a = stream_of(left, late).alias("a")
    b = stream_of(right, late).select(F.col(key).alias("_key"), F.col("ts").alias("other_ts"), *[F.col(c).alias(f"other_{c}") for c in right.columns if c not in (key, "ts")]).alias("b")
    near = (F.col(f"a.{key}") == F.col("_key")) & (F.col("other_ts") >= F.col("a.ts")) & (F.col("other_ts") <= F.col("a.ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).drop("_key")
