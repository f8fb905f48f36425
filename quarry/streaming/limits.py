"""Rate limiter and circuit breaker: as a replay of a batch, and as state of a stream."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_REQUESTS, WINDOW_S = 20, 60.0
FAILURES, RESET_S = 5, 30.0


def _seconds(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _replayed(rows: DataFrame, key: str, read: list[str], fresh: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """rows (key, id, ..., _t) with the columns that a replay adds, without _t.

    fresh() starts a key; what it gives takes the values of `read` of a row, in order of _t and id (nulls last), and
    returns the new columns' values. A task holds a batch of rows and one key's state, whatever a key's share.
    """
    kept = [c for c in rows.columns if c != "_t"]
    added = [x.split()[0] for x in schema.split(", ")]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out: list[tuple] = []
            # Null times are NaN, which is before and after nothing.
            times = batch.column("_t").to_numpy(zero_copy_only=False).tolist()
            values = [times if c == "_t" else batch.column(c).to_pylist() for c in read]
            for k, *v in zip(batch.column(key).to_pylist(), *values, strict=True):
                if step is None or not (k == now or (k != k and now != now)):
                    now, step = k, fresh()
                out.append(step(*v))
            columns = [pa.array(c) for c in zip(*out, strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *added])

    order = [F.asc(key), F.asc_nulls_last("_t"), F.asc_nulls_last("id")]
    full = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], schema])
    return rows.repartition(F.col(key)).sortWithinPartitions(*order).mapInArrow(run, full)


def limited(hits: DataFrame, key: str, most: int = MAX_REQUESTS, window: float = WINDOW_S) -> DataFrame:
    """hits (key, id, ts) with `allowed`: at most `most` accepted hits in (ts - window, ts]; rejected ones do not count.

    The state of a key is its accepted times inside the window. A hit without a time is allowed and not recorded.
    """

    def fresh() -> Callable[[float], tuple[bool]]:
        held: list[float] = []

        def step(t: float) -> tuple[bool]:
            if t != t:
                return (most > 0,)
            held[:] = [x for x in held if x > t - window]
            allowed = len(held) < most
            if allowed:
                held.append(t)
            return (allowed,)

        return step

    return _replayed(hits.select(key, "id", "ts", _seconds().alias("_t")), key, ["_t"], fresh, "allowed boolean")


def hits_in_window(hits: DataFrame, key: str, window: int = int(WINDOW_S)) -> DataFrame:
    """hits with `n`, how many of the key's hits lie in the window up to each: the limiter if none were rejected."""
    w = Window.partitionBy(key).orderBy(F.col("_s")).rangeBetween(-window + 1, 0)
    return hits.withColumn("_s", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("n", F.count(F.lit(1)).over(w)).drop("_s")


class Breaker:
    """closed until `most` failures (a success takes one off), then open; after `reset` seconds one probe decides."""

    def __init__(self, most: int = FAILURES, reset: float = RESET_S, failures: int = 0, opened: float | None = None):
        self.most, self.reset, self.failures, self.opened = most, reset, failures, opened

    def state(self, now: float) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if now - self.opened >= self.reset else "open"

    def record(self, ok: bool, now: float) -> str:
        """What became of a call: rejected, ok or failed."""
        state = self.state(now)
        if state == "open":
            return "rejected"
        if ok:
            self.failures = 0 if state == "half_open" else max(0, self.failures - 1)
            self.opened = None
            return "ok"
        self.failures += 1
        if state == "half_open" or self.failures >= self.most:
            self.opened = now
        return "failed"


def breaker_log(calls: DataFrame, key: str = "target", most: int = FAILURES, reset: float = RESET_S) -> DataFrame:
    """calls (target, id, ts, ok) with outcome and the state after each, replayed in order of time."""

    def fresh() -> Callable[[float, bool], tuple[str, str]]:
        b = Breaker(most, reset)
        return lambda t, ok: (b.record(bool(ok), t), b.state(t))

    return _replayed(calls.select(key, "id", "ok", _seconds().alias("_t")), key, ["_t", "ok"], fresh, "outcome string, state string")


def limited_stream(hits: DataFrame, key: str, most: int = MAX_REQUESTS, window: float = WINDOW_S) -> DataFrame:
    """A stream of hits (key, id, ts) with `allowed`; the state of a key is its accepted times inside the window, and goes
    when no hit comes for twice that long."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["_t", "id"], kind="stable")
        allowed = []
        for t in rows["_t"]:
            held = [x for x in held if x > t - window]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(t)
        state.update((held,))
        state.setTimeoutDuration(int(2000 * window))
        yield pd.DataFrame({key: rows[key], "id": rows["id"], "allowed": allowed})

    kind = dict(hits.dtypes)
    timed = hits.select(key, "id", _seconds().alias("_t"))
    schema = f"{key} {kind[key]}, id {kind['id']}, allowed boolean"
    return timed.groupBy(key).applyInPandasWithState(step, schema, "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def with_retry(call: Callable[[], object], attempts: int = 2, base: float = 0.5, most: float = 8.0, retry_on: tuple = (Exception,), sleep: Callable[[float], None] = time.sleep, rand: Callable[[], float] = random.random):
    """call's result; between attempts a pause of min(most, base * 2^n), times 0.5 to 1.5."""
    for n in range(attempts):
        try:
            return call()
        except retry_on:
            if n == attempts - 1:
                raise
            sleep(min(most, base * 2**n) * (0.5 + rand()))
    return None
