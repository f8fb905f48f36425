"""Streams with state of their own per key: alerts that have to hold for a while, conversations with a time to live.

Both run on transformWithState with event-time timers, which fire when the watermark passes them: state ends when the
data says so, however fast it is replayed. State is kept by RocksDB (see `configured`), and a conversation's can be
read back through Spark's state source.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Turns of a conversation that are kept, and seconds without a turn after which it is forgotten.
KEPT_TURNS, KEPT_SECONDS = 10, 1800


def configured(spark: SparkSession) -> None:
    """State in RocksDB, as transformWithState asks for. Processors travel whole: the process that starts them on the
    driver knows nothing of the packages that were sent to executors."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(t: Any) -> int:
    return int(pd.Timestamp(t).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(t).tzinfo is None else int(pd.Timestamp(t).timestamp() * 1000)


def _time(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC).replace(tzinfo=None)


class _Held(StatefulProcessor):
    """A key's run of windows in which the condition holds: since, until, and whether the alert has fired."""

    def __init__(self, labels: list[str], width_ms: int, at_least_ms: int):
        self.labels, self.width, self.least = labels, width_ms, at_least_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since long, until long, fired boolean")

    def close(self) -> None:
        pass

    def _rows(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(found, columns=["state", "since", "until"])
        for i, label in enumerate(self.labels):
            rows[label] = key[i]
        for c in ("since", "until"):
            rows[c] = pd.to_datetime(rows[c], unit="ms")
        return rows[[*self.labels, "state", "since", "until"]]

    def _ended(self, since: int, until: int, fired: bool) -> list[tuple]:
        """What is told when a run ends: an alert that it was long enough for is told first if its timer was not due yet."""
        out = [("firing", since, since + self.least)] if not fired and until - since >= self.least else []
        return out + ([("resolved", since, until)] if fired or out else [])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("start")  # a key's windows that closed since the last batch
        run = self.run.get() if self.run.exists() else None
        found: list[tuple] = []
        for start, holds in zip(seen["start"], seen["holds"], strict=True):
            at = _ms(start)
            if run is not None and (not holds or at != run[1]):
                found += self._ended(*run)
                self._timers(run, False)
                run = None
            if holds:
                if run is not None:
                    self._timers(run, False)
                run = (at, at + self.width, False) if run is None else (run[0], at + self.width, run[2])
                self._timers(run, True)
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
        if found:
            yield self._rows(key, found)

    def _timers(self, run: tuple, on: bool) -> None:
        """One for when the alert is due, and one for when the next window would have closed."""
        since, until, fired = run
        for at in {until + self.width, *([] if fired or since + self.least > until else [since + self.least])}:
            (self.handle.registerTimer if on else self.handle.deleteTimer)(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        since, until, fired = self.run.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        found: list[tuple] = []
        if not fired and since + self.least <= until and at >= since + self.least:
            found, fired = [("firing", since, since + self.least)], True
            self.run.update((since, until, True))
        if at >= until + self.width:
            found += self._ended(since, until, fired)
            self.run.clear()
        if found:
            yield self._rows(key, found)


def firing_stream(windows: DataFrame, width: dt.timedelta, at_least: dt.timedelta, *labels: str) -> DataFrame:
    """(labels..., state, since, until) of a stream of closed windows (start, labels..., holds), in append mode: `firing`
    when a condition has held for `at_least` without a gap, with the time it was due, and `resolved` when it ends.

    The runs that are resolved are those of alerts.firing over the same windows. Windows are of `width` and have the
    event time column `ts` (window_time of theirs); one without events is a gap. Without labels there is one key.
    """
    keyed = windows if labels else windows.withColumn("_all", F.lit("all"))
    names = list(labels) or ["_all"]
    ms = lambda d: int(d.total_seconds() * 1000)
    schema = T.StructType([*[keyed.schema[c] for c in names], *T.StructType.fromDDL("state string, since timestamp, until timestamp")])
    out = keyed.select(*names, "start", "holds", "ts").groupBy(*names).transformWithStateInPandas(
        statefulProcessor=_Held(names, ms(width), ms(at_least)), outputStructType=schema, outputMode="Append", timeMode="EventTime",
    )
    return out if labels else out.drop("_all")


class _Turns(StatefulProcessor):
    """A conversation's last turns, forgotten some time after the last one."""

    def __init__(self, columns: list[str], most: int, seconds: int):
        self.columns, self.most, self.ttl = columns, most, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, ts long, text string")
        self.last = handle.getValueState("last", "ts long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts", "turn"])
        kept = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(last + self.ttl)
        for turn, ts, text in zip(seen["turn"], seen["ts"], seen["text"], strict=True):
            at = _ms(ts)
            if last is not None and at - last >= self.ttl:  # it was forgotten before this turn came
                kept = []
            kept = sorted([*kept, (int(turn), at, text)], key=lambda t: t[0])[-self.most :]
            last = at if last is None else max(last, at)
        self.turns.put(kept)
        self.last.update((last,))
        self.handle.registerTimer(last + self.ttl)
        yield pd.DataFrame({self.columns[0]: [key[0]], "n": [len(kept)], "until": pd.to_datetime([last + self.ttl], unit="ms")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
            self.turns.clear()
            self.last.clear()
            yield pd.DataFrame({self.columns[0]: [key[0]], "n": [0], "until": pd.to_datetime([expiredTimerInfo.getExpiryTimeInMs()], unit="ms")})


def conversation_stream(turns: DataFrame, key: str, most: int = KEPT_TURNS, seconds: int = KEPT_SECONDS) -> DataFrame:
    """(key, n, until) for each change of a conversation: how many turns are kept, until when. turns: a stream of (key,
    turn, ts, text) with a watermark on ts. Every turn sets the time to live anew; after it nothing is kept, and a later
    turn begins afresh."""
    schema = T.StructType([turns.schema[key], *T.StructType.fromDDL("n long, until timestamp")])
    rows = turns.select(key, F.col("turn").cast("long").alias("turn"), "ts", "text")
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_Turns([key], most, seconds), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def kept_turns(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, turn, ts, text) that a conversation_stream with this checkpoint keeps, as of its last batch."""
    rows = spark.read.format("statestore").option("stateVarName", "turns").load(checkpoint)
    t = F.col("list_element")
    return rows.select(F.col(f"key.{key}").alias(key), t["turn"].alias("turn"), F.timestamp_millis(t["ts"]).alias("ts"), t["text"].alias("text"))
