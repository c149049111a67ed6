"""Structured Streaming: consolidation and burst merging as keyed state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.config import Config
from ..operators.materialize import Folded

FOLDED = "space_id string, concept string, judgment_id long, role string, component int, merged boolean, anomaly double"


class Consolidation(StatefulProcessor):
    """A concept's components as list state, one entry each, and as many vectors; a batch reads them and rewrites only what it changed.

    Lists are appended to; an entry that took rows up is overwritten in a map from its number to its activation and time,
    so that vectors, which never change, are written once.
    """

    def __init__(self, cfg: Config):
        self.cfg = cfg

    def init(self, handle) -> None:
        self.vectors = handle.getListState("vectors", "vector array<double>, weight double")
        self.uses = handle.getMapState("uses", "component int", "activation long, ts double")

    def handleInputRows(self, key, rows, timerValues):
        kept = list(self.vectors.get())
        fold = Folded(self.cfg)
        for vector, weight in kept:
            fold.open(weight, 0.0, np.array(vector, float))
        for (k,), (activation, ts) in self.uses.iterator():
            fold.f[k, 1:] = activation, ts
        pdf = pd.concat(list(rows)).sort_values(["seq", "judgment_id", "role"])
        out, touched = [], set()
        for row in pdf.to_dict("records"):
            before = fold.n
            times = fold.fields[:, 2].copy() if before else ()
            k, odd = fold.add(row["weight"], row["ts"], np.asarray(row["vector"], float))
            if k < before:
                fold.f[k, 2] = max(times[k], row["ts"])
            touched.add(k)
            out.append((*key, row["judgment_id"], row["role"], k, k < before, odd))
        if fold.n > len(kept):
            self.vectors.appendList([(fold.x[k].tolist(), float(fold.f[k, 0])) for k in range(len(kept), fold.n)])
        for k in touched:
            self.uses.updateValue((k,), (int(fold.f[k, 1]), float(fold.f[k, 2])))
        yield pd.DataFrame(out, columns=["space_id", "concept", "judgment_id", "role", "component", "merged", "anomaly"]).astype({"component": "int32"})

    def close(self) -> None:
        pass


def consolidate_stream(parts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The consolidation fold over a stream of components (space_id, concept, seq, judgment_id, role, vector, weight, ts).

    State is a concept's components so far; it needs the RocksDB state store (`with_state_store`). Rows of a batch are
    folded in the order of seq; a late row is folded when it arrives and decays from its own time; a component's time
    never goes back.
    """
    rows = parts.withColumns({"space_id": F.col("space_id").cast("string"), "concept": F.col("concept").cast("string"), "judgment_id": F.col("judgment_id").cast("long"), "vector": F.col("vector").cast("array<double>")})
    return rows.groupBy("space_id", "concept").transformWithStateInPandas(Consolidation(cfg), FOLDED, "append", "none")


def with_state_store(spark: SparkSession) -> None:
    """Sets the state store that list, map and timer state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


BURSTS = "chat string, sender string, ts double, n int, text string"


def burst_stream(messages: DataFrame, window: float = 45.0, least: int = 10, idle: float | None = None) -> DataFrame:
    """Bursts of a stream of messages (chat, id, sender, ts, text): a burst is given out when a later message closes it or,
    with `idle`, when so many seconds of processing time have passed without one."""
    def run(key, frames, state):
        now = list(state.get) if state.exists and not state.hasTimedOut else None
        out = []
        if state.hasTimedOut:
            out.append((*key, *state.get))
            state.remove()
        else:
            for row in pd.concat(list(frames)).sort_values(["ts", "id"]).to_dict("records"):
                if now and now[0] == row["sender"] and row["ts"] > 0 and now[1] > 0 and row["ts"] - now[1] < window:
                    now[2], now[3] = now[2] + 1, now[3] + "\n" + row["text"]
                    continue
                if now:
                    out.append((*key, *now))
                now = [row["sender"], row["ts"], 1, row["text"]]
            state.update(tuple(now))
            if idle is not None:
                state.setTimeoutDuration(int(1000 * idle))
        yield pd.DataFrame([r for r in out if len(r[4]) >= least], columns=["chat", "sender", "ts", "n", "text"])

    rows = messages.withColumn("chat", F.col("chat").cast("string")).withColumn("sender", F.col("sender").cast("string"))
    return rows.groupBy("chat").applyInPandasWithState(run, BURSTS, "sender string, ts double, n int, text string", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


class Bursts(StatefulProcessor):
    """Bursts by event time: messages wait until the watermark has passed them, then join in order; timers close what waits."""

    def __init__(self, window: float, least: int):
        self.window, self.least = window, least

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts double, id long, sender string, text string")
        self.open = handle.getValueState("open", "sender string, ts double, n int, text string")

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() / 1000
        new = pd.concat(list(rows))
        new = new[new["ts"] >= mark]  # a later message than the watermark may be given out already
        yield self.advance(key, mark, list(new[["ts", "id", "sender", "text"]].itertuples(index=False, name=None)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self.advance(key, timerValues.getCurrentWatermarkInMs() / 1000, [])

    def advance(self, key, mark: float, new: list) -> pd.DataFrame:
        waiting = sorted([*map(tuple, self.waiting.get()), *new], key=lambda m: (m[0], m[1]))
        now = tuple(self.open.get()) if self.open.exists() else None
        out = []
        while waiting and waiting[0][0] < mark:
            ts, _, sender, text = waiting.pop(0)
            if now and now[0] == sender and ts > 0 and now[1] > 0 and ts - now[1] < self.window:
                now = (now[0], now[1], now[2] + 1, now[3] + "\n" + text)
                continue
            if now:
                out.append((*key, *now))
            now = (sender, ts, 1, text)
        if now and (mark >= now[1] + self.window or now[1] <= 0):  # whatever comes is too late to join it
            out.append((*key, *now))
            now = None
        self.waiting.clear()
        if waiting:
            self.waiting.put(waiting)
        if now:
            self.open.update(now)
        else:
            self.open.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        due = [waiting[0][0]] if waiting else []
        due += [now[1] + self.window] if now else []
        if due:
            self.handle.registerTimer(int(max(min(due), mark) * 1000) + 1)
        return pd.DataFrame([r for r in out if len(r[4]) >= self.least], columns=["chat", "sender", "ts", "n", "text"]).astype({"n": "int32"})

    def close(self) -> None:
        pass


def burst_event_stream(messages: DataFrame, window: float = 45.0, least: int = 10, delay: str = "1 minute") -> DataFrame:
    """Bursts of a stream of messages (chat, id, sender, ts, text) by event time: those that `burst_merge` gives for all
    messages which are not late, whatever their order of arrival.

    The watermark stays `delay` behind the latest time seen. A message older than the watermark is late and is left out, as
    is one of unknown time (0) once there is a watermark. A burst is given out when no message that isn't late can join it.
    """
    rows = messages.select(F.col("chat").cast("string").alias("chat"), F.col("id").cast("long").alias("id"), F.col("sender").cast("string").alias("sender"), F.col("ts").cast("double").alias("ts"), "text", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")).alias("at"))
    return rows.withWatermark("at", delay).groupBy("chat").transformWithStateInPandas(Bursts(window, least), BURSTS, "append", "eventTime")
