"""Transitions inside open sessions of a stream (an extension), as ``operators.sessions.transitions`` finds them in a table.

Rows wait, keyed by their session, until the watermark has passed them; then their order is final and each
becomes the source or the target of an edge.  Of what was released only the last row stays, and with ``gap`` it
goes too when the watermark is more than the gap later, as no edge can start from it any more.  State is
therefore what the watermark holds back, and one row for each open session.

Rows that come after the watermark has passed their time are left out, as everywhere in streams; rows without
a session or a time are left out as well.  The rows that one session holds back meet in the memory of one
task, so a whole archive belongs into the table form, whose windows spill.  Rows that tie in time are ordered by their node.  On a table (no
stream) the same edges come from a window.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.staging import folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenSessions(StatefulProcessor):
    """State of a session: rows that the watermark has not passed (a list) and the last one released (a value), as (at, node, state)."""

    def __init__(self, held: StructType, names: list[str], gap: int | None) -> None:
        self.held, self.gap, self.edge = held, gap, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.held)
        self.last = handle.getValueState("last", self.held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [(r["at"], r["node"], r["state"]) for r in rows if r["at"] > passed]
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(fresh)
        return iter(())

    def _wake(self, waiting: list[tuple]) -> None:
        """A timer for the first of the rows, which then sets the next one; timers run once the watermark is later than they are."""
        self.handle.registerTimer(-(-min(r[0] for r in waiting) // 1000) - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in waiting if r[0] <= passed), key=lambda r: (r[0], r[1] is not None, r[1]))
        before = tuple(self.last.get()) if self.last.exists() else None
        if ready:
            later = [r for r in waiting if r[0] > passed]
            if later:
                self.waiting.put(later)
                self._wake(later)
            else:
                self.waiting.clear()
        last = ready[-1] if ready else before
        if last is not None and self.gap is not None and last[0] + self.gap < passed:
            self.last.clear()
        elif ready:
            self.last.update(last)
            if self.gap is not None:
                self.handle.registerTimer((last[0] + self.gap) // 1000)
        for source, target in itertools.pairwise(ready if before is None else [before, *ready]):
            if self.gap is None or target[0] - source[0] <= self.gap:
                yield self.edge(key[0], source[1], target[1], source[2], target[2])

    def close(self) -> None:
        pass


def session_transitions(events: DataFrame, session: str, timestamp: str, node: str, state: str, gap: int | None = None, watermark: str = "2 hours") -> DataFrame:
    """session, source, target, source_state, target_state: edges to the next row of the session, at most ``gap`` seconds later.

    On a stream, set ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKS`` and write in append mode.
    """
    micros = None if gap is None else gap * 1_000_000
    names = [session, "source", "target", "source_state", "target_state"]
    rows = events.select(F.col(session), F.col(timestamp).cast("timestamp").alias("_time"), F.col(node).alias("node"), F.col(state).alias("state"))
    rows = rows.where(F.col(session).isNotNull() & F.col("_time").isNotNull()).withColumn("at", F.unix_micros("_time"))
    rows = rows.withColumn("_time", F.timestamp_millis(F.expr("at div 1000 + if(at % 1000 > 0, 1, 0)")))  # watermarks are whole milliseconds
    if not events.isStreaming:
        w = Window.partitionBy(session).orderBy("at", "node")
        edges = rows.select(session, F.col("node").alias("source"), F.lead("node").over(w).alias("target"), F.col("state").alias("source_state"), F.lead("state").over(w).alias("target_state"), (F.lead("at").over(w) - F.col("at")).alias("_apart"))
        return edges.where(F.col("_apart").isNotNull() if gap is None else F.col("_apart") <= micros).drop("_apart")
    of = {f.name: f.dataType for f in rows.schema}
    held = StructType([StructField("at", LongType()), StructField("node", of["node"]), StructField("state", of["state"])])
    out = StructType([StructField(n, t) for n, t in zip(names, [of[session], of["node"], of["node"], of["state"], of["state"]])])
    return rows.withWatermark("_time", watermark).groupBy(session).transformWithState(OpenSessions(held, names, micros), out, "Append", "EventTime")


def replayed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream over files gives by the time it has read all of them, from a table in the shared folder."""
    path, setting = f"{folder(spark)}/stream-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
