"""Navigation sessions over a stream of fixes and route events, with state by user."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from umbra.shared import shared_dir

#: Offset (m) from which a fix counts against the route, up to which it is on it, and largest uncertainty; strikes; reach of the goal (m);
#: milliseconds without a new way after a new route, a failed one, and a place outside the area.
OFF_M, ON_M, MOST_ACCURACY_M, STRIKES, ARRIVAL_M = 35.0, 20.0, 100.0, 3, 15.0
AFTER_ROUTE_MS, AFTER_ERROR_MS, OUTSIDE_MS = 8_000, 15_000, 60_000
#: A user without events for so long is forgotten.
IDLE_MS = 6 * 3_600_000

EVENTS = "user_id long, event_id long, ts timestamp, kind string, along_m double, offset_m double, accuracy_m double, direct_m double, total_m double, in_area boolean"
STATE = "at_ms long, total_m double, along_m double, strikes int, rerouting boolean, quiet_until_ms long, arrived boolean"
RESULT = "user_id long, event_id long, ts timestamp, action string, along_m double, remaining_m double, strikes int"
START = (None, None, None, 0, False, 0, False)


def advanced(state: tuple, now: int, kind: str, along: float, offset: float, accuracy: float | None, direct: float, total: float, in_area: bool) -> tuple[tuple, str]:
    """The state after an event and what the event did; see ``sessions``."""
    _, length, at, strikes, rerouting, quiet, arrived = state
    length = total if length is None else length
    action = "ignored"
    if kind == "route":
        length, at, strikes, rerouting, quiet, action = total, None, 0, False, now + AFTER_ROUTE_MS, "route"
    elif kind == "error" and rerouting:
        rerouting, quiet, action = False, now + AFTER_ERROR_MS, "failed"
    elif kind == "fix" and not arrived:
        accuracy = max(0.0, accuracy) if accuracy is not None and accuracy == accuracy else 0.0
        if not rerouting and now >= quiet and accuracy <= MOST_ACCURACY_M:
            strikes = strikes + 1 if offset > max(OFF_M, accuracy) else 0
            if strikes >= STRIKES:
                strikes, rerouting, quiet, action = (0, True, quiet, "reroute") if in_area else (0, False, now + OUTSIDE_MS, "outside")
        if action == "ignored" and rerouting:
            action = "waiting"
        elif action == "ignored":
            at = along if offset <= ON_M or at is None else at
            remaining = length - min(length, max(0.0, at))
            arrived = direct <= ARRIVAL_M or (remaining <= ARRIVAL_M and offset <= OFF_M)
            action = "arrived" if arrived else "progress"
    return (now, length, at, strikes, rerouting, quiet, arrived), action


class Session(StatefulProcessor):
    """One state a user; a timer forgets users that have gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state = tuple(self.state.get()) if self.state.exists() else START
        out = []
        for e in events.itertuples(index=False):
            now = e.ts.value // 1_000_000
            state, action = advanced(state, now, e.kind, e.along_m, e.offset_m, e.accuracy_m, e.direct_m, e.total_m, bool(e.in_area))
            _, total, along, strikes, *_ = state
            out.append((key[0], e.event_id, e.ts, action, along, None if along is None else total - min(total, max(0.0, along)), strikes))
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state[0] + IDLE_MS)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "action", "along_m", "remaining_m", "strikes"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def navigated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """user_id, event_id, ts, action, along_m, remaining_m, strikes: what each event does to its user's walk.

    A fix more than OFF_M (and its own uncertainty) from the route is a strike, unless it is too uncertain or a quiet time runs; three in a row ask for a
    new route ('reroute') or, outside the area, begin a quiet time ('outside'). While a new route is awaited fixes wait. Others
    move the progress if they are on the route, and end the walk at the goal ('arrived'). Events 'route' (a new route of total_m) and 'error' (none was
    found) answer. Events of one user are taken in order of time and number within a batch, so files must come in order of time. A user's
    state is forgotten once the watermark is IDLE_MS past the last event.
    """
    timed = events.withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(Session(), outputStructType=StructType.fromDDL(RESULT), outputMode="Append", timeMode="EventTime")


def replayed(spark: SparkSession, events: DataFrame, name: str = "session", files: int = 1) -> DataFrame:
    """``navigated`` over ``events`` replayed as a stream of ``files`` files in order of time, a batch each; its rows as a table.

    What the stream reads, keeps and writes lies in the shared folder, so it goes on after lost executors.
    """
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [f.name for f in StructType.fromDDL(EVENTS)]
    rows = events.select(*columns)
    if files > 1:
        ranged = rows.repartitionByRange(files, "ts").sortWithinPartitions("ts")
        for i in range(files):
            ranged.where(F.spark_partition_id() == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    else:
        rows.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1 if files > 1 else 100_000).parquet(f"{folder}/in")
    query = navigated(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(RESULT).parquet(f"{folder}/out")
