"""Streaming twins of the stateful frame operators; each gives the rows of its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from framewright.functions.tables import shared_folder
from framewright.operators import loop


def arrivals(stream: DataFrame) -> DataFrame:
    """Every frame with its verdict, ``kept`` or why it is left out; see ``loop.judge_arrival``.  State is three numbers a session."""
    return loop.over_stream(stream, ["session_id"], ["arrival"], loop.judge_arrival, loop.ARRIVED, loop.ARRIVED_STATE)


def monotonic(stream: DataFrame) -> DataFrame:
    """Frames ``session_id, capture_epoch, seq, t_ms`` whose sequence and time exceed all before them in their session and epoch.

    State is three numbers a session and epoch; frames of a micro-batch go in order of ``arrival``.
    """
    keys = ["session_id", "capture_epoch"]
    each = lambda state, rows: (lambda kept, out: (kept, out.drop(columns="capture_epoch")))(*loop.judge_arrival(state, rows))
    schema = "session_id long, capture_epoch long, seq long, t_ms double, verdict string"
    return loop.over_stream(stream, keys, ["arrival"], each, schema, loop.ARRIVED_STATE).filter("verdict = 'kept'").drop("verdict")


def onsets(stream: DataFrame) -> DataFrame:
    return loop.over_stream(stream, ["session_id"], ["seq"], loop.find_onsets, loop.ONSETS, loop.ONSET_STATE)


def voice_features(stream: DataFrame, noise_floor: float = 0.002) -> DataFrame:
    """Frames of blocks of sound; state is the last 50 ms of sound, the blocks of the last two seconds and a few numbers."""
    return loop.over_stream(stream, ["session_id", "capture_epoch"], ["arrival"], loop.voice_features(noise_floor), loop.VOICE, loop.VOICE_STATE)


class _Movement(StatefulProcessor):
    """Carries the motion points of a session's last usable frame, until none has come for ``quiet_ms``."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "x array<double>, y array<double>, at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last, speeds = self.last.get() if self.last.exists() else None, []
        for motion, at, usable in zip(frames["motion"], frames["acquired_at_ms"], frames["usable"], strict=True):
            now = None if motion is None else ([p["x"] for p in motion], [p["y"] for p in motion], at)
            passed = now and last and (at - last[2]) / 1000
            moved = np.hypot(np.subtract(now[0], last[0]), np.subtract(now[1], last[1])).mean() if now and last else np.nan
            speeds.append(moved / passed if passed and passed > 0 else np.nan)
            last = now if usable else None
        if last:
            self.last.update(last)
        elif self.last.exists():
            self.last.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame({"session_id": key[0], "seq": frames["seq"], "movement_speed": speeds})

    def handleExpiredTimer(self, key: tuple, timers: TimerValues, info: object) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def movement_speed(stream: DataFrame, quiet_ms: int = 300_000) -> DataFrame:
    """``session_id, seq, movement_speed`` of composed face frames (``motion, acquired_at_ms, usable``), as in their batch form.

    Needs the RocksDB state store.  A session's points go when no frame has come
    for ``quiet_ms`` of processing time; its timers keep a query running, also one
    that was started for what is available.
    """
    return stream.groupBy("session_id").transformWithStateInPandas(_Movement(quiet_ms), "session_id long, seq long, movement_speed double", "Append", "ProcessingTime")


def throttle(stream: DataFrame, fps: float) -> DataFrame:
    """Frames at most ``fps`` times a second, counted from the last accepted one."""
    schema = T.StructType.fromDDL("session_id long, t_ms double")
    least = 1000.0 / fps

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        kept = []
        times = np.sort(pd.concat(list(batches))["t_ms"].to_numpy())
        while (at := int(np.searchsorted(times - last, least))) < len(times):  # one search a kept frame
            last = float(times[at])
            kept.append((key[0], last))
            times = times[at + 1 :]
        state.update((last,))
        yield pd.DataFrame(kept, columns=["session_id", "t_ms"])

    return stream.groupBy("session_id").applyInPandasWithState(step, schema, T.StructType.fromDDL("last double"), "append", GroupStateTimeout.NoTimeout)


def cadence(stream: DataFrame, late: str = "10 seconds", window: str = "5 seconds") -> DataFrame:
    """Frames and active frames per tumbling window of event time; frames later than ``late`` are dropped."""
    s = stream.withColumn("at", F.timestamp_millis(F.col("t_ms").cast("long"))).withWatermark("at", late)
    return s.groupBy("session_id", F.window("at", window).alias("w")).agg(F.count("*").alias("frames"), F.count_if("speech_active").alias("active")).select(
        "session_id", F.unix_millis(F.col("w.start")).alias("start_ms"), "frames", "active")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into files, and reads them."""
    root = shared_folder(stream.sparkSession, "streams")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def from_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
