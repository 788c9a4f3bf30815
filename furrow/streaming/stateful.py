"""Stateful operators of the live session on streams: admission, rate limits, state machine, carry-forward, expiry and logs.

Each has a batch twin in ``furrow.operators``; the transition functions are pure, so both give the same rows.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from furrow.operators.fusion import Tracker
from furrow.operators.sync import TRANSITIONS


def _schema(df: DataFrame, extra: str = "") -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + extra


def admitted(frames: DataFrame, started: str, captured: str, session: str, sequence: str, watermark: str = "10 minutes") -> DataFrame:
    """Frames captured since their session's start, each sequence number once within the watermark."""
    on_time = frames.where(F.col(captured) >= F.col(started)).withWatermark(captured, watermark)
    return on_time.dropDuplicatesWithinWatermark([session, sequence])


def rate_limited(frames: DataFrame, by: str, at: str, least: float) -> DataFrame:
    """Frames that lie ``least`` or more behind the last accepted one of their group; state is one number for each group, none before the first. Frames without a time are left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat([*batches]).sort_values(at, kind="stable")
        take = []
        for t in rows[at].astype("float64"):
            ok = t == t and (last is None or t - last >= least)
            take.append(ok)
            last = t if ok else last
        if last is not None:
            state.update((float(last),))
        yield rows[take]

    return frames.groupBy(by).applyInPandasWithState(step, _schema(frames), "last double", "append", GroupStateTimeout.NoTimeout)


def carried_forward(frames: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Add ``reused_value`` and ``reused``: the last value of the group that isn't null, over batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat([*batches]).sort_values(order, kind="stable").reset_index(drop=True)
        values, reused = [], []
        for v in rows[value]:
            own = v is not None and v == v
            last = float(v) if own else last
            values.append(last)
            reused.append(not own and last is not None)
        state.update((last,))
        yield rows.assign(reused_value=pd.array(values, "Float64").astype("float64"), reused=reused)

    return frames.groupBy(by).applyInPandasWithState(step, _schema(frames, ", reused_value double, reused boolean"), "last double", "append", GroupStateTimeout.NoTimeout)


def checked_states(events: DataFrame, by: str, order: str, state_col: str) -> DataFrame:
    """Add ``previous_state`` and ``legal``: whether the group's machine may go to the row's state. An illegal step leaves the machine where it is."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat([*batches]).sort_values(order, kind="stable").reset_index(drop=True)
        before, legal = [], []
        for s in rows[state_col]:
            ok = now is None or s == now or s in TRANSITIONS.get(now, ())
            before.append(now)
            legal.append(ok)
            now = s if ok else now
        state.update((now,))
        yield rows.assign(previous_state=before, legal=legal)

    return events.groupBy(by).applyInPandasWithState(step, _schema(events, ", previous_state string, legal boolean"), "now string", "append", GroupStateTimeout.NoTimeout)


def stalled_sessions(frames: DataFrame, by: str, timeout_ms: int) -> DataFrame:
    """(by, frames, stalled): counts while frames come; one row with stalled = true when none came for ``timeout_ms``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({by: [key[0]], "frames": [n], "stalled": [True]})
            return
        n += sum(len(b) for b in batches)
        state.update((n,))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({by: [key[0]], "frames": [n], "stalled": [False]})

    kind = frames.schema[by].dataType.simpleString()
    return frames.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, frames long, stalled boolean", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tracked(observations: DataFrame, by: str, radius: float, max_gap: int, neighbours: int = 3) -> DataFrame:
    """Add ``track_id`` to streamed (by, frame_index, observation_id, x, y): the batch operator's tracks, frame by frame.

    State is the live tracks of a session. Frames must come in order, each whole in one micro-batch; a frame that is older than one before is a new place in time.
    Without a list of processed frames, those with observations count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, tracker = (state.get[0], pickle.loads(state.get[1])) if state.exists else (0, Tracker(radius, max_gap, neighbours))
        rows = pd.concat([*batches]).sort_values(["frame_index", "observation_id"], kind="stable").reset_index(drop=True)
        ids = np.zeros(len(rows), np.int64)
        for _, frame in rows.groupby("frame_index", sort=True):
            place += 1
            ids[frame.index] = tracker.frame(place, frame["x"].tolist(), frame["y"].tolist())
        state.update((place, pickle.dumps(tracker)))
        yield rows.assign(track_id=ids)

    return observations.groupBy(by).applyInPandasWithState(step, _schema(observations, ", track_id long"), "place long, tracker binary", "append", GroupStateTimeout.NoTimeout)


def with_latest(frames: DataFrame, readings: DataFrame, by: str, at: str, value: str, delay: str = "0 seconds") -> DataFrame:
    """Frames (by, at in seconds, ...) with ``latest``, the last reading of their session up to their time; null before the first.

    Both streams go through one operator in event time. State holds a session's readings, in order, and the frames that wait: a frame is given out
    once the watermark (``delay`` behind the newest row of any session) has passed it, with the reading that is then known to be its last, in whatever order rows and
    micro-batches came. Of readings at one time the one with the larger value counts. Older readings than the last one before the watermark are forgotten. Rows that come later than
    ``delay`` are dropped, and so are rows without a time; a null reading is none.
    """
    none = F.lit(None).cast("double")
    both = frames.withColumn("_reading", none).withColumn("_frame", F.lit(True)).unionByName(
        readings.select(by, at, F.col(value).cast("double").alias("_reading"), F.lit(False).alias("_frame")), allowMissingColumns=True
    )
    timed = both.withColumn("_time", F.timestamp_millis(F.floor(F.col(at) * 1000).cast("long"))).where("_time is not null").withWatermark("_time", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting = pickle.loads(state.get[0]) if state.exists else ([], None)
        if not state.hasTimedOut:
            rows = pd.concat([*batches]).drop(columns=["_time"])
            new = rows[~rows["_frame"].astype(bool) & rows["_reading"].notna()]
            known = sorted({*known, *zip(new[at].astype(float).tolist(), new["_reading"].tolist(), strict=True)})
            came = rows[rows["_frame"].astype(bool)].drop(columns=["_reading", "_frame"])
            waiting = came if waiting is None else pd.concat([waiting, came])
        passed = state.getCurrentWatermarkMs()
        done = np.floor(waiting[at].astype(float) * 1000) <= passed if len(waiting) else np.zeros(0, bool)
        ready, waiting = waiting[done], waiting[~done]
        times = [t for t, _ in known]
        latest = [known[k - 1][1] if (k := bisect.bisect_right(times, t)) else None for t in ready[at].astype(float)]
        known = known[max(bisect.bisect_right(times, passed / 1000) - 1, 0) :]
        state.update((pickle.dumps((known, waiting)),))
        if len(waiting):
            first = int(np.floor(waiting[at].astype(float).min() * 1000))
            state.setTimeoutTimestamp(max(first - 1, passed + 1))
        yield ready.assign(latest=pd.array(latest, "Float64").astype("float64"))

    return timed.groupBy(by).applyInPandasWithState(step, _schema(frames, ", latest double"), "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def newest_only(frames: DataFrame, by: str, sequence: str) -> DataFrame:
    """Of each session and micro-batch the frame of the highest number, if it is higher than all before: a queue of one place that each trigger empties.

    Adds the session's counts so far: ``pushed`` frames, those ``dropped`` because a newer one took their place or had gone before, and those ``popped``. Frames without a number are dropped. A
    session that ends needs no closing: what its last trigger brought has been given out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pushed, popped = state.get if state.exists else (None, 0, 0)
        rows = pd.concat([*batches])
        pushed += len(rows)
        known = rows[rows[sequence].notna()].sort_values(sequence, kind="stable").tail(1)
        if len(known) and (last is None or known[sequence].iloc[0] > last):
            last, popped = int(known[sequence].iloc[0]), popped + 1
        else:
            known = known.head(0)
        state.update((last, pushed, popped))
        yield known.assign(pushed=pushed, dropped=pushed - popped, popped=popped)

    return frames.groupBy(by).applyInPandasWithState(step, _schema(frames, ", pushed long, dropped long, popped long"), "last long, pushed long, popped long", "append", GroupStateTimeout.NoTimeout)


def closed_sessions(events: DataFrame, by: str, order: str, on: str) -> DataFrame:
    """(by, started, ended, records): one row when a session ends, that is with the first row whose ``on`` is false behind rows whose ``on`` is true."""
    kind, number = events.schema[by].dataType.simpleString(), events.schema[order].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows, out = pd.concat([*batches]).sort_values(order, kind="stable"), []
        for at, running in zip(rows[order].tolist(), rows[on].tolist(), strict=True):
            if running:
                start, n = (at if n == 0 else start), n + 1
            elif n:
                out.append((key[0], start, at, n))
                start, n = None, 0
        state.update((start, n))
        yield pd.DataFrame(out, columns=[by, "started", "ended", "records"])

    return events.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, started {number}, ended {number}, records long", f"started {number}, n long", "append", GroupStateTimeout.NoTimeout)


def fresh(results: DataFrame, generated: str, now: Column, most: str = "1500 milliseconds") -> DataFrame:
    """Results that haven't expired at the time of reading."""
    return results.where(F.col(generated) >= now - F.expr(f"INTERVAL {most}"))


def frame_rate(frames: DataFrame, at: str, by: list[str], window: str = "10 seconds", watermark: str = "1 minute") -> DataFrame:
    """Frames a second in tumbling windows."""
    seconds = F.expr(f"INTERVAL {window}")
    counts = frames.withWatermark(at, watermark).groupBy(F.window(at, window), *by).agg(F.count(F.lit(1)).alias("frames"))
    return counts.select(F.col("window.start").alias("start"), *by, "frames", (F.col("frames") / (F.unix_timestamp(F.col("window.start") + seconds) - F.unix_timestamp("window.start"))).alias("fps"))


def session_logs(folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each table of a batch; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, make in tables.items():
            make(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/{name}")
        batch.unpersist()

    return write


def json_logs(folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]], by: str, most: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each table of a batch to its session's JSON lines, of which the newest ``most`` bytes stay.

    ``folder``/name/by=.../batch_id=... holds a batch's lines of a session. A batch that is run again replaces its own. Once the batches from the newest back exceed the budget,
    the older ones are deleted, whole; the newest stays whatever its size. ``session_summary`` tells what was written, kept and discarded. A row whose session is null isn't written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, sizes = batch.sparkSession, None
        batch.persist()
        for name, make in tables.items():
            lines = make(batch).where(F.col(by).isNotNull())
            lines = lines.select(F.col(by), F.to_json(F.struct(*lines.columns)).alias("value"), F.lit(batch_id).alias("batch_id"))
            lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch_id").text(f"{folder}/{name}")
            one = lines.groupBy(by).agg(F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"), F.count(F.lit(1)).alias("records")).withColumn("log", F.lit(name))
            sizes = one if sizes is None else sizes.unionByName(one)
        sizes.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/sizes")
        batch.unpersist()
        own = F.sum(F.when(F.col("batch_id") == batch_id, F.col("bytes")).otherwise(0)).over(W.partitionBy(by, "log"))
        # what this batch has pushed out; what earlier ones have is gone already
        gone = _retained(spark.read.parquet(f"{folder}/sizes"), by, most).withColumn("_own", own).where(~F.col("kept") & (F.col("_own") > 0))
        escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in gone.select(F.col(by).cast("string").alias("s"), "log", "batch_id").toLocalIterator():
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['log']}/{by}={escape(row['s'])}/batch_id={row['batch_id']}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return write


def _retained(sizes: DataFrame, by: str, most: int) -> DataFrame:
    newest = W.partitionBy(by, "log").orderBy(F.desc("batch_id"))
    total = F.sum("bytes").over(newest.rowsBetween(W.unboundedPreceding, 0))
    return sizes.withColumn("kept", (total <= most) | (F.row_number().over(newest) == 1))


def session_summary(spark: SparkSession, folder: str, by: str, most: int) -> DataFrame:
    """(by, log, batches, records, bytes, records_kept, bytes_kept, records_discarded) of what ``json_logs`` has written with the same budget."""
    held = _retained(spark.read.parquet(f"{folder}/sizes"), by, most)
    kept = lambda c: F.sum(F.when(F.col("kept"), F.col(c)).otherwise(0))
    return held.groupBy(by, "log").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), kept("records").alias("records_kept"), kept("bytes").alias("bytes_kept"),
        (F.sum("records") - kept("records")).alias("records_discarded"),
    )


class StatusListener(StreamingQueryListener):
    """Hands a small status document to ``put`` at each step of each query: its state, batch, rows and rate, or why it ended."""

    def __init__(self, put: Callable[[dict], None]) -> None:
        self.put = put

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.put({"query": str(event.name or event.id), "state": "STARTING"})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.put({"query": str(p.name or p.id), "state": "RUNNING", "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "at": p.timestamp})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.put({"query": str(event.id), "state": "RUNNING", "rows": 0, "at": event.timestamp})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.put({"query": str(event.id), "state": "ERROR" if event.exception else "IDLE", "reason": event.exception})
