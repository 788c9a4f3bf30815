"""Telemetry synchronisation, carry-forward and session operators over (session, time) order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def asof_both(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str) -> DataFrame:
    """``left`` with structs ``before`` (latest right row with start <= at) and ``after`` (earliest with start > at), by union and window."""
    cols = [c for c in right.columns if c not in by]
    payload = F.struct(*cols)
    none = F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    l = left.select(*by, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), none.alias("_r"))
    r = right.select(*by, F.col(start).cast("double").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    both = l.unionByName(r)
    ahead = W.partitionBy(*by).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*by).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("before", F.last("_r", ignorenulls=True).over(ahead)).withColumn("after", F.last("_r", ignorenulls=True).over(back))
    return both.where("_side = 1").select("_l.*", "before", "after")


def sync_frames(frames: DataFrame, telemetry: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Match frames (query_time) with telemetry intervals [start_seconds, end_seconds).

    exact_interval: the latest start not behind the time, if its interval holds it. Otherwise the nearer of the two
    neighbours (the earlier of equals) within the tolerance, else missing. The delta is time - start.
    """
    held = asof_both(frames, telemetry, by, "query_time", "start_seconds")
    t, b, a = F.col("query_time"), F.col("before"), F.col("after")
    exact = b.isNotNull() & (t < b["end_seconds"])
    gap_b = F.greatest(t - b["end_seconds"], F.lit(0.0))
    gap_a = a["start_seconds"] - t
    near = F.when(b.isNotNull() & (a.isNull() | (gap_b <= gap_a)), b).otherwise(a)
    gap = F.when(b.isNotNull() & (a.isNull() | (gap_b <= gap_a)), gap_b).otherwise(gap_a)
    within = gap <= tolerance
    match = F.when(exact, b).when(within, near)
    status = F.when(exact, "exact_interval").when(within, "nearest_within_tolerance").otherwise("missing")
    return held.select(*frames.columns, match.getField("srt_index").alias("srt_index"), (t - match.getField("start_seconds")).alias("delta_seconds"), status.alias("sync_status"))


def carry_forward(df: DataFrame, group: list[str], order: list[Column], value: str) -> DataFrame:
    """Add ``reused_value`` (the last value that isn't null) and ``reused`` (true if it is an earlier row's)."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(w)
    return df.withColumn("reused_value", last).withColumn("reused", F.col(value).isNull() & last.isNotNull())


def sessions_by_edges(df: DataFrame, group: list[str], order: list[Column], start: Column) -> DataFrame:
    """Add ``session``: the number of start edges up to and with the row; an edge is a rise of ``start`` from false. A null start is neither an edge nor a fall."""
    w = W.partitionBy(*group).orderBy(*order)
    edge = F.coalesce(start, F.lit(False)) & ~F.coalesce(F.last(start, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    marked = df.withColumn("_edge", edge.cast("int"))
    return marked.withColumn("session", F.sum("_edge").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_edge")


def chain_clusters(df: DataFrame, group: list[str], value: str, order: list[Column], gap: float | Column) -> DataFrame:
    """Add ``cluster``: values in order stay together while each is within ``gap`` of the one before."""
    w = W.partitionBy(*group).orderBy(*order)
    jump = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_jump", jump).withColumn("cluster", F.sum("_jump").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_jump")


def latest_per_trigger(df: DataFrame, trigger: list[str], sequence: str, capacity: int = 1) -> DataFrame:
    """What a queue that drops its oldest keeps at the end of each trigger, with counts of pushed and dropped rows."""
    w = W.partitionBy(*trigger).orderBy(F.desc(sequence))
    counted = df.withColumn("_n", F.row_number().over(w)).withColumn("pushed", F.count(F.lit(1)).over(W.partitionBy(*trigger)))
    return counted.where(F.col("_n") <= capacity).withColumn("dropped", F.greatest(F.col("pushed") - capacity, F.lit(0))).drop("_n")


# Which state may follow which.
TRANSITIONS = {
    "IDLE": ("STARTING", "ERROR"),
    "STARTING": ("WARMING_UP", "RUNNING", "STOPPING", "ERROR"),
    "WARMING_UP": ("RUNNING", "STOPPING", "ERROR"),
    "RUNNING": ("STOPPING", "ERROR"),
    "STOPPING": ("FINALIZING", "IDLE", "ERROR"),
    "FINALIZING": ("IDLE", "ERROR"),
    "ERROR": ("IDLE", "STARTING", "STOPPING"),
}


def illegal_transitions(df: DataFrame, group: list[str], order: list[Column], state: str) -> DataFrame:
    """Rows whose state may not follow the one before in their group; a first state is legal, a repeated one too."""
    legal = F.array(*[F.lit(f"{a}>{b}") for a, more in TRANSITIONS.items() for b in more])
    before = F.lag(state).over(W.partitionBy(*group).orderBy(*order))
    step = F.concat(F.col("previous_state"), F.lit(">"), F.col(state))
    return df.withColumn("previous_state", before).where(F.col("previous_state").isNotNull() & (F.col("previous_state") != F.col(state)) & ~F.array_contains(legal, step))
