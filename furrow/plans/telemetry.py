"""Queries over telemetry and time: synchronisation, sessions, admission, running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from furrow.operators import folds, statistics, sync
from furrow.plans.base import FRAMES, TELEMETRY, query

#: Seconds since an arbitrary start; microseconds are read by each engine's own function, so the event number stands in for the clock.
CLOCK = "SELECT event_id, user_id, event_type, value, CAST(event_id AS DOUBLE) * 37 / 10 + CAST(event_id * 17 % 11 AS DOUBLE) / 10 AS t FROM {events}"

_SYNC = """WITH b AS (SELECT f.*, x.srt_index AS bi, x.start_seconds AS bs, x.end_seconds AS be FROM f ASOF LEFT JOIN t x ON f.flight = x.flight AND f.query_time >= x.start_seconds),
a AS (SELECT b.*, y.srt_index AS ai, y.start_seconds AS sa FROM b ASOF LEFT JOIN t y ON b.flight = y.flight AND b.query_time < y.start_seconds),
m AS (SELECT *, bi IS NOT NULL AND query_time < be AS exact, greatest(query_time - be, 0) AS gb, sa - query_time AS ga FROM a),
n AS (SELECT *, CASE WHEN bi IS NOT NULL AND (ai IS NULL OR gb <= ga) THEN 'b' ELSE 'a' END AS side, CASE WHEN bi IS NOT NULL AND (ai IS NULL OR gb <= ga) THEN gb ELSE ga END AS gap FROM m),
s AS (SELECT *, CASE WHEN exact THEN bi WHEN gap <= 0.07 THEN CASE side WHEN 'b' THEN bi ELSE ai END END AS srt_index,
  CASE WHEN exact THEN bs WHEN gap <= 0.07 THEN CASE side WHEN 'b' THEN bs ELSE sa END END AS st,
  CASE WHEN exact THEN 'exact_interval' WHEN gap <= 0.07 THEN 'nearest_within_tolerance' ELSE 'missing' END AS sync_status FROM n)
"""


def _synced(f: DataFrame, t: DataFrame) -> DataFrame:
    return sync.sync_frames(f, t, ["flight"], 0.07)


@query(_SYNC + "SELECT flight, frame_index, srt_index, round(query_time - st, 9) AS delta_seconds, sync_status FROM s", f=FRAMES, t=TELEMETRY)
def asof_telemetry_sync(f: DataFrame, t: DataFrame) -> DataFrame:
    return _synced(f, t).select("flight", "frame_index", "srt_index", F.round("delta_seconds", 9).alias("delta_seconds"), "sync_status")


@query(_SYNC + "SELECT flight, frame_index, srt_index FROM s WHERE sync_status = 'exact_interval'", f=FRAMES, t=TELEMETRY)
def interval_exact_match(f: DataFrame, t: DataFrame) -> DataFrame:
    return _synced(f, t).where("sync_status = 'exact_interval'").select("flight", "frame_index", "srt_index")


@query(_SYNC + "SELECT flight, sync_status, count(*) AS n FROM s GROUP BY ALL", f=FRAMES, t=TELEMETRY)
def sync_status_counts(f: DataFrame, t: DataFrame) -> DataFrame:
    return _synced(f, t).groupBy("flight", "sync_status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT flight, frame_index, price FROM f WHERE (flight, frame_index) IN (SELECT (flight, srt_index) FROM t WHERE altitude > 50)", f=FRAMES, t=TELEMETRY)
def semi_filter_frames(f: DataFrame, t: DataFrame) -> DataFrame:
    wanted = t.where("altitude > 50").select("flight", F.col("srt_index").alias("frame_index"))
    return f.join(wanted, ["flight", "frame_index"], "left_semi").select("flight", "frame_index", "price")


@query("SELECT flight, frame_index FROM f EXCEPT SELECT flight, srt_index FROM t", f=FRAMES, t=TELEMETRY)
def anti_missing_shards(f: DataFrame, t: DataFrame) -> DataFrame:
    return f.select("flight", "frame_index").join(t.select("flight", F.col("srt_index").alias("frame_index")), ["flight", "frame_index"], "left_anti").distinct()


@query(
    """SELECT flight, frame_index, 'left' AS only_in FROM (SELECT flight, frame_index FROM f EXCEPT SELECT flight, srt_index FROM t)
UNION ALL SELECT flight, srt_index, 'right' FROM (SELECT flight, srt_index FROM t EXCEPT SELECT flight, frame_index FROM f)""",
    f=FRAMES, t=TELEMETRY,
)
def frame_set_equality(f: DataFrame, t: DataFrame) -> DataFrame:
    from furrow.operators.selection import same_keys

    return same_keys(f, t.withColumnRenamed("srt_index", "frame_index"), ["flight", "frame_index"])


@query(
    """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM e),
s AS (SELECT user_id, r, event_id, t, true AS ok, t AS last FROM r WHERE r = 1
  UNION ALL SELECT x.user_id, x.r, x.event_id, x.t, x.t - s.last >= 600, CASE WHEN x.t - s.last >= 600 THEN x.t ELSE s.last END FROM s JOIN r x ON x.user_id = s.user_id AND x.r = s.r + 1)
SELECT user_id, event_id, t FROM s WHERE ok""",
    e=CLOCK,
)
def rate_limit_fold(e: DataFrame) -> DataFrame:
    """Events 600 s or more behind the last accepted one of their user."""
    return folds.accepted_at_interval(e, ["user_id"], "t", 600.0, [F.col("t"), F.col("event_id")]).select("user_id", "event_id", "t")


@query(
    """SELECT user_id, event_id, last_value(seg IGNORE NULLS) OVER w AS reused_value, seg IS NULL AND last_value(seg IGNORE NULLS) OVER w IS NOT NULL AS reused
FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN value END AS seg FROM e) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    e=CLOCK,
)
def carry_forward_reuse(e: DataFrame) -> DataFrame:
    seg = e.withColumn("seg", F.when(F.col("event_id") % 5 == 0, F.col("value")))
    return sync.carry_forward(seg, ["user_id"], [F.col("t"), F.col("event_id")], "seg").select("user_id", "event_id", "reused_value", "reused")


@query(
    """SELECT user_id, event_id, sum(edge) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM (
SELECT *, CASE WHEN on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY t, event_id), false) THEN 1 ELSE 0 END AS edge FROM (SELECT *, event_id % 7 < 4 AS on_ FROM e))""",
    e=CLOCK,
)
def session_edges(e: DataFrame) -> DataFrame:
    return sync.sessions_by_edges(e, ["user_id"], [F.col("t"), F.col("event_id")], F.col("event_id") % 7 < 4).select("user_id", "event_id", "session")


@query(
    """SELECT user_id, event_id, sum(jump) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cluster FROM (
SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 900 THEN 1 ELSE 0 END AS jump FROM e)""",
    e=CLOCK,
)
def chain_cluster_1d(e: DataFrame) -> DataFrame:
    return sync.chain_clusters(e, ["user_id"], "t", [F.col("t"), F.col("event_id")], 900.0).select("user_id", "event_id", "cluster")


@query(
    """SELECT user_id, tick, event_id, pushed, pushed - 2 AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY user_id, tick ORDER BY event_id DESC) AS n, greatest(count(*) OVER (PARTITION BY user_id, tick), 2) AS pushed_2,
  count(*) OVER (PARTITION BY user_id, tick) AS pushed FROM (SELECT *, CAST(floor(t / 5000) AS BIGINT) AS tick FROM e)) WHERE n <= 2 AND pushed >= 2
UNION ALL SELECT user_id, tick, min(event_id), count(*), 0 FROM (SELECT *, CAST(floor(t / 5000) AS BIGINT) AS tick FROM e) GROUP BY ALL HAVING count(*) = 1""",
    e=CLOCK,
)
def latest_value_queue(e: DataFrame) -> DataFrame:
    """What a queue of two that drops its oldest keeps for each user and trigger."""
    held = e.withColumn("tick", F.floor(F.col("t") / 5000))
    return sync.latest_per_trigger(held, ["user_id", "tick"], "event_id", 2).select("user_id", "tick", "event_id", "pushed", F.col("dropped").cast("long").alias("dropped"))


@query(
    """SELECT user_id, event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW), 9) AS running_median FROM e""", e=CLOCK
)
def running_latency_median(e: DataFrame) -> DataFrame:
    return statistics.running_median(e, ["user_id"], ["t", "event_id"], "value").select("user_id", "event_id", F.round("running_median", 9).alias("running_median"))


@query(
    """WITH s AS (SELECT user_id, event_id, t, ['IDLE','STARTING','WARMING_UP','RUNNING','STOPPING','FINALIZING','ERROR'][CAST(event_id * 5 % 7 AS INT) + 1] AS state FROM e),
l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previous_state FROM s)
SELECT user_id, event_id, previous_state, state FROM l WHERE previous_state IS NOT NULL AND previous_state <> state AND (previous_state, state) NOT IN (VALUES """
    + ", ".join(f"('{a}', '{b}')" for a, more in sync.TRANSITIONS.items() for b in more)
    + ")",
    e=CLOCK,
)
def illegal_state_steps(e: DataFrame) -> DataFrame:
    states = F.array(*[F.lit(s) for s in sync.TRANSITIONS])
    held = e.withColumn("state", F.get(states, (F.col("event_id") * 5 % 7).cast("int")))
    return sync.illegal_transitions(held, ["user_id"], [F.col("t"), F.col("event_id")], "state").select("user_id", "event_id", "previous_state", "state")


@query(
    """WITH RECURSIVE r AS (SELECT user_id, event_id, 100 + event_id % 50 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e),
s AS (SELECT user_id, event_id, size, r, size AS used, 0 AS chunk FROM r WHERE r = 1
  UNION ALL SELECT x.user_id, x.event_id, x.size, x.r, CASE WHEN s.used + x.size > 1000 THEN x.size ELSE s.used + x.size END, CASE WHEN s.used + x.size > 1000 THEN s.chunk + 1 ELSE s.chunk END
  FROM s JOIN r x ON x.user_id = s.user_id AND x.r = s.r + 1)
SELECT user_id, chunk, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY ALL""",
    e=CLOCK,
)
def rotated_log_files(e: DataFrame) -> DataFrame:
    sized = e.select("user_id", "event_id", (F.col("event_id") % 50 + 100).alias("size"))
    return folds.rotated_chunks(sized, ["user_id"], "size", "event_id", 1000).groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"))


@query("SELECT user_id, event_id, snap FROM (SELECT *, lag(snap) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM (SELECT *, CAST(floor(event_id / 100) AS BIGINT) AS snap FROM e)) WHERE was IS NOT NULL AND was <> snap", e=CLOCK)
def snapshot_on_change(e: DataFrame) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("event_id")
    held = e.withColumn("snap", F.floor(F.col("event_id") / 100))
    return held.withColumn("was", F.lag("snap").over(w)).where("was <> snap").select("user_id", "event_id", "snap")
