"""Queries that run a stream to its end and return what it emitted; the SQL is that of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.plans import telemetry
from furrow.plans.base import _oracles, _queries, plain
from furrow.storage import checkpoint_root, ship
from furrow.streaming import stateful

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _finished(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run to the end of the input and read what was written; files and progress lie in the shared folder."""
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    raw = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select("event_id", "user_id", "event_type", "value", (F.col("event_id").cast("double") * 37 / 10 + (F.col("event_id") * 17 % 11).cast("double") / 10).alias("t"))


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(stateful.rate_limited(_events(spark, sf_dir), "user_id", "t", 600.0), spark).select("user_id", "event_id", "t")


def stream_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _events(spark, sf_dir).withColumn("seg", F.when(F.col("event_id") % 5 == 0, F.col("value")))
    return _finished(stateful.carried_forward(held, "user_id", "t", "seg"), spark).select("user_id", "event_id", "reused_value", "reused")


def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events captured since the start, each event once."""
    held = _events(spark, sf_dir).select("event_id", "user_id", F.timestamp_seconds("t").alias("captured"), F.timestamp_seconds(F.lit(1000)).alias("started"))
    return _finished(stateful.admitted(held, "started", "captured", "user_id", "event_id"), spark).select("user_id", "event_id")


def stream_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks built frame by frame from streamed observations: one for each plant."""
    ship(spark)
    raw = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    i = F.col("event_id")
    o = raw.select(i.alias("observation_id"), (i % 4).alias("segment_id"), F.floor(i / 400).alias("frame_index"), (F.floor(i % 400 / 4) * 30 + i % 5).cast("double").alias("x"), (i % 3).cast("double").alias("y"))
    tracks = _finished(stateful.tracked(o, "segment_id", 12.0, 3), spark).groupBy("segment_id", "track_id")
    return tracks.agg(F.min(F.floor(F.col("x") / 30)).alias("plant"), F.count(F.lit(1)).alias("observations")).select("segment_id", "plant", "observations")


def stream_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the value of their user's last click before them."""
    held = _events(spark, sf_dir)
    frames = held.where("event_type = 'view'").select("user_id", "t", "event_id")
    return _finished(stateful.with_latest(frames, held.where("event_type = 'click'"), "user_id", "t", "value"), spark).select("user_id", "event_id", "latest")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary for each session that has ended."""
    held = _events(spark, sf_dir).withColumn("on", F.col("event_id") % 7 < 4)
    return _finished(stateful.closed_sessions(held.select("user_id", "event_id", "on"), "user_id", "event_id", "on"), spark)


def stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, and how many gave way to it: the table comes in one trigger."""
    held = _events(spark, sf_dir).select("user_id", "event_id")
    return _finished(stateful.newest_only(held, "user_id", "event_id"), spark)


_queries.update({f.__name__: f for f in (stream_newest, stream_rate_limit, stream_carry_forward, stream_admission, stream_association, stream_telemetry, stream_sessions)})
_oracles["stream_newest"] = "SELECT user_id, max(event_id) AS event_id, count(*) AS pushed, count(*) - 1 AS dropped, 1::BIGINT AS popped FROM events GROUP BY user_id"
_oracles["stream_association"] = "SELECT event_id % 4 AS segment_id, CAST(floor(event_id % 400 / 4) AS BIGINT) AS plant, count(*) AS observations FROM events GROUP BY ALL"
_oracles["stream_telemetry"] = f"""WITH e AS ({plain(telemetry.CLOCK)}) SELECT f.user_id, f.event_id, c.value AS latest FROM (SELECT * FROM e WHERE event_type = 'view') f ASOF LEFT JOIN (SELECT user_id, t, value FROM e WHERE event_type = 'click') c ON f.user_id = c.user_id AND f.t >= c.t"""
_oracles["stream_sessions"] = """WITH r AS (SELECT user_id, event_id, event_id % 7 < 4 AS on_ FROM events),
s AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS k, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS following FROM r)
SELECT user_id, min(event_id) AS started, max(following) AS ended, count(*) AS records FROM s WHERE on_ GROUP BY user_id, k HAVING bool_and(following IS NOT NULL)"""
_oracles["stream_rate_limit"] = _oracles["rate_limit_fold"]
_oracles["stream_carry_forward"] = _oracles["carry_forward_reuse"]
_oracles["stream_admission"] = f"SELECT user_id, event_id FROM ({plain(telemetry.CLOCK)}) WHERE t >= 1000"
