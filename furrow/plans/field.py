"""Queries of the whole way from detections to gaps, on a made flight over the parts laid out as fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import pipelines
from furrow.operators import fusion
from furrow.plans.base import query

#: Plants 40 apart on rows 104 apart, some places empty; a plot is 20 rows of 50.
FIELD = """
SELECT p_partkey AS plant, CAST(floor(p_partkey / 1000) AS BIGINT) AS plot_id, CAST(floor(p_partkey % 1000 / 50) AS BIGINT) AS row_no,
  CAST(p_partkey % 50 * 40 AS DOUBLE) + p_partkey % 3 AS x, CAST(floor(p_partkey % 1000 / 50) * 104 + floor(p_partkey / 1000) * 5000 AS DOUBLE) + p_partkey % 5 AS y
FROM {part} WHERE p_partkey * 7 % 23 <> 0 AND p_partkey * 13 % 101 <> 0
"""
#: Each plant in four frames, each 11 and 7 further on than the one before, found twice; and one sighting that no other frame has for every 97th.
SEEN = f"""
SELECT CAST(t.f * 5 AS BIGINT) AS frame_index, 0 AS class_id, 0.9 - 0.3 * t.k AS confidence, x - 11 * t.f + t.k - 9 AS x1, y - 7 * t.f - 9 AS y1, x - 11 * t.f + t.k + 9 AS x2, y - 7 * t.f + 9 AS y2, CAST(2 * plant + t.k AS BIGINT) AS detection_id
FROM ({FIELD}) AS q CROSS JOIN (SELECT 0 AS f, 0 AS k UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 1 UNION ALL SELECT 2, 0 UNION ALL SELECT 2, 1 UNION ALL SELECT 3, 0 UNION ALL SELECT 3, 1) AS t
"""
PLOTS = "SELECT DISTINCT CAST(floor(p_partkey / 1000) AS BIGINT) AS area_id FROM {part}"
_GAPS = """s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY plot_id) AS n FROM p WINDOW w AS (PARTITION BY plot_id, row_no ORDER BY x)),
k AS (SELECT *, CAST(round(sqrt(pow(nx - x, 2) + pow(ny - y, 2)) / 40) AS BIGINT) - 1 AS m FROM s WHERE n >= 40 AND nx IS NOT NULL)"""


def _report(d: DataFrame, a: DataFrame) -> dict[str, DataFrame]:
    spark = d.sparkSession
    frames = [(5 * f, 0, [1.0, 0.0, 11.0 * f, 0.0, 1.0, 7.0 * f, 0.0, 0.0, 1.0], [1.0, 0.0, -11.0 * f, 0.0, 1.0, -7.0 * f, 0.0, 0.0, 1.0]) for f in range(4)]
    t = spark.createDataFrame(frames, "frame_index long, segment_id long, matrix array<double>, inverse array<double>")
    reach = d.agg(F.max("x2").alias("_x"), F.max("y2").alias("_y"))
    t = t.crossJoin(reach).select("*", F.lit(-1000.0).alias("x0"), F.lit(-1000.0).alias("y0"), (F.col("_x") + 1000).alias("x1"), (F.col("_y") + 1000).alias("y1")).drop("_x", "_y")
    low, high = F.col("area_id") * 5000 - 600.0, F.col("area_id") * 5000 + 4000.0
    left, right = F.lit(-600.0), F.lit(3000.0)
    areas = a.select("area_id", F.lit(0).alias("part"), F.lit(False).alias("hole"), F.array(left, right, right, left).alias("xs"), F.array(low, low, high, high).alias("ys"))
    return pipelines.gap_report(d, t, areas, pipelines.GapSettings(cell=1000.0, image=(1e9, 1e9), least_coverage=1))


@query(
    f"WITH {_GAPS} SELECT plot_id, m AS estimated_missing_plants, round((x + nx) / 2, 3) AS local_x, round((y + ny) / 2, 3) AS local_y FROM k WHERE m > 0",
    p=FIELD, d=SEEN, a=PLOTS,
)
def gap_report(p: DataFrame, d: DataFrame, a: DataFrame) -> DataFrame:
    """The gaps of the flight are the empty places between plants of a row."""
    gaps = _report(d, a)["gaps"]
    return gaps.select("plot_id", "estimated_missing_plants", F.round("local_x", 3).alias("local_x"), F.round("local_y", 3).alias("local_y"))


@query(
    f"""WITH {_GAPS}, c AS (SELECT plot_id, count(*) AS n, count(DISTINCT row_no) AS r FROM p GROUP BY plot_id), g AS (SELECT plot_id, count(*) FILTER (m > 0) AS gaps, coalesce(sum(m) FILTER (m > 0), 0) AS missing FROM k GROUP BY plot_id)
SELECT area_id AS plot_id, coalesce(n, 0) AS plants, CASE WHEN n >= 40 THEN r ELSE 0 END AS rows, CASE WHEN n >= 40 THEN r ELSE 0 END AS row_segments, coalesce(gaps, 0) AS gap_count, coalesce(missing, 0)::BIGINT AS estimated_missing_plants,
CASE WHEN n >= 40 THEN n + coalesce(missing, 0) ELSE 0 END::BIGINT AS expected_capacity, CASE WHEN n >= 40 THEN 'complete_candidate_review_required' ELSE 'insufficient_unique_plants' END AS analysis_status
FROM a LEFT JOIN c ON c.plot_id = area_id LEFT JOIN g ON g.plot_id = area_id""",
    p=FIELD, d=SEEN, a=PLOTS,
)
def plot_summaries(p: DataFrame, d: DataFrame, a: DataFrame) -> DataFrame:
    """The flight's plots: plants, rows, places and what is missing of them."""
    return _report(d, a)["summary"].select("plot_id", "plants", "rows", "row_segments", "gap_count", "estimated_missing_plants", "expected_capacity", "analysis_status")


_STILL = "SELECT o_orderkey AS observation_id, o_orderkey % 4 AS segment_id, CAST(floor(o_orderkey / 400) * 10 AS BIGINT) AS frame_index, CAST(floor(o_orderkey % 400 / 4) AS DOUBLE) * 30 AS x, 0.0::DOUBLE AS y FROM {orders}"


@query("SELECT segment_id, CAST(x / 30 AS BIGINT) AS place, count(*) AS observations FROM o GROUP BY ALL", o=_STILL.replace("0.0::DOUBLE", "CAST(0 AS DOUBLE)"))
def tracks_over_sparse_frames(o: DataFrame) -> DataFrame:
    """Frames are ten numbers apart; a track's age counts processed frames, so what stands still is one track."""
    every = o.select("segment_id", "frame_index").distinct()
    tracks = fusion.associate(o, 12.0, 3, frames=every).groupBy("segment_id", "track_id")
    return tracks.agg((F.min("x") / 30).cast("long").alias("place"), F.count(F.lit(1)).alias("observations")).select("segment_id", "place", "observations")


