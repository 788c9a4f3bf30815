"""Queries of rows, slots, gaps, fusion and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import gates
from furrow.operators import fusion, records, rows, selection
from furrow.plans.base import PLANTS, POINTS, query
from furrow.plans.statistics import ROUND
from furrow.storage import checkpointed

PLOTS = "SELECT DISTINCT CAST(floor(p_partkey / 1000) AS BIGINT) AS plot_id FROM {part}"
_SPACING = "sp AS (SELECT DISTINCT plot_id, 40.0::DOUBLE AS spacing FROM pl)"
_EXPECTED = f"""{_SPACING},
st AS (SELECT *, lead(along) OVER w AS la, lead(across) OVER w AS lc, row_number() OVER w AS rn FROM pl WINDOW w AS (PARTITION BY plot_id, row_id ORDER BY along, plant_id)),
sn AS (SELECT *, CASE WHEN la IS NULL THEN 0 ELSE greatest(1, CAST(round_even(sqrt(pow(la - along, 2) + pow(lc - across, 2)) / 40, 0) AS INT)) END AS n FROM st),
sf AS (SELECT *, CAST(sum(n) OVER (PARTITION BY plot_id, row_id ORDER BY along, plant_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS start FROM sn),
ex AS (SELECT plot_id, row_id, start + k AS slot_index, along + CASE WHEN n > 0 THEN k / n ELSE 0 END * coalesce(la - along, 0) AS along, across + CASE WHEN n > 0 THEN k / n ELSE 0 END * coalesce(lc - across, 0) AS across
  FROM (SELECT *, unnest(range(CASE WHEN rn = 1 THEN 0 ELSE 1 END, n + 1)) AS k FROM sf)),
ms AS (SELECT * FROM ex x WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.plot_id = x.plot_id AND sqrt(pow(pl.along - x.along, 2) + pow(pl.across - x.across, 2)) <= 18))"""


def _spacing(pl: DataFrame) -> DataFrame:
    return pl.select("plot_id", F.lit(40.0).alias("spacing")).distinct()


def _missing(pl: DataFrame) -> DataFrame:
    sp = _spacing(pl)
    return rows.missing_slots(rows.expected_slots(pl, sp), pl, sp)


def _enriched(pl: DataFrame) -> DataFrame:
    c = lambda d: F.pmod(F.col("slot_index") * 7 + F.col("row_id") * 3, F.lit(d))
    return _missing(pl).withColumn("coverage_count", c(9)).withColumn("nearby_suspicious_count", (c(5) == 0).cast("long")).withColumn("confidence", c(10) / 10)


_RICH = f"""{_EXPECTED}, rich AS (SELECT *, (slot_index * 7 + row_id * 3) % 9 AS coverage_count, CASE WHEN (slot_index * 7 + row_id * 3) % 5 = 0 THEN 1 ELSE 0 END AS nearby_suspicious_count, (slot_index * 7 + row_id * 3) % 10 / 10 AS confidence FROM ms),
gp AS (SELECT plot_id, row_id, min(slot_index) AS start_slot, max(slot_index) AS end_slot, count(*) AS estimated_missing_plants, round(avg(along), 6) AS along, round(avg(across), 6) AS across, min(coverage_count) AS coverage_count,
  CAST(sum(nearby_suspicious_count) AS BIGINT) AS nearby_suspicious_count, round(avg(confidence), 6) AS gap_confidence FROM (SELECT *, slot_index - row_number() OVER (PARTITION BY plot_id, row_id ORDER BY slot_index) AS run FROM rich) GROUP BY plot_id, row_id, run),
gs AS (SELECT *, CASE WHEN nearby_suspicious_count > 0 THEN 'review_near_suspicious_support' WHEN gap_confidence >= 0.8 THEN 'high_candidate' WHEN gap_confidence >= 0.5 THEN 'medium_candidate' ELSE 'low_candidate_review' END AS evidence_status FROM gp)"""


def _gaps(pl: DataFrame) -> DataFrame:
    found = ROUND(rows.gaps(_enriched(pl)), "along", "across", "gap_confidence")
    return found.withColumn("evidence_status", gates.gap_evidence(F.col("nearby_suspicious_count"), F.col("gap_confidence")))


@query(f"WITH {_EXPECTED} SELECT plot_id, row_id, slot_index, round(along, 6) AS along, round(across, 6) AS across FROM ex", pl=PLANTS)
def expected_slots(pl: DataFrame) -> DataFrame:
    return ROUND(rows.expected_slots(pl, _spacing(pl)), "along", "across")


@query(f"WITH {_EXPECTED} SELECT plot_id, row_id, slot_index FROM ms", pl=PLANTS)
def missing_slots(pl: DataFrame) -> DataFrame:
    return _missing(pl).select("plot_id", "row_id", "slot_index")


@query(f"WITH {_EXPECTED} SELECT plot_id, row_id, slot_index, slot_index - row_number() OVER (PARTITION BY plot_id, row_id ORDER BY slot_index) AS run FROM ms", pl=PLANTS)
def islands_consecutive_slots(pl: DataFrame) -> DataFrame:
    return rows.runs(_missing(pl), ["plot_id", "row_id"]).select("plot_id", "row_id", "slot_index", "run")


@query(f"WITH {_RICH} SELECT * FROM gs", pl=PLANTS)
def gap_rollup(pl: DataFrame) -> DataFrame:
    return _gaps(pl)


@query(f"WITH {_RICH} SELECT count(*) AS gaps, CAST(sum(estimated_missing_plants) AS BIGINT) AS missing_plants, round(avg(gap_confidence), 5) AS mean_confidence, count(*) FILTER (evidence_status LIKE 'review%') AS in_review FROM gs", pl=PLANTS)
def gap_summary(pl: DataFrame) -> DataFrame:
    return _gaps(pl).agg(
        F.count(F.lit(1)).alias("gaps"), F.sum("estimated_missing_plants").alias("missing_plants"), F.round(F.avg("gap_confidence"), 5).alias("mean_confidence"),
        F.count_if(F.col("evidence_status").like("review%")).alias("in_review"),
    )


@query(
    f"""WITH {_RICH} SELECT o.plot_id, coalesce(p.plants, 0) AS plants, coalesce(p.rows, 0) AS rows, coalesce(e.n, 0) AS expected_capacity, coalesce(g.n, 0) AS gap_count, coalesce(g.m, 0) AS estimated_missing_plants,
round(coalesce(g.m, 0) / nullif(coalesce(e.n, 0), 0), 9) AS missing_rate, CASE WHEN coalesce(p.plants, 0) < 3 THEN 'insufficient_unique_plants' ELSE 'complete_candidate_review_required' END AS analysis_status
FROM plots o LEFT JOIN (SELECT plot_id, count(*) AS plants, count(DISTINCT row_id) AS rows FROM pl GROUP BY 1) p USING (plot_id) LEFT JOIN (SELECT plot_id, count(*) AS n FROM ex GROUP BY 1) e USING (plot_id)
LEFT JOIN (SELECT plot_id, count(*) AS n, CAST(sum(estimated_missing_plants) AS BIGINT) AS m FROM gs GROUP BY 1) g USING (plot_id)""",
    pl=PLANTS, plots=PLOTS,
)
def missing_rate(pl: DataFrame, plots: DataFrame) -> DataFrame:
    out = rows.plot_summary(plots, pl, rows.expected_slots(pl, _spacing(pl)), _gaps(pl))
    return out.withColumn("missing_rate", F.round("missing_rate", 9))


@query(
    f"""WITH {_RICH}, gi AS (SELECT *, plot_id || '_' || row_id || '_' || start_slot AS gap_id FROM gs),
a AS (SELECT gap_id, 0 AS f, row_number() OVER (ORDER BY estimated_missing_plants DESC, gap_confidence DESC, gap_id) AS n FROM gi QUALIFY n <= 10),
b AS (SELECT gap_id, 1 AS f, row_number() OVER (PARTITION BY evidence_status ORDER BY gap_confidence DESC, gap_id) AS n FROM gi QUALIFY n <= 5),
c AS (SELECT gap_id, 2 AS f, row_number() OVER (ORDER BY gap_confidence, gap_id) AS n FROM gi QUALIFY n <= 40),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY f, n) AS k FROM (FROM a UNION ALL FROM b UNION ALL FROM c)) WHERE k = 1)
SELECT gap_id, estimated_missing_plants, gap_confidence, evidence_status, f AS priority FROM u JOIN gi USING (gap_id) ORDER BY f, n, evidence_status, gap_id LIMIT 40""",
    pl=PLANTS,
)
def evidence_selection(pl: DataFrame) -> DataFrame:
    """The gaps that a reviewer should see: a report, so limited by purpose."""
    g = _gaps(pl).withColumn("gap_id", F.concat_ws("_", F.col("plot_id").cast("string"), F.col("row_id").cast("string"), F.col("start_slot").cast("string")))
    return selection.evidence(g.select("gap_id", "estimated_missing_plants", "gap_confidence", "evidence_status"))


@query(
    f"""WITH {_RICH} SELECT plot_id || '_' || row_id || '_' || start_slot AS gap_id, estimated_missing_plants, gap_confidence FROM gs ORDER BY estimated_missing_plants DESC, gap_confidence DESC, gap_id LIMIT 25""", pl=PLANTS
)
def labelled_gaps(pl: DataFrame) -> DataFrame:
    """The 25 gaps that a map labels: a report, so limited by purpose."""
    g = _gaps(pl).withColumn("gap_id", F.concat_ws("_", F.col("plot_id").cast("string"), F.col("row_id").cast("string"), F.col("start_slot").cast("string")))
    return records.largest_gaps(g.select("gap_id", "estimated_missing_plants", "gap_confidence"))


@query(
    f"""WITH {_RICH}, rj AS (SELECT plot_id, plot_id || '_' || row_id || '_' || slot_index AS candidate_id, CASE WHEN across < 120 THEN 'polygon_boundary_exclusion_buffer' WHEN coverage_count < 3 THEN 'insufficient_visibility_opportunity' END AS rejection_reason, round(across / 60, 6) AS boundary_fraction FROM rich),
o AS (SELECT *, row_number() OVER (PARTITION BY rejection_reason, plot_id ORDER BY boundary_fraction, candidate_id) AS n FROM rj WHERE rejection_reason IS NOT NULL)
SELECT rejection_reason, plot_id, candidate_id, boundary_fraction, position FROM (SELECT *, row_number() OVER (PARTITION BY rejection_reason ORDER BY boundary_fraction, candidate_id) AS position FROM o WHERE n = 1) WHERE position <= 8""",
    pl=PLANTS,
)
def rejected_first_per_plot(pl: DataFrame) -> DataFrame:
    held = _enriched(pl).withColumn("rejection_reason", gates.candidate_rejection(F.col("across"), F.lit(120.0), F.col("coverage_count"), F.lit(3)))
    held = held.where("rejection_reason is not null").withColumn("boundary_fraction", F.round(F.col("across") / 60, 6))
    held = held.withColumn("candidate_id", F.concat_ws("_", F.col("plot_id").cast("string"), F.col("row_id").cast("string"), F.col("slot_index").cast("string")))
    return selection.first_rejected(held.select("rejection_reason", "plot_id", "candidate_id", "boundary_fraction")).withColumn("position", F.col("position").cast("long"))


@query(
    """WITH e AS (SELECT plot_id, row_id, min(along) AS lo, max(along) AS hi, avg(across) AS across FROM pl GROUP BY ALL)
SELECT plot_id, row_id, k AS slot_index, round(lo + k * 40.0, 6) AS along, round(across, 6) AS across FROM (SELECT *, unnest(range(1, CAST(round_even((hi - lo) / 40, 0) AS BIGINT))) AS k FROM e)""",
    pl=PLANTS,
)
def live_expected_slots(pl: DataFrame) -> DataFrame:
    return ROUND(rows.live_slots(pl, _spacing(pl)), "along", "across")


@query("SELECT plant_id, plot_id, row_id AS row_id FROM pl", pl=PLANTS)
def row_reconstruction(pl: DataFrame) -> DataFrame:
    """Rows found from the density over the across coordinate are the rows that the fixture was laid out in."""
    found = rows.row_bands(pl.drop("row_id"), 2.0, 60.0)
    return found.select("plant_id", "plot_id", F.col("row_id").cast("long").alias("row_id"))


@query(
    """SELECT plot_id, row_id, plant_id, segment FROM (SELECT *, count(*) OVER (PARTITION BY plot_id, row_id, segment) AS n FROM (
  SELECT *, CAST(sum(cut) OVER (PARTITION BY plot_id, row_id ORDER BY along, plant_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM (
    SELECT *, CASE WHEN lag(bad) OVER (PARTITION BY plot_id, row_id ORDER BY along, plant_id) THEN 1 ELSE 0 END AS cut FROM (
      SELECT *, coalesce(lead(along) OVER (PARTITION BY plot_id, row_id ORDER BY along, plant_id) > 1000 AND along <= 1060, false) AS bad FROM pl)))) WHERE n >= 2""",
    pl=PLANTS,
)
def split_rows_at_boundary(pl: DataFrame) -> DataFrame:
    """Rows are cut where a step passes the strip from 1000 to 1060, tested at 21 points of each step."""
    s = rows.samples_between(pl, 421)
    inside = s.groupBy("plot_id", "row_id", "plant_id").agg(F.min(~((F.col("x") > 1000) & (F.col("x") <= 1060))).alias("ok"))
    return rows.split_rows(pl, inside).select("plot_id", "row_id", "plant_id", "segment")


_OBSERVED = "SELECT id, CAST(floor(id / 7) AS BIGINT) AS plant, id % 50 AS frame_index, x, y, w AS confidence FROM (" + POINTS + ") AS q"


@query(
    """WITH m AS (SELECT plant, count(*) AS observation_count, min(frame_index) AS first_frame, max(frame_index) AS last_frame, round(avg(confidence), 9) AS mean_confidence, max(confidence) AS max_confidence, count(DISTINCT frame_index) AS temporal_support FROM o GROUP BY plant),
x AS (SELECT plant, min(x) AS local_x FROM (SELECT *, sum(ww) OVER (PARTITION BY plant ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(ww) OVER (PARTITION BY plant) AS total FROM (SELECT *, greatest(confidence, 1e-6) AS ww FROM o)) WHERE run >= 0.5 * total GROUP BY plant),
y AS (SELECT plant, min(y) AS local_y FROM (SELECT *, sum(ww) OVER (PARTITION BY plant ORDER BY y, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(ww) OVER (PARTITION BY plant) AS total FROM (SELECT *, greatest(confidence, 1e-6) AS ww FROM o)) WHERE run >= 0.5 * total GROUP BY plant)
SELECT * FROM m JOIN x USING (plant) JOIN y USING (plant)""",
    o=_OBSERVED,
)
def unique_plant_aggregate(o: DataFrame) -> DataFrame:
    return ROUND(fusion.unique_plants(o.withColumnRenamed("id", "observation_id"), ["plant"])).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(
    "SELECT id, CASE WHEN n >= 2 THEN 'confirmed' WHEN n = 1 AND seen <= 1 THEN 'boundary_singleton' WHEN n = 1 AND seen >= 3 THEN 'suspicious_singleton' ELSE 'low_support' END AS support_status FROM (SELECT id, id % 3 AS n, id % 5 AS seen FROM p)",
    p=POINTS,
)
def support_status(p: DataFrame) -> DataFrame:
    return p.select("id", gates.support_status(F.col("id") % 3, F.col("id") % 5).alias("support_status"))


@query("SELECT count(*) AS suppressed FROM (SELECT plot_id, row_id, slot_index FROM ex WHERE slot_index % 7 = 0 EXCEPT SELECT plot_id, row_id, slot_index FROM ms)".replace("SELECT count", f"WITH {_EXPECTED} SELECT count", 1), pl=PLANTS)
def set_difference_ids(pl: DataFrame) -> DataFrame:
    """Expected slots of every seventh place that aren't missing."""
    keys = ["plot_id", "row_id", "slot_index"]
    every = rows.expected_slots(pl, _spacing(pl)).where("slot_index % 7 = 0").select(*keys).distinct()
    return every.join(_missing(pl).select(*keys).hint("merge"), keys, "left_anti").agg(F.count(F.lit(1)).alias("suppressed"))


_FITS = "SELECT o_orderkey AS k, CAST(o_orderkey % 40 AS INT) AS m, CAST(o_orderkey % 30 AS INT) AS i, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS r, CAST(o_orderkey % 7 AS DOUBLE) AS e, 0.9 + CAST(o_orderkey % 5 AS DOUBLE) / 20 AS s, CAST(o_orderkey % 13 AS DOUBLE) - 6 AS d FROM {orders}"


@query(
    """SELECT k, coalesce(nullif(concat_ws('|', CASE WHEN m < 12 THEN 'too_few_matches' END, CASE WHEN i < 8 THEN 'too_few_inliers' END, CASE WHEN r < 0.4 THEN 'low_inlier_ratio' END, CASE WHEN e > 4 THEN 'high_reprojection_error' END,
CASE WHEN NOT (s BETWEEN 0.92 AND 1.08) THEN 'implausible_scale' END, CASE WHEN abs(d) > 5 THEN 'implausible_rotation' END), ''), 'accepted') AS gate_reasons FROM t""",
    t=_FITS,
)
def registration_gate(t: DataFrame) -> DataFrame:
    names = {"m": "match_count", "i": "inlier_count", "r": "inlier_ratio", "e": "reprojection_error_p95", "s": "scale", "d": "rotation_deg"}
    limits = {"min_mutual_matches": 12, "min_inliers": 8, "min_inlier_ratio": 0.4, "max_p95_reprojection": 4.0, "min_scale": 0.92, "max_scale": 1.08, "max_rotation_deg": 5.0}
    return fusion.registration_gate(t.withColumnsRenamed(names), limits).select("k", "gate_reasons")


@query(
    """SELECT k, coalesce(nullif(concat_ws('|', CASE WHEN r < 0.2 THEN 'flight_path_cross_track_geometry_underconstrained' END, CASE WHEN e > 4 THEN 'high_pose_alignment_residual' END, CASE WHEN abs(s - 1) > 0.06 THEN 'visual_scale_disagrees_with_assumed_camera_profile' END,
CASE WHEN d < -2 OR r < 0.1 THEN 'visual_motion_direction_inconsistent_with_gps' END, CASE WHEN m % 2 = 0 THEN 'camera_not_verified_near_nadir' END), ''), 'accepted') AS gate_reasons FROM t""",
    t=_FITS,
)
def georeference_gate(t: DataFrame) -> DataFrame:
    c = F.col
    fits = t.select("k", c("r").alias("cross_track_ratio"), c("e").alias("p95_residual"), F.abs(c("s") - 1).alias("scale_disagreement"), c("d").alias("direction_p50"), c("r").alias("positive_direction"), (c("m") % 2 != 0).alias("near_nadir"))
    limits = {"min_cross_track_ratio": 0.2, "max_p95_residual": 4.0, "max_scale_disagreement": 0.06, "min_direction_p50": -2.0, "min_positive_direction": 0.1}
    return fusion.georeference_gate(fits, limits).select("k", "gate_reasons")


_TRACKED = "SELECT event_id AS observation_id, event_id % 4 AS segment_id, CAST(floor(event_id / 400) AS BIGINT) AS frame_index, CAST(floor(event_id % 400 / 4) AS DOUBLE) * 30 + event_id % 5 AS x, CAST(event_id % 3 AS DOUBLE) AS y FROM {events}"


@query(
    """WITH s AS (SELECT *, CAST(floor(x / 30) AS BIGINT) AS plant FROM o), f AS (SELECT segment_id, plant, min(frame_index) AS frame, arg_min(observation_id, frame_index) AS obs FROM s GROUP BY ALL),
t AS (SELECT segment_id, plant, row_number() OVER (PARTITION BY segment_id ORDER BY frame, obs) - 1 AS track_id FROM f)
SELECT segment_id, frame_index, observation_id, track_id FROM s JOIN t USING (segment_id, plant)""",
    o=_TRACKED,
)
def track_association(o: DataFrame) -> DataFrame:
    """Tracks of 100 plants a segment that move by a few pixels between frames, numbered as they begin. Tests hold scenes that are less tidy against brute force."""
    return fusion.associate(o, 12.0, 3).select("segment_id", "frame_index", "observation_id", "track_id")


@query("SELECT segment_id, CAST(floor(x / 30) AS BIGINT) AS plant, count(*) AS observations FROM o GROUP BY ALL", o=_TRACKED)
def tracks_are_plants(o: DataFrame) -> DataFrame:
    """Each track has the observations of one plant, and each plant one track."""
    tracks = fusion.associate(o, 12.0, 3).groupBy("segment_id", "track_id").agg(F.min(F.floor(F.col("x") / 30)).alias("plant"), F.count(F.lit(1)).alias("observations"))
    return tracks.select("segment_id", "plant", "observations")


@query("SELECT segment_id, CAST(floor(x / 30) AS BIGINT) AS place, count(*) AS observations FROM o GROUP BY ALL", o=_TRACKED)
def tracklet_merging(o: DataFrame) -> DataFrame:
    """A radius of one breaks every track each third frame; the pieces of a plant share no frame and are merged again."""
    seen = checkpointed(fusion.associate(o, 1.0, 1))
    middle = seen.groupBy("segment_id", "track_id").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    plants = seen.join(fusion.merged_within(middle, seen, 6.0), ["segment_id", "track_id"]).groupBy("segment_id", "plant")
    return plants.agg(F.min(F.floor(F.col("x") / 30)).alias("place"), F.count(F.lit(1)).alias("observations")).select("segment_id", "place", "observations")


@query("SELECT plot_id, round(quantile_cont(step, 0.5), 6) AS spacing FROM (SELECT plot_id, along - lag(along) OVER (PARTITION BY plot_id, row_id ORDER BY along, plant_id) AS step FROM pl) WHERE step > 0 GROUP BY plot_id", pl=PLANTS)
def along_row_spacing(pl: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    step = F.col("along") - F.lag("along").over(W.partitionBy("plot_id", "row_id").orderBy("along", "plant_id"))
    return ROUND(pl.withColumn("step", step).where("step > 0").groupBy("plot_id").agg(F.median("step").alias("spacing")), "spacing")

