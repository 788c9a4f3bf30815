"""Queries over detections: suppression, merging, selection, coordinates, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import boxes, gates
from furrow.operators import folds, selection
from furrow.plans.base import DETECTIONS, query

BOX = ["frame_index", "class_id", "confidence", "x1", "y1", "x2", "y2", "detection_id"]
_IOU = """(greatest(least(k.x2, x.x2) - greatest(k.x1, x.x1), 0) * greatest(least(k.y2, x.y2) - greatest(k.y1, x.y1), 0)) /
  (1600 + 1600 - greatest(least(k.x2, x.x2) - greatest(k.x1, x.x1), 0) * greatest(least(k.y2, x.y2) - greatest(k.y1, x.y1), 0))"""
_NEAR = "sqrt(pow((k.x1 + k.x2) / 2 - (x.x1 + x.x2) / 2, 2) + pow((k.y1 + k.y2) / 2 - (x.y1 + x.y2) / 2, 2)) <= {r}"


def _greedy(name: str, source: str, conflict: str) -> str:
    """CTEs that run the greedy choice rank by rank: ``name`` has the kept rows."""
    return f"""
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY frame_index, class_id ORDER BY confidence DESC, x1, y1, detection_id) AS r FROM {source}),
{name}_s AS (SELECT frame_index, class_id, 0::BIGINT AS r, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, detection_id BIGINT)[] AS kept FROM (SELECT DISTINCT frame_index, class_id FROM {source})
  UNION ALL SELECT s.frame_index, s.class_id, s.r + 1, CASE WHEN len(list_filter(s.kept, lambda k: {conflict})) > 0 THEN s.kept
    ELSE list_append(s.kept, {{'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'detection_id': x.detection_id}}) END
  FROM {name}_s s JOIN {name}_r x ON x.frame_index = s.frame_index AND x.class_id = s.class_id AND x.r = s.r + 1),
{name} AS (SELECT x.* EXCLUDE (r) FROM (SELECT frame_index, class_id, unnest(kept).detection_id AS detection_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_index, class_id ORDER BY r DESC) AS n FROM {name}_s) WHERE n = 1) s
  JOIN {name}_r x USING (frame_index, class_id, detection_id))"""


_NMS = _greedy("nms", "(SELECT * FROM d WHERE confidence >= 0.1)", f"{_IOU} > 0.5")


def _confident(d: DataFrame) -> DataFrame:
    return d.where(gates.confident(F.col("confidence"), 0.1))


@query(f"WITH RECURSIVE {_NMS} SELECT {', '.join(BOX)} FROM nms", d=DETECTIONS)
def nms_per_frame(d: DataFrame) -> DataFrame:
    return folds.suppress_overlaps(_confident(d), 0.5).select(*BOX)


@query(f"WITH RECURSIVE {_greedy('c', 'd', _NEAR.format(r=20))} SELECT {', '.join(BOX)} FROM c", d=DETECTIONS)
def center_suppression(d: DataFrame) -> DataFrame:
    return folds.suppress_close_centers(d, 20.0).select(*BOX)


@query(
    f"""WITH RECURSIVE {_NMS}, {_greedy('c', 'nms', _NEAR.format(r=20))}
SELECT raw.frame_index, raw.n AS raw, coalesce(a.n, 0) AS after_nms, coalesce(b.n, 0) AS after_center, least(coalesce(b.n, 0), 10) AS final, raw.n - least(coalesce(b.n, 0), 10) AS removed
FROM (SELECT frame_index, count(*) AS n FROM d WHERE confidence >= 0.1 GROUP BY 1) raw LEFT JOIN (SELECT frame_index, count(*) AS n FROM nms GROUP BY 1) a USING (frame_index)
LEFT JOIN (SELECT frame_index, count(*) AS n FROM c GROUP BY 1) b USING (frame_index)""",
    d=DETECTIONS,
)
def merge_pipeline_counts(d: DataFrame) -> DataFrame:
    """Boxes of each frame after each stage of the merge: confidence, overlaps, close centers, the ten most confident."""
    counts = folds.merged_counts(_confident(d), 0.5, 20.0).groupBy("frame_index").agg(*[F.sum(c).alias(c) for c in ("raw", "after_nms", "after_center")])
    final = F.least(F.col("after_center"), F.lit(10)).cast("long")
    return counts.withColumn("final", final).withColumn("removed", F.col("raw") - F.col("final"))


@query(
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY score DESC, confidence DESC, detection_id) AS position,
  count(*) OVER (PARTITION BY frame_index) AS eligible, greatest(count(*) OVER (PARTITION BY frame_index) - 5, 0) AS truncated
FROM (SELECT frame_index, confidence, detection_id, round(0.9 * confidence + 0.1 * greatest(1 - sqrt(pow((x1 + x2) / 2 - 200, 2) + pow((y1 + y2) / 2 - 100, 2)) / sqrt(50000), 0), 9) AS score FROM d WHERE confidence >= 0.25)) WHERE position <= 5""",
    d=DETECTIONS,
)
def overlay_topk(d: DataFrame) -> DataFrame:
    top = selection.overlay_top(d, 0.25, 5, 400.0, 200.0, digits=9)
    return top.select("frame_index", "confidence", "detection_id", "score", F.col("position").cast("long").alias("position"), "eligible", F.col("truncated").cast("long").alias("truncated"))


@query("SELECT frame_index, confidence, detection_id, position FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY confidence DESC, detection_id) AS position FROM d) WHERE position <= 62", d=DETECTIONS)
def pilot_top62(d: DataFrame) -> DataFrame:
    from furrow.operators.statistics import ranked

    return ranked(d, ["frame_index"], [F.desc("confidence"), F.col("detection_id")], 62, "position").select("frame_index", "confidence", "detection_id", F.col("position").cast("long").alias("position"))


_PAIR_IOU = _IOU.replace("k.", "p[j].").replace("x.", "p[i].")


@query(
    f"""WITH f AS (SELECT frame_index, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'detection_id': detection_id}} ORDER BY detection_id) AS p FROM d GROUP BY frame_index, class_id),
k AS (SELECT frame_index, p, i, unnest(range(i + 1, len(p) + 1)) AS j FROM (SELECT frame_index, p, unnest(range(1, len(p) + 1)) AS i FROM f))
SELECT frame_index, a, b, round(iou, 9) AS iou FROM (SELECT frame_index, p[i].detection_id AS a, p[j].detection_id AS b, {_PAIR_IOU} AS iou FROM k) WHERE iou >= 0.5""",
    d=DETECTIONS,
)
def box_iou_pairs(d: DataFrame) -> DataFrame:
    return folds.overlapping_pairs(d, 0.5).select("frame_index", "a", "b", F.round("iou", 9).alias("iou"))


@query(
    """WITH e AS (SELECT frame_index, detection_id, x1 + detection_id % 3 * 896 AS x1, y1 + 56 AS y1, x2 + detection_id % 3 * 896 + 100 AS x2, y2 + 56 AS y2 FROM d),
c AS (SELECT frame_index, detection_id, least(greatest(x1, 0), 1920.0) AS x1, least(greatest(y1, 0), 200.0) AS y1, least(greatest(x2, 0), 1920.0) AS x2, least(greatest(y2, 0), 200.0) AS y2 FROM e)
SELECT frame_index, detection_id, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM c WHERE x2 > x1 AND y2 > y1""",
    d=DETECTIONS,
)
def local_to_global_boxes(d: DataFrame) -> DataFrame:
    """Boxes of tiles moved to the frame and clipped; boxes outside are dropped."""
    tx, ty = F.col("detection_id") % 3 * 896, F.lit(56)
    box = boxes.clip(F.col("x1") + tx, F.col("y1") + ty, F.col("x2") + tx + 100, F.col("y2") + ty, F.lit(1920.0), F.lit(200.0))
    out = d.select("frame_index", "detection_id", box.alias("b")).where("b is not null").select("frame_index", "detection_id", "b.*")
    return out.withColumn("cx", boxes.center(F.col("x1"), F.col("x2"))).withColumn("cy", boxes.center(F.col("y1"), F.col("y2")))


def _display(mode: str) -> str:
    r = "((400.0::DOUBLE / 200) / (16.0::DOUBLE / 9))"
    u, v = "x1 / 400.0", "y1 / 200.0"
    if mode == "contain":
        u, v = f"CASE WHEN {r} < 1 THEN ({u} - 0.5) * {r} + 0.5 ELSE {u} END", f"CASE WHEN {r} > 1 THEN ({v} - 0.5) / ({r}) + 0.5 ELSE {v} END"
    if mode == "cover":
        u, v = f"CASE WHEN {r} > 1 THEN ({u} - 0.5) * {r} + 0.5 ELSE {u} END", f"CASE WHEN {r} < 1 THEN ({v} - 0.5) / ({r}) + 0.5 ELSE {v} END"
    put = lambda c: f"CAST(round_even(least(greatest(({c}) * 10000, 0), 10000.0), 0) AS INT)"
    ru = f"CASE rot WHEN 90 THEN 1 - ({v}) WHEN 180 THEN 1 - ({u}) WHEN 270 THEN {v} ELSE {u} END"
    rv = f"CASE rot WHEN 90 THEN {u} WHEN 180 THEN 1 - ({v}) WHEN 270 THEN 1 - ({u}) ELSE {v} END"
    return f"{put(ru)} AS {mode}_x, {put(rv)} AS {mode}_y"


@query(f"SELECT frame_index, detection_id, {', '.join(map(_display, ('stretch', 'contain', 'cover')))} FROM (SELECT *, detection_id % 4 * 90 AS rot FROM d)", d=DETECTIONS)
def overlay_coordinate_map(d: DataFrame) -> DataFrame:
    rot, out = F.col("detection_id") % 4 * 90, {}
    for mode in ("stretch", "contain", "cover"):
        out[f"{mode}_x"], out[f"{mode}_y"] = boxes.to_display(F.col("x1"), F.col("y1"), F.lit(400.0), F.lit(200.0), mode, rot)
    return d.withColumns(out).select("frame_index", "detection_id", *out)


@query(
    """WITH s AS (SELECT *, CASE WHEN last = 0 THEN [0] ELSE list_append(range(0, last, 896), last) END AS xs, CASE WHEN last_y = 0 THEN [0] ELSE list_append(range(0, last_y, 896), last_y) END AS ys
FROM (SELECT *, greatest(width - 1024, 0) AS last, greatest(height - 1024, 0) AS last_y FROM f))
SELECT frame_id, width, height, tile_x, tile_y, least(width, 1024) AS tile_width, least(height, 1024) AS tile_height
FROM (SELECT frame_id, width, height, CAST(unnest(xs) AS INT) AS tile_x, ys FROM s) t, LATERAL (SELECT CAST(unnest(t.ys) AS INT) AS tile_y) y""",
    f="SELECT p_partkey AS frame_id, CAST(p_partkey % 40 * 100 + 32 AS INT) AS width, CAST(p_partkey % 23 * 97 + 24 AS INT) AS height FROM {part}",
)
def tile_windows(f: DataFrame) -> DataFrame:
    return selection.tiles(f, 1024, 128)


@query(
    """SELECT frame_index, count(*) FILTER (s = 'accepted') AS accepted, count(*) FILTER (s = 'boundary_review') AS boundary_review, count(*) FILTER (s = 'outside_rejected') AS outside_rejected, count(*) AS total
FROM (SELECT frame_index, CASE WHEN NOT (x1 >= 20 AND x1 < 300) THEN 'outside_rejected' WHEN least(x1 - 20, 300 - x1) < 15 THEN 'boundary_review' ELSE 'accepted' END AS s FROM d) GROUP BY 1""",
    d=DETECTIONS,
)
def gate_status_pivot(d: DataFrame) -> DataFrame:
    status = gates.mask_gate((F.col("x1") >= 20) & (F.col("x1") < 300), F.least(F.col("x1") - 20, 300 - F.col("x1")), 15.0)
    out = d.withColumn("s", status).groupBy("frame_index").pivot("s", ["accepted", "boundary_review", "outside_rejected"]).count().fillna(0)
    return out.withColumn("total", F.col("accepted") + F.col("boundary_review") + F.col("outside_rejected"))


@query(
    """SELECT frame_index, detection_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS class_id, greatest(a, b, c) AS score FROM (SELECT *, confidence AS a, x1 / 360 AS b, y1 / 160 AS c FROM d)
WHERE greatest(a, b, c) >= 0.5""",
    d=DETECTIONS,
)
def argmax_scores(d: DataFrame) -> DataFrame:
    at, top = boxes.argmax(F.array(F.col("confidence"), F.col("x1") / 360, F.col("y1") / 160))
    return d.select("frame_index", "detection_id", at.cast("int").alias("class_id"), top.alias("score")).where(gates.confident(F.col("score"), 0.5))


@query(
    """WITH t AS (SELECT a.frame_index, a.detection_id AS prev, b.detection_id AS cur, round(sqrt(pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2)), 6) AS distance
  FROM d a JOIN d b ON b.frame_index = a.frame_index + 1 WHERE sqrt(pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2)) <= 40),
RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY distance, prev, cur) AS r FROM t),
s AS (SELECT frame_index, 0::BIGINT AS r, []::BIGINT[] AS p, []::BIGINT[] AS c, false AS took FROM (SELECT DISTINCT frame_index FROM t)
  UNION ALL SELECT s.frame_index, s.r + 1, CASE WHEN ok THEN list_append(p, prev) ELSE p END, CASE WHEN ok THEN list_append(c, cur) ELSE c END, ok
  FROM (SELECT s.*, x.prev, x.cur, NOT list_contains(s.p, x.prev) AND NOT list_contains(s.c, x.cur) AS ok FROM s JOIN r x ON x.frame_index = s.frame_index AND x.r = s.r + 1) s)
SELECT r.frame_index, prev, cur, distance FROM s JOIN r USING (frame_index, r) WHERE took""",
    d=DETECTIONS,
)
def greedy_frame_matching(d: DataFrame) -> DataFrame:
    """One-to-one matches between the boxes of successive frames, shortest first."""
    a = d.select("frame_index", F.col("detection_id").alias("prev"), F.col("x1").alias("ax"), F.col("y1").alias("ay"))
    b = d.select((F.col("frame_index") - 1).alias("frame_index"), F.col("detection_id").alias("cur"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    far = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    edges = a.join(b, "frame_index").where(far <= 40).select("frame_index", "prev", "cur", F.round(far, 6).alias("distance"))
    return folds.greedy_matching(edges, ["frame_index"]).select("frame_index", "prev", "cur", "distance")


@query(
    """SELECT k, CASE WHEN code < 0 THEN 'UNKNOWN' ELSE coalesce(m.n, 'UNKNOWN_' || code) END AS meaning,
  CASE WHEN code < 0 THEN 'UNAVAILABLE' WHEN m.n IS NULL THEN 'UNKNOWN' WHEN code >= 48 THEN 'FIXED' WHEN code >= 32 THEN 'FLOAT' WHEN code >= 16 THEN 'APPROXIMATE' WHEN code >= 1 THEN 'LOW_QUALITY' ELSE 'UNAVAILABLE' END AS quality
FROM c LEFT JOIN (VALUES """
    + ", ".join(f"({k}, '{v}')" for k, v in gates.RTK.items())
    + ") m(code, n) USING (code)",
    c="SELECT o_orderkey AS k, CAST(o_orderkey % 56 - 2 AS INT) AS code FROM {orders}",
)
def rtk_classification(c: DataFrame) -> DataFrame:
    return c.select("k", gates.rtk_meaning(F.col("code")).alias("meaning"), gates.rtk_quality(F.col("code")).alias("quality"))


@query(
    """SELECT k, CASE WHEN mask & 1 <> 0 THEN a END AS latitude, CASE WHEN mask & 2 <> 0 THEN b END AS longitude, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN a < 100000 THEN 'polygon_boundary_exclusion_buffer' WHEN mask < 3 THEN 'insufficient_visibility_opportunity' END AS rejection_reason FROM t""",
    t="SELECT o_orderkey AS k, CAST(o_orderkey % 8 AS INT) AS mask, o_totalprice AS a, o_totalprice / 7 AS b, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS c FROM {orders}",
)
def validity_and_levels(t: DataFrame) -> DataFrame:
    c = F.col
    return t.select(
        "k", gates.valid_if(c("mask"), 0, c("a")).alias("latitude"), gates.valid_if(c("mask"), 1, c("b")).alias("longitude"), gates.confidence_level(c("c")).alias("level"),
        gates.candidate_rejection(c("a"), F.lit(100000.0), c("mask"), F.lit(3)).alias("rejection_reason"),
    )
