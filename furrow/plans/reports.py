"""Queries of the smaller reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import gates
from furrow.functions.boxes import iou
from furrow.operators import fusion, reports
from furrow.plans.base import DETECTIONS, FRAMES, POINTS, query
from furrow.plans.statistics import ROUND
from furrow.sinks import files

_CELLS = "SELECT DISTINCT g, CAST(floor(x / 4) AS BIGINT) AS px, CAST(floor(y / 4) AS BIGINT) AS py FROM (" + POINTS + ") AS q"


@query("SELECT g, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM p GROUP BY g", p=POINTS)
def extents(p: DataFrame) -> DataFrame:
    return reports.extents(p, ["g"], "x", "y")


@query("SELECT g, bin, round(atan2(avg(sin(x / 10)), avg(cos(x / 10))), 6) AS mean_phase, round(sqrt(pow(avg(sin(x / 10)), 2) + pow(avg(cos(x / 10)), 2)), 6) AS resultant FROM (SELECT *, CAST(floor(y / 100) AS BIGINT) AS bin FROM p) GROUP BY ALL", p=POINTS)
def circular_phase_mean(p: DataFrame) -> DataFrame:
    held = p.withColumn("bin", F.floor(F.col("y") / 100)).withColumn("phase", F.col("x") / 10)
    return ROUND(reports.circular_mean(held, ["g", "bin"], "phase"), "mean_phase", "resultant")


@query(
    """WITH k AS (SELECT g, id AS t, v FROM p WHERE kind = 'click'), b AS (SELECT p.g, p.id, k.t AS bt, k.v AS bv FROM p ASOF LEFT JOIN k ON p.g = k.g AND p.id >= k.t),
a AS (SELECT b.*, k.t AS at_, k.v AS av FROM b ASOF LEFT JOIN k ON b.g = k.g AND b.id <= k.t)
SELECT g, id, round(CASE WHEN bt IS NULL THEN av WHEN at_ IS NULL THEN bv ELSE bv + CASE WHEN at_ > bt THEN (id - bt) / (at_ - bt) ELSE 0 END * (av - bv) END, 6) AS value FROM a""",
    p=POINTS,
)
def interpolated_drift(p: DataFrame) -> DataFrame:
    """Values between the knots around each point; clicks are the knots."""
    knots = p.where("kind = 'click'").select("g", "id", F.col("v").alias("value"))
    return ROUND(reports.interpolated(p.select("g", "id"), knots, ["g"], "id"), "value").select("g", "id", "value")


@query(
    """SELECT gap_id, frame_index, round(d, 6) AS distance FROM (SELECT a.id AS gap_id, b.id AS frame_index, sqrt(pow(a.x - (b.x + 60), 2) + pow(a.y - (b.y + 40), 2)) AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - (b.x + 60), 2) + pow(a.y - (b.y + 40), 2)), b.id) AS n FROM p a JOIN p b ON a.kind = 'click' AND b.kind <> 'click' AND a.x >= b.x AND a.x < b.x + 120 AND a.y >= b.y AND a.y < b.y + 80) WHERE n = 1""",
    p=POINTS,
)
def most_central_frame(p: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    frames = p.where("kind <> 'click'").select(F.col("id").alias("frame_index"), x.alias("x0"), y.alias("y0"), (x + 120).alias("x1"), (y + 80).alias("y1"), (x + 60).alias("cx"), (y + 40).alias("cy"))
    return ROUND(reports.central_frames(p.where("kind = 'click'").select(F.col("id").alias("gap_id"), "x", "y"), frames, 120.0), "distance")


@query("SELECT a.g AS area_id, b.g AS other_id, count(*) AS shared FROM c a JOIN c b USING (px, py) WHERE a.g < b.g GROUP BY ALL", c=_CELLS.replace("/ 4)", "/ 50)"))
def polygon_overlap_pairs(c: DataFrame) -> DataFrame:
    return reports.overlapping_areas(c.withColumnRenamed("g", "area_id"))


@query(
    """WITH RECURSIVE r AS (SELECT g, px, py, px AS rx, py AS ry FROM c UNION SELECT r.g, n.px, n.py, r.rx, r.ry FROM r JOIN c n ON n.g = r.g AND abs(n.px - r.px) <= 1 AND abs(n.py - r.py) <= 1),
m AS (SELECT g, px, py, min({'x': rx, 'y': ry}) AS k FROM r GROUP BY ALL) SELECT g, px, py, k.x AS root_x, k.y AS root_y FROM m""",
    c=_CELLS,
)
def connected_raster(c: DataFrame) -> DataFrame:
    return reports.connected_cells(c, ["g"])


@query(
    """WITH m AS (SELECT frame_index, detection_id, least(greatest(x1, 1.0), 350.0) AS ax FROM d), j AS (SELECT d.frame_index, abs(d.x1 - ax) AS box_error, abs(d.confidence - d.confidence * 0.999) AS confidence_error, (40 - abs(d.x1 - ax)) * 40 / (3200 - (40 - abs(d.x1 - ax)) * 40) AS iou FROM d JOIN m USING (frame_index, detection_id))
SELECT frame_index, count(*) AS matches, round(max(box_error), 6) AS max_box_error, round(max(confidence_error), 6) AS max_confidence_error, round(avg(iou), 6) AS mean_iou, max(box_error) <= 5 AND max(confidence_error) <= 0.01 AS passed FROM j GROUP BY 1""",
    d=DETECTIONS,
)
def detector_parity(d: DataFrame) -> DataFrame:
    """Boxes against a second detector's, which are the same ones a little shifted at the edges."""
    ax = F.least(F.greatest(F.col("x1"), F.lit(1.0)), F.lit(350.0))
    other = F.struct(ax.alias("x1"), F.col("y1"), (ax + 40).alias("x2"), F.col("y2"))
    m = d.select("frame_index", iou(F.struct("x1", "y1", "x2", "y2"), other).alias("iou"), F.abs(F.col("x1") - ax).alias("box_error"), F.abs(F.col("confidence") - F.col("confidence") * 0.999).alias("confidence_error"))
    return ROUND(reports.parity(m, ["frame_index"], 5.0, 0.01), "max_box_error", "max_confidence_error", "mean_iou")


@query(
    """WITH s AS (SELECT flight, min(frame_index) AS a, max(frame_index) AS b, quantile_disc(frame_index, 0.5) AS c FROM f GROUP BY 1),
k AS (SELECT flight, frame_index, row_number() OVER (PARTITION BY flight ORDER BY price DESC, frame_index) AS hi, row_number() OVER (PARTITION BY flight ORDER BY price, frame_index) AS lo FROM f)
SELECT flight, a AS frame_index FROM s UNION SELECT flight, b FROM s UNION SELECT flight, c FROM s UNION SELECT flight, frame_index FROM k WHERE hi = 1 OR lo = 1""",
    f=FRAMES,
)
def notable_frames(f: DataFrame) -> DataFrame:
    return reports.notable_frames(f, ["flight"], "frame_index", "price")


@query("SELECT flight, frame_index FROM (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY frame_index) - 1 AS i, count(*) OVER (PARTITION BY flight) // 2 AS m FROM f) WHERE i < 12 OR (i >= m AND i < m + 12)", f=FRAMES)
def smoke_sampling(f: DataFrame) -> DataFrame:
    """A sampling operator: two windows of twelve frames of each flight."""
    return reports.sampled_windows(f, ["flight"], "frame_index", 12).select("flight", "frame_index")


@query("SELECT g, round(d, 6) AS min_distance FROM (SELECT a.g, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM p a JOIN p b ON a.g = b.g AND b.id >= a.id + 120 GROUP BY a.g)", p=POINTS)
def nonadjacent_distance(p: DataFrame) -> DataFrame:
    """How near each path comes to itself; points of a group are four ids apart, so 120 ids are 30 places."""
    return ROUND(reports.nonadjacent_minimum(p.select("g", "id", "x", "y"), ["g"], "id", 120.0, 120), "min_distance")


@query("SELECT kind, id, previous FROM (SELECT kind, id, lag(id) OVER (PARTITION BY kind ORDER BY id) AS previous FROM p) WHERE previous IS NOT NULL AND id <> previous + 1", p=POINTS)
def sequence_breaks(p: DataFrame) -> DataFrame:
    return reports.breaks(p.select("kind", "id"), ["kind"], "id")


@query("SELECT id, x, y, kind FROM p", p=POINTS)
def geojson_round_trip(p: DataFrame) -> DataFrame:
    """Point features written as JSON and read again."""
    text = files.point_features(p, "x", "y", ["id", "kind"])
    parsed = text.select(F.from_json("value", "properties struct<id:long,kind:string>, geometry struct<coordinates:array<double>>").alias("f"))
    return parsed.select("f.properties.id", F.get("f.geometry.coordinates", F.lit(0)).alias("x"), F.get("f.geometry.coordinates", F.lit(1)).alias("y"), "f.properties.kind")


_WARNED = "SELECT event_id, concat(event_type, CASE event_id % 6 WHEN 0 THEN ' CUDA error' WHEN 1 THEN ': Out of Memory' WHEN 2 THEN ' engine deserialization' ELSE ' slow frame' END) AS warning, CAST(event_id % 100 AS DOUBLE) AS width, CAST(event_id % 90 AS DOUBLE) AS cx FROM {events}"


@query(
    """SELECT event_id, regexp_matches(lower(warning), 'cuda|tensorrt|out of memory|engine deserial') AS fatal,
CASE WHEN width >= 38 THEN 'main_planted_block' WHEN cx < 50 THEN 'left_side_planted_strip' ELSE 'right_side_planted_strip' END AS category FROM e""",
    e=_WARNED,
)
def warning_and_component_predicates(e: DataFrame) -> DataFrame:
    return e.select("event_id", gates.fatal_warning(F.col("warning")).alias("fatal"), gates.component_category(F.col("width"), F.col("cx"), F.lit(100.0)).alias("category"))


@query("SELECT frame_index, round(avg(ms), 9) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM (SELECT frame_index, confidence * 100 AS ms FROM d) GROUP BY 1", d=DETECTIONS)
def tile_timing(d: DataFrame) -> DataFrame:
    ms = F.col("confidence") * 100
    return d.groupBy("frame_index").agg(F.round(F.avg(ms), 9).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))


@query("SELECT wanted, price FROM (SELECT k AS wanted FROM f WHERE status = 'F') w JOIN (SELECT k, price FROM f) i ON k = wanted", f=FRAMES)
def index_lookup(f: DataFrame) -> DataFrame:
    """Rows looked up by number; a number without its row is an error."""
    return reports.looked_up(f.where("status = 'F'").select(F.col("k").alias("wanted")), f.select("k", "price"), "wanted", "k")


@query("SELECT CAST(floor(id / 7) AS BIGINT) AS plant, count(*) AS observations, median(x) AS local_x, median(y) AS local_y, max(w) AS max_confidence, round(avg(w), 9) AS mean_confidence, min(id % 50) AS first_frame, max(id % 50) AS last_frame FROM p GROUP BY 1", p=POINTS)
def live_plant_aggregate(p: DataFrame) -> DataFrame:
    """The streaming variant of plants: plain medians."""
    return p.groupBy(F.floor(F.col("id") / 7).alias("plant")).agg(
        F.count(F.lit(1)).alias("observations"), F.median("x").alias("local_x"), F.median("y").alias("local_y"), F.max("w").alias("max_confidence"), F.round(F.avg("w"), 9).alias("mean_confidence"),
        F.min(F.col("id") % 50).alias("first_frame"), F.max(F.col("id") % 50).alias("last_frame"),
    )


@query(
    """SELECT id, round(CASE WHEN valid THEN 40 + degrees((0.8 * x + 0.6 * y + 3) / 6378137) END, 9) AS latitude, round(CASE WHEN valid THEN 20 + degrees((0.6 * x - 0.8 * y + 5) / (6378137 * cos(radians(40)))) END, 9) AS longitude
FROM (SELECT *, g <> 3 AS valid FROM p)""",
    p=POINTS,
)
def georeferenced_plants(p: DataFrame) -> DataFrame:
    """Positions from a group's similarity; groups whose gate failed get none."""
    lit = F.lit
    fit = p.select("g").distinct().select("g", lit(0.6).alias("a"), lit(0.8).alias("b"), lit(5.0).alias("shift_x"), lit(3.0).alias("shift_y"), lit(40.0).alias("lat0"), lit(20.0).alias("lon0"), (F.col("g") != 3).alias("geo_valid"))
    out = fusion.georeferenced(p.select("id", "g", "x", "y"), fit, ["g"])
    return out.select("id", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


@query("SELECT frame_index, detection_id, round((x1 + x2) / 2 * 1.5 + 7, 6) AS local_x, round((y1 + y2) / 2 * 1.5 + frame_index, 6) AS local_y FROM d", d=DETECTIONS)
def detections_to_local(d: DataFrame) -> DataFrame:
    """Box centers through the transform of their frame."""
    lit = F.lit
    matrix = F.array(lit(1.5), lit(0.0), lit(7.0), lit(0.0), lit(1.5), F.col("frame_index").cast("double"), lit(0.0), lit(0.0), lit(1.0))
    out = fusion.to_local(d, d.select("frame_index").distinct().withColumn("matrix", matrix))
    return out.select("frame_index", "detection_id", F.round("local_x", 6).alias("local_x"), F.round("local_y", 6).alias("local_y"))


@query("SELECT k, least(greatest(4.0, 0.35 * s, 3 * e), 0.45 * s) AS radius FROM t", t="SELECT o_orderkey AS k, CAST(o_orderkey % 60 AS DOUBLE) AS s, CAST(o_orderkey % 7 AS DOUBLE) AS e FROM {orders}")
def association_radius(t: DataFrame) -> DataFrame:
    return t.select("k", fusion.association_radius(F.col("s"), F.col("e")).alias("radius"))
