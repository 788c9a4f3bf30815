"""Queries of spatial joins, areas and rasters."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.operators import fusion, selection, spatial
from furrow.plans.base import POINTS, query
from furrow.plans.statistics import ROUND

_DIST = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"
#: Rings of eight corners around the middles of a 5 x 5 grid, each with a hole in which a second part lies; from the nations.
AREAS = """
SELECT CAST(n_nationkey AS BIGINT) AS area_id, part, ring_id, ring_id = 1 AS hole, n_nationkey % 5 * 200 + 100 AS cx, floor(n_nationkey / 5) * 200 + 100 AS cy,
  CASE WHEN ring_id = 1 THEN 40.0 WHEN part = 1 THEN 20.0 ELSE 90.0 - n_nationkey END AS r
FROM {nation} CROSS JOIN (SELECT CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS ring_id UNION ALL SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT)) AS rings
"""
#: Points of which some are there twice.
TWICE = "SELECT id, x, y FROM (" + POINTS + ") AS q UNION ALL SELECT id, x, y FROM (" + POINTS + ") AS r WHERE kind = 'signup'"
_CORNERS = [(1.0, 0.0), (0.7, 0.6), (0.0, 1.0), (-0.6, 0.7), (-1.0, 0.0), (-0.7, -0.6), (0.0, -1.0), (0.6, -0.7)]


def _rings(areas: DataFrame) -> DataFrame:
    """Corners in the SQL's types: where middles are whole, x in exact decimals, and y their sum in doubles; 90.0 * 0.7 as a double is not 63.0, and points on an edge tell."""
    exact = lambda c: F.col("r") * F.lit(c if dict(areas.dtypes)["cx"] == "double" else Decimal(str(c)))
    xs = F.array(*[F.col("cx") + exact(c) for c, _ in _CORNERS])
    ys = F.array(*[F.col("cy").cast("double") + exact(s).cast("double") for _, s in _CORNERS])
    return areas.select("area_id", "part", "ring_id", "hole", xs.alias("xs"), ys.alias("ys"))


_EDGES = (
    "e AS (SELECT area_id, part, ring_id, hole, cx + r * c.ax AS ax, cy + r * c.ay AS ay, cx + r * c.bx AS bx, cy + r * c.b_y AS b_y FROM a, (VALUES "
    + ", ".join(f"({i}, {p[0]}, {p[1]}, {q[0]}, {q[1]})" for i, (p, q) in enumerate(zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True)))
    + ") c(i, ax, ay, bx, b_y))"
)
_INSIDE = (
    f"WITH {_EDGES}, o AS (SELECT DISTINCT * FROM p), f AS (SELECT id, area_id, part, ring_id, hole, count(*) FILTER ((ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax) % 2 = 1 AS inside FROM o, e GROUP BY ALL), "
    "k AS (SELECT id, area_id, part FROM f GROUP BY ALL HAVING bool_or(inside AND NOT hole) AND NOT bool_or(inside AND hole)), i AS (SELECT id, area_id FROM p JOIN (SELECT DISTINCT id, area_id FROM k) USING (id)) "
)


@query(f"SELECT g, id, other_id, round(distance, 6) AS distance, rank FROM (SELECT a.g, a.id, b.id AS other_id, {_DIST} AS distance, row_number() OVER (PARTITION BY a.g, a.id ORDER BY {_DIST}, b.id) AS rank FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id) WHERE rank <= 3", p=POINTS)
def knn_self(p: DataFrame) -> DataFrame:
    """Exact three nearest others of each point in its group."""
    found = spatial.nearest(p, p, 3, by=["g"])
    return ROUND(found, "distance").withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT a.g, a.id, b.id AS other_id, round({_DIST}, 6) AS distance FROM p a JOIN p b ON a.g = b.g AND a.id < b.id AND {_DIST} <= 30", p=POINTS)
def radius_pairs(p: DataFrame) -> DataFrame:
    """Pairs within 30. There are many, and round() goes through decimals; this rounds as the SQL does, halves up."""
    v = F.col("distance") * 1e6
    return spatial.radius_pairs(p, 30.0, ["g"]).withColumn("distance", (F.floor(v) + (v - F.floor(v) >= 0.5).cast("long")) / F.lit(1e6))


@query(f"SELECT a.id, count(b.id) AS nearby FROM p a LEFT JOIN p b ON b.kind = 'click' AND {_DIST} <= 12 GROUP BY a.id", p=POINTS)
def radius_count(p: DataFrame) -> DataFrame:
    """Clicks within 12 of each point."""
    n = spatial.radius_join(p, p.where("kind = 'click'"), 12.0).groupBy("id").agg(F.count(F.lit(1)).alias("nearby"))
    return p.select("id").join(n, "id", "left").fillna(0)


@query(f"SELECT a.id FROM p a WHERE a.kind <> 'error' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.kind = 'error' AND {_DIST} <= 14)", p=POINTS)
def nearest_with_tolerance(p: DataFrame) -> DataFrame:
    """Points of the other kinds without an error within the tolerance."""
    mine = p.where("kind <> 'error'")
    return mine.select("id").join(spatial.radius_join(mine, p.where("kind = 'error'"), 14.0).select("id").distinct(), "id", "left_anti")


@query(f"WITH d AS (SELECT {_DIST} AS distance FROM p a JOIN p b ON a.g = b.g AND a.id < b.id AND {_DIST} <= 36) SELECT f AS factor, count(*) FILTER (distance <= f * 30) AS links FROM (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE)) v(f) LEFT JOIN d ON true GROUP BY f", p=POINTS)
def radius_sensitivity(p: DataFrame) -> DataFrame:
    return fusion.radius_sensitivity(spatial.radius_pairs(p, 36.0, ["g"]), 30.0)


@query(
    """WITH d AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda v: pow(v[1]::DOUBLE - v[2]::DOUBLE, 2)))), 6) AS d
  FROM t a JOIN t b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS f, lead(d) OVER (PARTITION BY a ORDER BY d, b) AS f2, row_number() OVER (PARTITION BY b ORDER BY d, a) AS k, lead(d) OVER (PARTITION BY b ORDER BY d, a) AS k2 FROM d)
SELECT a, b, d FROM r WHERE f = 1 AND k = 1 AND (f2 IS NULL OR d < 0.95 * f2) AND (k2 IS NULL OR d < 0.95 * k2)""",
    t="SELECT vec_id, embedding FROM {embeddings}",
)
def mutual_ratio_matches(t: DataFrame) -> DataFrame:
    """Mutual best matches among all descriptors, with a ratio test on both sides."""
    return spatial.mutual_matches(t.select(F.col("vec_id").alias("a"), F.col("embedding").alias("p")), None, 0.95).select("a", "b", "d")


@query(_INSIDE + "SELECT id, area_id FROM i", p=TWICE, a=AREAS)
def point_in_polygon(p: DataFrame, a: DataFrame) -> DataFrame:
    return spatial.points_in_areas(p.select("id", "x", "y"), _rings(a), 100.0).select("id", "area_id")


@query(_INSIDE + "SELECT area_id, count(*) AS points FROM i GROUP BY area_id", p=TWICE, a=AREAS)
def points_per_area(p: DataFrame, a: DataFrame) -> DataFrame:
    return spatial.points_in_areas(p.select("id", "x", "y"), _rings(a), 100.0).groupBy("area_id").agg(F.count(F.lit(1)).alias("points"))


@query(f"WITH {_EDGES} SELECT area_id, part, ring_id, round(sum(ax * b_y - bx * ay) / 2, 4) AS area FROM e GROUP BY ALL", a=AREAS)
def polygon_area(a: DataFrame) -> DataFrame:
    return _rings(a).select("area_id", "part", "ring_id", F.round(geometry.shoelace(F.col("xs"), F.col("ys")), 4).alias("area"))


@query(
    _INSIDE
    + """, t AS (SELECT j.area_id, o.id, o.x, o.y, e.* EXCLUDE (area_id), least(greatest(((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)), 0), 1) AS k FROM (SELECT DISTINCT * FROM i) j JOIN o USING (id) JOIN e USING (area_id)),
m AS (SELECT area_id, id, round(min(sqrt(pow(x - (ax + k * (bx - ax)), 2) + pow(y - (ay + k * (b_y - ay)), 2))), 6) AS boundary_distance FROM t GROUP BY area_id, id)
SELECT area_id, id, boundary_distance FROM i JOIN m USING (area_id, id)""",
    p=TWICE, a=AREAS,
)
def ring_distance(p: DataFrame, a: DataFrame) -> DataFrame:
    inside = spatial.points_in_areas(p.select("id", "x", "y"), _rings(a), 100.0)
    return ROUND(spatial.ring_distances(inside, _rings(a)), "boundary_distance").select("area_id", "id", "boundary_distance")


_PRINTS = "SELECT id, g, x AS x0, y AS y0, x + 30 AS x1, y + 20 AS y1 FROM (" + POINTS + ") AS q"


@query(
    "SELECT g, px, py, count(*) AS n FROM (SELECT g, ys, unnest(range(CAST(ceil(x0 / 10) AS BIGINT), greatest(CAST(ceil(x0 / 10) AS BIGINT), CAST(floor(x1 / 10) AS BIGINT)) + 1)) AS px FROM (SELECT *, range(CAST(ceil(y0 / 10) AS BIGINT), greatest(CAST(ceil(y0 / 10) AS BIGINT), CAST(floor(y1 / 10) AS BIGINT)) + 1) AS ys FROM f)) t, LATERAL (SELECT unnest(t.ys) AS py) y GROUP BY ALL",
    f=_PRINTS,
)
def raster_coverage(f: DataFrame) -> DataFrame:
    return spatial.coverage_counts(f, 10.0, ["g"])


@query(
    """WITH r AS (SELECT g, px, py, count(*) AS n FROM (SELECT g, round_even(x, 0)::BIGINT AS px, round_even(y, 0)::BIGINT AS py FROM p) GROUP BY ALL)
SELECT id, coalesce(n, 0) AS n FROM (SELECT id, g, round_even(x + 1, 0)::BIGINT AS px, round_even(y, 0)::BIGINT AS py FROM p) LEFT JOIN r USING (g, px, py)""",
    p=POINTS,
)
def raster_sample(p: DataFrame) -> DataFrame:
    raster = p.groupBy("g", F.rint("x").cast("long").alias("px"), F.rint("y").cast("long").alias("py")).agg(F.count(F.lit(1)).alias("n"))
    return spatial.raster_at(p.select("id", "g", (F.col("x") + 1).alias("x"), "y"), raster, ["g"]).select("id", "n")


@query("SELECT g, px, py, sum(vote) AS votes, count(vote) AS valid, coalesce(sum(vote) / nullif(count(vote), 0) >= 0.5, false) AS accepted FROM (SELECT g, CAST(floor(x / 50) AS BIGINT) AS px, CAST(floor(y / 50) AS BIGINT) AS py, CASE WHEN id % 11 > 0 THEN CASE WHEN w > 0.5 THEN 1 ELSE 0 END END AS vote FROM p) GROUP BY ALL", p=POINTS)
def majority_vote(p: DataFrame) -> DataFrame:
    votes = p.select("g", F.floor(F.col("x") / 50).alias("px"), F.floor(F.col("y") / 50).alias("py"), F.when(F.col("id") % 11 > 0, (F.col("w") > 0.5).cast("int")).alias("vote"))
    return selection.majority(votes, ["g", "px", "py"])


@query(
    """WITH m AS (SELECT DISTINCT g, CAST(floor(x / 20) AS BIGINT) AS px, CAST(floor(y / 20) AS BIGINT) AS py FROM p WHERE w < 0.7), k AS (SELECT DISTINCT g, CAST(floor(x / 20) AS BIGINT) AS px, CAST(floor(y / 20) AS BIGINT) AS py FROM p WHERE w > 0.3)
SELECT g, count(*) FILTER (m.px IS NOT NULL AND k.px IS NOT NULL) AS both, count(*) AS either, count(*) FILTER (k.px IS NULL) AS only_a, count(*) FILTER (m.px IS NULL) AS only_b, count(*) FILTER (m.px IS NOT NULL AND k.px IS NOT NULL) / count(*) AS iou
FROM m FULL JOIN k USING (g, px, py) GROUP BY g""",
    p=POINTS,
)
def mask_overlap(p: DataFrame) -> DataFrame:
    cells = p.select("g", "w", F.floor(F.col("x") / 20).alias("px"), F.floor(F.col("y") / 20).alias("py"))
    return selection.mask_comparison(cells.where("w < 0.7").drop("w").distinct(), cells.where("w > 0.3").drop("w").distinct(), ["g"])


@query(
    """SELECT p.id AS plant_id, count(f.id) AS visibility_opportunity FROM p LEFT JOIN (SELECT id, x AS fx, y AS fy FROM p WHERE kind <> 'click') f ON p.x - fx >= 0 AND p.x - fx < 120 AND p.y - fy >= 0 AND p.y - fy < 80 WHERE p.kind = 'click' GROUP BY p.id""",
    p=POINTS,
)
def visibility_opportunity(p: DataFrame) -> DataFrame:
    """In how many frames each plant is inside the image; plants meet frames by cells of the footprints."""
    x, y = F.col("x"), F.col("y")
    inverse = F.array(F.lit(1.0), F.lit(0.0), -x, F.lit(0.0), F.lit(1.0), -y, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    frames = p.where("kind <> 'click'").select(F.col("id").alias("frame_index"), x.alias("x0"), y.alias("y0"), (x + 120).alias("x1"), (y + 80).alias("y1"), inverse.alias("inverse"))
    return fusion.visibility(p.where("kind = 'click'").select(F.col("id").alias("plant_id"), "x", "y"), frames, 120.0, 80.0).select("plant_id", "visibility_opportunity")


_GEO = "SELECT id, 40 + y / 1000 AS lat, 20 + x / 1000 AS lon FROM (" + POINTS + ") AS q"


@query("SELECT id, round(radians(lon - 20.5) * 6378137 * cos(radians(40.5)), 4) AS east, round(radians(lat - 40.5) * 6378137, 4) AS north, round(lat, 9) AS lat, round(lon, 9) AS lon, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone FROM p", p=_GEO)
def enu_round_trip(p: DataFrame) -> DataFrame:
    e, n = geometry.to_enu(F.col("lat"), F.col("lon"), F.lit(40.5), F.lit(20.5))
    lat, lon = geometry.from_enu(F.col("e"), F.col("n"), F.lit(40.5), F.lit(20.5))
    held = p.select("id", "lon", e.alias("e"), n.alias("n")).withColumn("lat2", lat).withColumn("lon2", lon)
    return held.select("id", F.round("e", 4).alias("east"), F.round("n", 4).alias("north"), F.round("lat2", 9).alias("lat"), F.round("lon2", 9).alias("lon"), geometry.utm_zone(F.col("lon")).alias("zone"))


@query(
    """SELECT id, round(degrees(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), 6) AS roll, round(degrees(asin(least(greatest(2 * (w * y - z * x), -1), 1))), 6) AS pitch, round(degrees(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))), 6) AS yaw
FROM (SELECT id, 0.5 AS w, 0.1 + x / 5000 AS x, 0.2 AS y, y / 2000 AS z FROM p)""",
    p=POINTS,
)
def quaternion_euler(p: DataFrame) -> DataFrame:
    roll, pitch, yaw = geometry.euler(F.lit(0.5), F.lit(0.1) + F.col("x") / 5000, F.lit(0.2), F.col("y") / 2000)
    return p.select("id", F.round(roll, 6).alias("roll"), F.round(pitch, 6).alias("pitch"), F.round(yaw, 6).alias("yaw"))


@query(
    """WITH k AS (SELECT id, lat, lon, radians(lat) AS phi, radians(lon - (CAST(floor((lon + 180) / 6) AS INT) * 6 - 177)) AS dl, 0.0066943799901413165 AS e2, 0.006739496742276434 AS ep2 FROM p),
s AS (SELECT *, 6378137 / sqrt(1 - e2 * pow(sin(phi), 2)) AS n, pow(tan(phi), 2) AS t, ep2 * pow(cos(phi), 2) AS c, dl * cos(phi) AS a FROM k)
SELECT id, round(0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * pow(a, 5) / 120) + 500000, 3) AS east FROM s""",
    p=_GEO,
)
def utm_positions(p: DataFrame) -> DataFrame:
    east, _ = geometry.to_utm(F.col("lat"), F.col("lon"))
    return p.select("id", F.round(east, 3).alias("east"))
