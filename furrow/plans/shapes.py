"""Queries of polygons, masks, registration and raw model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import gates, geometry
from furrow.operators import decode, masks, polygons, records, registration
from furrow.plans.base import DETECTIONS, POINTS, query
from furrow.plans.detection import _greedy
from furrow.plans.spatial import _EDGES, _GEO, AREAS, _rings

#: The areas at a quarter of their size, on a grid of pixels.
_SMALL = f"SELECT area_id, part, ring_id, hole, cx / 4 AS cx, cy / 4 AS cy, r / 4 AS r FROM ({AREAS}) AS q"
_FILLED = f"""{_EDGES}, i AS (SELECT area_id, px, py FROM (
  SELECT area_id, part, ring_id, hole, px, py, count(*) FILTER ((ay > py) <> (b_y > py) AND px < (bx - ax) * (py - ay) / (b_y - ay) + ax) % 2 = 1 AS inside
  FROM e, range(-40, 260) x(px), range(-40, 260) y(py) WHERE px BETWEEN cx - 30 AND cx + 30 AND py BETWEEN cy - 30 AND cy + 30 GROUP BY ALL)
  GROUP BY area_id, part, px, py HAVING bool_or(inside AND NOT hole) AND NOT bool_or(inside AND hole))""".replace("SELECT area_id, part, ring_id, hole, cx + r", "SELECT cx, cy, area_id, part, ring_id, hole, cx + r")
#: Set pixels in four groups: of the events those of low weight, on a grid of 20.
_MASK = "SELECT DISTINCT g, CAST(floor(x / 20) AS BIGINT) AS px, CAST(floor(y / 20) AS BIGINT) AS py FROM (" + POINTS + ") AS q WHERE w < 0.8"


@query(f"WITH {_FILLED} SELECT DISTINCT area_id, px::BIGINT AS px, py::BIGINT AS py FROM i", a=_SMALL)
def filled_areas(a: DataFrame) -> DataFrame:
    """Pixels whose centres lie in an area, found by rows and crossings and not by testing pixels."""
    return polygons.filled(_rings(a))


@query(
    f"""WITH {_FILLED}, k AS (SELECT DISTINCT area_id, px, py FROM i), n AS (SELECT area_id, count(*) AS n FROM k GROUP BY area_id)
SELECT area_id, other_id, pixels, round(pixels / least(u.n, v.n), 9) AS share FROM (SELECT p.area_id, q.area_id AS other_id, count(*) AS pixels FROM k p JOIN k q USING (px, py) WHERE p.area_id < q.area_id GROUP BY ALL) JOIN n u USING (area_id) JOIN n v ON v.area_id = other_id""",
    a=_SMALL.replace("cx / 4", "cx / 8").replace("cy / 4", "cy / 8"),
)
def polygon_overlaps(a: DataFrame) -> DataFrame:
    """Areas that share ground, from their rings."""
    return polygons.overlaps(_rings(a)).withColumn("share", F.round("share", 9))


@query("SELECT g, px, py FROM m", m=_MASK)
def contours_round_trip(m: DataFrame) -> DataFrame:
    """The mask from its own contours."""
    rings = polygons.contours(m, ["g"])
    named = rings.select((F.col("g") * 1_000_000).alias("area_id"), F.col("ring").cast("long").alias("ring_id"), (F.col("area") < 0).alias("hole"), "xs", "ys")
    return polygons.filled(named).select((F.col("area_id") / 1_000_000).cast("long").alias("g"), "px", "py")


@query(
    """WITH RECURSIVE r AS (SELECT g, px, py, px AS rx, py AS ry FROM m UNION SELECT r.g, n.px, n.py, r.rx, r.ry FROM r JOIN m n ON n.g = r.g AND abs(n.px - r.px) <= 1 AND abs(n.py - r.py) <= 1),
c AS (SELECT g, px, py, min(rx * 1000 + ry) AS root FROM r GROUP BY ALL)
SELECT g, count(DISTINCT root) AS components, count(*) AS pixels, true AS bordered FROM c GROUP BY g""",
    m=_MASK.replace("/ 20)", "/ 40)").replace("w < 0.8", "w < 0.1"),
)
def contour_components(m: DataFrame) -> DataFrame:
    """Outer contours are components, and signed areas add up to the pixels."""
    rings = polygons.contours(m, ["g"])
    return rings.groupBy("g").agg(F.count_if(F.col("area") > 0).alias("components"), F.sum("area").cast("long").alias("pixels"), (F.min(F.size("xs")) >= 4).alias("bordered"))


_AROUND = "(SELECT g, px + dx AS px, py + dy AS py{more} FROM {source}, range(-1, 2) a(dx), range(-1, 2) b(dy))"


@query(
    f"WITH grown AS (SELECT DISTINCT g, px, py FROM {_AROUND.format(source='m', more='')}) SELECT g, px::BIGINT AS px, py::BIGINT AS py FROM {_AROUND.format(source='grown', more='')} GROUP BY ALL HAVING count(*) = 9",
    m=_MASK,
)
def mask_closing(m: DataFrame) -> DataFrame:
    """The mask closed by a square of three: small holes and cracks are filled."""
    return masks.morphology(m, ["g"], "close")


_DISTANCE = f"""unset AS MATERIALIZED (SELECT DISTINCT g, px, py FROM {_AROUND.format(source='m', more='')} ANTI JOIN m USING (g, px, py)),
d AS (SELECT m.g, m.px, m.py, sqrt(min(pow(m.px - u.px, 2) + pow(m.py - u.py, 2))) AS distance FROM m JOIN unset u USING (g) GROUP BY ALL)"""


@query(f"WITH {_DISTANCE} SELECT g, px, py, round(distance, 9) AS distance FROM d", m=_MASK)
def mask_distances(m: DataFrame) -> DataFrame:
    return masks.distances(m, ["g"]).withColumn("distance", F.round("distance", 9))


@query(
    f"""WITH {_DISTANCE} SELECT id, CASE WHEN distance IS NULL THEN 'outside_rejected' WHEN distance < 2 THEN 'boundary_review' ELSE 'accepted' END AS status, round(coalesce(distance, 0), 9) AS distance
FROM (SELECT id, g, round_even(x / 20, 0)::BIGINT AS px, round_even(y / 20, 0)::BIGINT AS py FROM p) LEFT JOIN d USING (g, px, py)""",
    p=POINTS, m=_MASK,
)
def mask_gated_points(p: DataFrame, m: DataFrame) -> DataFrame:
    """Points by how deep they lie in the mask."""
    held = p.select("id", "g", (F.col("x") / 20).alias("x"), (F.col("y") / 20).alias("y"))
    return masks.gated(held, m, ["g"], 2.0).select("id", "status", F.round("distance", 9).alias("distance"))


#: Squares of the parts' sizes, drawn right, as a bow-tie, with a spike, twice over with a hole beside them, and with an island in a hole.
_FAULTY = """
SELECT p_partkey AS area_id, p_partkey % 5 AS kind, CAST(p_size + 10 AS DOUBLE) AS s, CAST(p_partkey % 97 * 100 AS DOUBLE) AS x, CAST(floor(p_partkey / 97) * 100 AS DOUBLE) AS y FROM {part}
"""


def _faulty(f: DataFrame) -> DataFrame:
    s, x, y = F.col("s"), F.col("x"), F.col("y")

    def ring(part: int, ring_id: int, *corners: tuple[float, float]):
        xs, ys = (F.array(*[c + s * F.lit(float(k[i])) for k in corners]) for i, c in enumerate((x, y)))
        return F.struct(F.lit(part).alias("part"), F.lit(ring_id).alias("ring_id"), F.lit(ring_id > 0).alias("hole"), xs.alias("xs"), ys.alias("ys"))

    square = lambda part, ring_id, lo, hi: ring(part, ring_id, (lo, lo), (hi, lo), (hi, hi), (lo, hi))
    kinds = (
        F.array(square(0, 0, 0, 1)),
        F.array(ring(0, 0, (0, 0), (1, 1), (1, 0), (0, 1))),
        F.array(ring(0, 0, (0, 0), (1, 0), (1, 0.5), (1.5, 0.5), (1, 0.5), (1, 1), (0, 1))),
        F.array(square(0, 0, 0, 1), square(1, 0, 0, 1), square(0, 1, 2, 3)),
        F.array(square(0, 0, 0, 1), square(0, 1, 0.125, 0.875), square(1, 0, 0.25, 0.75)),
    )
    picked = F.when(F.col("kind") == 0, kinds[0])
    for k, rings in enumerate(kinds[1:], 1):
        picked = picked.when(F.col("kind") == k, rings)
    return f.select("area_id", F.explode(picked).alias("r")).select("area_id", "r.*")


@query(
    """SELECT area_id, CASE WHEN kind IN (0, 4) THEN 'unchanged' ELSE 'repaired' END AS status, CASE WHEN kind IN (1, 4) THEN 2 ELSE 1 END::BIGINT AS parts, CASE WHEN kind = 4 THEN 1 ELSE 0 END::BIGINT AS holes,
round(s * s * CASE kind WHEN 1 THEN 0.5 WHEN 4 THEN 1 - 0.5625 + 0.25 ELSE 1 END, 6) AS area FROM f""",
    f=_FAULTY,
)
def repaired_areas(f: DataFrame) -> DataFrame:
    """Faulty polygons made valid, and what was done to each."""
    _, report = polygons.repaired(_faulty(f))
    return report.select("area_id", "status", "parts", "holes", F.round("area", 6).alias("area"))


#: Matches of eight frame pairs: similarities, with two of five targets far from where they belong.
_MATCHES = """
SELECT event_id % 8 AS pair, x, y, (1 + (event_id % 8) / 100.0) * (x * 0.998 - y * 0.0632) + 5 * (event_id % 8) + CASE WHEN event_id % 5 < 2 THEN 60 + event_id * 31 % 400 ELSE 0 END AS u,
  (1 + (event_id % 8) / 100.0) * (x * 0.0632 + y * 0.998) - 7 + CASE WHEN event_id % 5 < 2 THEN event_id * 17 % 300 ELSE 0 END AS v
FROM (SELECT event_id, CAST(event_id * 7919 % 10007 AS DOUBLE) / 10 AS x, CAST(event_id * 104729 % 10009 AS DOUBLE) / 10 AS y FROM {events}) AS e
"""


@query(
    """SELECT pair, count(*) AS matches, count(*) FILTER (u - ((1 + pair / 100.0) * (x * 0.998 - y * 0.0632) + 5 * pair) < 1) AS inliers, round((1 + pair / 100.0) * 0.998, 6) AS m0, round((1 + pair / 100.0) * 0.0632, 6) AS m3,
round(5.0::DOUBLE * pair, 4) AS shift_x, -7.0::DOUBLE AS shift_y, round(degrees(atan2(0.0632, 0.998)), 5) AS rotation FROM t GROUP BY pair""",
    t=_MATCHES,
)
def planted_similarities(t: DataFrame) -> DataFrame:
    """Similarities found among matches of which two of five are wrong."""
    found = registration.estimated(t, ["pair"])
    at = lambda i, n: F.round(F.get("matrix", F.lit(i)), n)
    return found.select("pair", F.col("match_count").alias("matches"), F.col("inlier_count").alias("inliers"), at(0, 6).alias("m0"), at(3, 6).alias("m3"), at(2, 4).alias("shift_x"), at(5, 4).alias("shift_y"), F.round("rotation_deg", 5).alias("rotation"))


@query(
    f"""WITH RECURSIVE e AS (SELECT frame_index, class_id, CAST(confidence AS DOUBLE) AS confidence, x1, y1, x2, y2, row_number() OVER (PARTITION BY frame_index ORDER BY detection_id) - 1 AS detection_id FROM d),
{_greedy("n", "(SELECT * FROM e WHERE confidence >= 0.25)", '''(greatest(least(k.x2, x.x2) - greatest(k.x1, x.x1), 0) * greatest(least(k.y2, x.y2) - greatest(k.y1, x.y1), 0)) /
  (1600 + 1600 - greatest(least(k.x2, x.x2) - greatest(k.x1, x.x1), 0) * greatest(least(k.y2, x.y2) - greatest(k.y1, x.y1), 0)) > 0.45''')}
SELECT frame_index, detection_id, CASE class_id WHEN 0 THEN 'plant' ELSE 'weed' END AS class_name, confidence, least(x1, 380) AS x1, greatest(y1 - 10, 0) AS y1, least(x2, 380) AS x2, least(y2 - 10, 180) AS y2
FROM n WHERE least(x2, 380) > least(x1, 380) AND least(y2 - 10, 180) > greatest(y1 - 10, 0)""",
    d=DETECTIONS,
)
def decoded_detections(d: DataFrame) -> DataFrame:
    """Boxes from raw outputs of [4 + classes][n] and [n][4 + classes], as frames are even or odd."""
    c = F.col
    features = [(c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2, c("x2") - c("x1"), c("y2") - c("y1"), F.when(c("class_id") == 0, c("confidence")).otherwise(0.0), F.when(c("class_id") == 1, c("confidence")).otherwise(0.0)]
    rows = d.groupBy("frame_index").agg(F.sort_array(F.collect_list(F.struct("detection_id", F.array(*[f.cast("double") for f in features]).alias("f")))).alias("r"))
    wide = F.transform("r", lambda r: r["f"])
    column = lambda k: F.transform("r", lambda r: F.get(r["f"], F.lit(k)))
    tall = F.array(*[column(k) for k in range(6)])
    outputs = rows.select("frame_index", F.when(c("frame_index") % 2 == 0, tall).otherwise(wide).alias("output"))
    metas = outputs.select("frame_index", F.lit(1.0).alias("scale"), F.lit(0.0).alias("pad_left"), F.lit(10.0).alias("pad_top"), F.lit(380.0).alias("width"), F.lit(180.0).alias("height"))
    found = decode.detections(outputs, metas, ["plant", "weed"])
    return found.select("frame_index", "detection_id", "class_name", "confidence", "x1", "y1", "x2", "y2")


@query("SELECT id, round(lat, 8) AS lat, round(lon, 8) AS lon FROM p", p=_GEO)
def utm_round_trip(p: DataFrame) -> DataFrame:
    """There and back again, to a millimetre."""
    east, north = geometry.to_utm(F.col("lat"), F.col("lon"))
    held = p.withColumns({"e": east, "n": north, "zone": geometry.utm_zone(F.col("lon"))})
    lat, lon = geometry.from_utm(F.col("e"), F.col("n"), F.col("zone"))
    return held.withColumns({"lat": lat, "lon": lon}).select("id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))



@query("SELECT id, g, CAST(row_number() OVER (ORDER BY y, x, id) AS BIGINT) AS number FROM p", p=POINTS)
def numbered_in_order(p: DataFrame) -> DataFrame:
    """Numbers over the whole table in an order, without bringing it together."""
    return records.numbered(p, [F.col("y"), F.col("x"), F.col("id")]).select("id", "g", F.col("number").cast("long").alias("number"))


@query("SELECT array_to_string(list_sort(list_distinct(flatten(list(k)))), ',') AS keys FROM (SELECT CASE WHEN event_id % 3 = 0 THEN ['kind', 'u' || user_id % 7] ELSE ['v' || event_id % 11, 'kind'] END AS k FROM e)", e="SELECT event_id, user_id FROM {events}")
def union_of_keys(e: DataFrame) -> DataFrame:
    """The columns that a table of records of different fields would have."""
    one, text = F.lit(1), lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    maps = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("kind"), one, text("u", "user_id", 7), one)).otherwise(F.create_map(text("v", "event_id", 11), one, F.lit("kind"), one))
    return records.key_union(e.withColumn("m", maps), "m").select(F.array_join("keys", ",").alias("keys"))


_CLOSE = "SELECT event_id AS id, CAST(value AS DOUBLE) AS confidence, event_id % 3 AS near FROM {events}"


@query("SELECT id, CASE WHEN near > 0 THEN confidence * 0.5 ELSE confidence END AS confidence FROM t", t=_CLOSE)
def downgraded_confidence(t: DataFrame) -> DataFrame:
    """Half the confidence beside doubtful sightings."""
    return t.select("id", gates.downgraded(F.col("confidence"), F.col("near")).alias("confidence"))
