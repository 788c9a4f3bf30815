"""Queries of checks, budgets and summaries over records, and of tables written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import boxes, gates, geometry
from furrow.operators import records, rows, selection, spatial
from furrow.plans.base import DETECTIONS, FRAMES, PLANTS, POINTS, _oracles, _queries, made, plain, query
from furrow.plans.statistics import ROUND
from furrow.plans.telemetry import CLOCK
from furrow.sinks import files
from furrow.sources import protocol, readers, srt
from furrow.storage import checkpoint_root, ship

ORDERS = "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS price, o_orderstatus AS status FROM {orders}"


@query("SELECT k, c, price, status, name FROM o LEFT JOIN n USING (c)", o=ORDERS.replace("o_custkey AS c, ", "").replace("AS k", "AS k, o_orderkey AS c"), n="SELECT c_custkey AS c, c_name AS name FROM {customer}")
def one_to_one_join(o: DataFrame, n: DataFrame) -> DataFrame:
    """A left join that fails if a key repeats on either side."""
    return records.joined_one_to_one(o, n, ["c"]).select("k", "c", "price", "status", "name")


@query("SELECT id, x, y, NULL::DOUBLE AS w FROM p WHERE kind = 'click' UNION ALL SELECT id, x, y, w FROM p WHERE kind <> 'click'", p=POINTS)
def shards_in_order(p: DataFrame) -> DataFrame:
    """Shards with different columns as one sorted table."""
    return records.shards_in_order([p.where("kind = 'click'").select("id", "x", "y"), p.where("kind <> 'click'").select("id", "x", "y", "w")], ["id"])


_STREAMED = "SELECT event_id AS row_id, CAST(floor(event_id / 10) - CASE WHEN event_id % 250 = 249 THEN 3 ELSE 0 END AS BIGINT) AS frame_index FROM {events}"


@query(
    """SELECT row_id AS "row", 'unsorted' AS problem FROM (SELECT *, lag(frame_index) OVER (ORDER BY row_id) AS was FROM s) WHERE frame_index < was
UNION ALL SELECT row_id, 'unexpected_frame' FROM s WHERE frame_index % 13 = 5""",
    s=_STREAMED,
)
def sorted_reader_rejects(s: DataFrame) -> DataFrame:
    """Rows that a single pass by frame rejects: out of order, or of frames that nobody takes."""
    return records.taken_by_frame(s, s.where("frame_index % 13 <> 5"))[1]


@query("SELECT k, array_to_string(list_filter([CASE WHEN price < 50000 THEN 'price' END, CASE WHEN status = 'F' THEN 'status' END, CASE WHEN c % 3 = 1 THEN 'customer' END], lambda x: x IS NOT NULL), ',') AS violated FROM o", o=ORDERS)
def rule_violations(o: DataFrame) -> DataFrame:
    held = records.violations(o, {"price": F.col("price") >= 50_000, "status": F.col("status") != "F", "customer": F.col("c") % 3 != 1})
    return held.select("k", F.array_join("violated", ",").alias("violated"))


@query(
    """WITH RECURSIVE r AS (SELECT *, 100 + event_id % 400 AS size, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM e),
s AS (SELECT user_id, event_id, r, true AS ok, t AS last, size AS used FROM r WHERE r = 1
  UNION ALL SELECT user_id, event_id, r, ok, CASE WHEN ok THEN t ELSE last END, CASE WHEN ok THEN used + size ELSE used END FROM (
    SELECT x.*, s.last, s.used, x.t - s.last >= 300 AND s.used < 1500 AND s.used + x.size <= 1500 AS ok FROM s JOIN r x ON x.user_id = s.user_id AND x.r = s.r + 1))
SELECT user_id, event_id FROM s WHERE ok""",
    e=CLOCK,
)
def samples_within_budget(e: DataFrame) -> DataFrame:
    """Samples 300 s apart or more while a user's bytes stay within 1500; the last ones may be small ones."""
    sized = e.withColumn("size", F.col("event_id") % 400 + 100)
    return records.within_budget(sized, ["user_id"], [F.col("t"), F.col("event_id")], "t", "size", 300.0, 1500).select("user_id", "event_id")


@query(
    """WITH RECURSIVE r AS (SELECT user_id, event_id, 100 + event_id % 50 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e),
s AS (SELECT user_id, size, r, size AS used, 0 AS chunk FROM r WHERE r = 1
  UNION ALL SELECT x.user_id, x.size, x.r, CASE WHEN s.used + x.size > 1000 THEN x.size ELSE s.used + x.size END, CASE WHEN s.used + x.size > 1000 THEN s.chunk + 1 ELSE s.chunk END
  FROM s JOIN r x ON x.user_id = s.user_id AND x.r = s.r + 1),
l AS (SELECT user_id, max(chunk) AS last FROM s GROUP BY 1)
SELECT user_id, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes_written, CAST(last AS BIGINT) AS rotations, CAST(greatest(last - 1, 0) AS BIGINT) AS files_discarded, CAST(sum(size) FILTER (chunk >= last - 1) AS BIGINT) AS bytes_on_disk, last > 1 AS storage_cap_reached
FROM s JOIN l USING (user_id) GROUP BY user_id, last""",
    e=CLOCK,
)
def session_summaries(e: DataFrame) -> DataFrame:
    """What each user's rotated log holds in the end: files of up to 1000 bytes, one older file kept."""
    sized = e.select("user_id", "event_id", (F.col("event_id") % 50 + 100).alias("size"))
    return records.session_summary(sized, ["user_id"], "size", "event_id", 1000, 1)


@query(
    """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM e),
s AS (SELECT user_id, event_id, r, true AS written, [t + 400] AS q FROM r WHERE r = 1
  UNION ALL SELECT user_id, event_id, r, len(w) < 2, CASE WHEN len(w) < 2 THEN list_append(w, greatest(t, coalesce(list_max(w), t)) + 400) ELSE w END FROM (
    SELECT x.*, list_filter(s.q, lambda v: v > x.t) AS w FROM s JOIN r x ON x.user_id = s.user_id AND x.r = s.r + 1))
SELECT user_id, event_id, written, CASE WHEN written THEN round(q[-1], 6) END AS done FROM s""",
    e=CLOCK,
)
def bounded_writer_queue(e: DataFrame) -> DataFrame:
    """A writer that needs 400 s for each event and holds two; what comes on top is dropped."""
    return records.bounded_queue(e, ["user_id"], [F.col("t"), F.col("event_id")], "t", 400.0, 2).select("user_id", "event_id", "written", F.round("done", 6).alias("done"))


@query("SELECT user_id, t, round(silence, 6) AS silence FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS silence FROM e) WHERE silence > 120", e=CLOCK)
def heartbeat_silences(e: DataFrame) -> DataFrame:
    return ROUND(records.silences(e, ["user_id"], "t", 120.0), "silence")


@query(
    """SELECT f.user_id, f.event_id, CASE WHEN f.t - r.t <= 500 THEN r.event_id END AS shown FROM (SELECT * FROM e WHERE event_type <> 'click') f
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') r ON f.user_id = r.user_id AND f.t >= r.t""",
    e=CLOCK,
)
def shown_results(e: DataFrame) -> DataFrame:
    """The latest click before each other event, until it is 500 s old."""
    held = records.shown_results(e.where("event_type <> 'click'"), e.where("event_type = 'click'").select("user_id", F.col("t").alias("made"), F.col("event_id").alias("result")), ["user_id"], "t", "made", 500.0)
    return held.select("user_id", "event_id", F.col("shown.result").alias("shown"))


@query("SELECT user_id, event_id, round(CASE WHEN t > was THEN (event_id - n) / (t - was) END, 9) AS fps FROM (SELECT *, lag(t) OVER w AS was, lag(event_id) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))", e=CLOCK)
def rolling_source_rate(e: DataFrame) -> DataFrame:
    return records.rolling_rate(e, ["user_id"], "t", "event_id").select("user_id", "event_id", F.round("fps", 9).alias("fps"))


_GATED = "SELECT CAST(l_partkey AS BIGINT) AS plant, CASE WHEN l_quantity < 10 THEN 'outside_rejected' WHEN l_quantity < 20 THEN 'boundary_review' ELSE 'accepted' END AS status, l_extendedprice AS distance FROM {lineitem}"


@query("SELECT plant, count(*) AS observations, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'boundary_review') AS boundary_review, count(*) FILTER (status = 'outside_rejected') AS outside_rejected, min(distance) AS least_distance FROM g GROUP BY 1", g=_GATED)
def plant_gate_summary(g: DataFrame) -> DataFrame:
    return records.gate_summary(g, ["plant"])


@query("SELECT status, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC", g=_GATED)
def group_sizes(g: DataFrame) -> DataFrame:
    """Groups by size, the largest first."""
    return records.group_sizes(g, ["status"])


@query("SELECT count(*) AS observations, count(DISTINCT plant) AS plants, count(*) FILTER (status = 'accepted') AS accepted, min(distance) AS least, max(distance) AS most FROM g", g=_GATED)
def grand_totals(g: DataFrame) -> DataFrame:
    return records.totals(g, {"plants": "plant"}, {"accepted": F.col("status") == "accepted"}, {"distance": ("least", "most")})


@query("SELECT g, px, py, max(v) AS v FROM (SELECT g, CAST(floor(x / 20) AS BIGINT) AS px, CAST(floor(y / 20) AS BIGINT) AS py, CASE WHEN w > 0.5 THEN 1 ELSE 0 END AS v FROM p) GROUP BY ALL", p=POINTS)
def mask_union(p: DataFrame) -> DataFrame:
    masks = p.select("g", F.floor(F.col("x") / 20).alias("px"), F.floor(F.col("y") / 20).alias("py"), F.when(F.col("w") > 0.5, 1).otherwise(0).alias("v"))
    return records.mask_union(masks, ["g"], "v")


@query(
    """WITH s AS (SELECT DISTINCT g, f FROM p), k AS (SELECT g, f FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f) - 1 AS n FROM s) WHERE n % 25 = 0),
d AS (SELECT a.g, a.id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM p a JOIN k USING (g, f) JOIN p b ON b.g = a.g AND b.f = a.f AND b.id <> a.id GROUP BY ALL)
SELECT g, round(min(d), 6) AS p0, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95 FROM d GROUP BY g""",
    p="SELECT *, CAST(floor(id / 10) AS BIGINT) AS f FROM (" + POINTS.replace("event_id % 4 AS g", "0 AS g") + ") AS q",
)
def boundary_spacing_sample(p: DataFrame) -> DataFrame:
    """A sampling operator: nearest distances inside every 25th frame."""
    out = records.spacing_sample(p, "g", "f")
    return ROUND(out, "p0", "p50", "p95").select("g", "p0", "p50", "p95")


@query("SELECT plot_id, row_id, plant_id, round(sqrt(pow(lead(along) OVER w - along, 2) + pow(lead(across) OVER w - across, 2)), 6) AS step FROM pl WINDOW w AS (PARTITION BY plot_id, row_id ORDER BY along, plant_id)", pl=PLANTS)
def adjacent_distances(pl: DataFrame) -> DataFrame:
    return ROUND(rows.adjacent_distances(pl, ["plot_id", "row_id"], ["along", "plant_id"]), "step").select("plot_id", "row_id", "plant_id", "step")


@query("SELECT s, part, size, row_number() OVER (PARTITION BY s ORDER BY size * size DESC, x, part) AS position FROM b", b="SELECT p_size AS s, p_partkey AS part, CAST(p_partkey % 7 + 1 AS DOUBLE) AS size, CAST(p_partkey AS DOUBLE) AS x FROM {part}")
def areas_by_size(b: DataFrame) -> DataFrame:
    """Squares of each group by area; equal ones by place."""
    x, size = F.col("x"), F.col("size")
    rings = b.select("s", "part", "size", F.array(x, x + size, x + size, x).alias("xs"), F.array(x * 0, x * 0, size, size).alias("ys"))
    ranked = records.by_area(rings.withColumn("area", F.abs(geometry.shoelace(F.col("xs"), F.col("ys")))), ["s"])
    return ranked.select("s", "part", "size", F.col("position").cast("long").alias("position"))


@query("SELECT g, id AS index, v AS area, position FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, id DESC) AS position FROM p WHERE v >= 10) WHERE position <= 5", p=POINTS)
def area_candidates(p: DataFrame) -> DataFrame:
    """A top-k report: the five largest instances of each group."""
    return records.area_candidates(p.select("g", F.col("id").alias("index"), F.col("v").alias("area")), ["g"], 10.0, 5).withColumn("position", F.col("position").cast("long"))


@query("SELECT s, 'left' AS only_in FROM (SELECT s FROM a EXCEPT SELECT s FROM b) UNION ALL SELECT s, 'right' FROM (SELECT s FROM b EXCEPT SELECT s FROM a)", a="SELECT p_size AS s FROM {part}", b="SELECT CAST(l_quantity AS INT) + 10 AS s FROM {lineitem}")
def sources_compared(a: DataFrame, b: DataFrame) -> DataFrame:
    return records.same_sources(a, b, "s")


@query("SELECT plot_id, row_id, slot_index, run, first FROM (SELECT plot_id, row_id, slot_index, run, min(slot_index) OVER (PARTITION BY plot_id, row_id, run) AS first FROM (SELECT plot_id, row_id, plant_id AS slot_index, plant_id - row_number() OVER (PARTITION BY plot_id, row_id ORDER BY plant_id) AS run FROM pl))", pl=PLANTS)
def members_of_runs(pl: DataFrame) -> DataFrame:
    """Each member of a run with the run's first member: the way back from a run to its members."""
    held = rows.run_members(pl.select("plot_id", "row_id", F.col("plant_id").alias("slot_index")), ["plot_id", "row_id"])
    return held.select("plot_id", "row_id", "slot_index", "run", "first")


@query(
    """SELECT frame_index, detection_id, CAST(round(least(greatest((x1 + x2) / 800, 0), 1) * 10000) AS INT) AS cx, CAST(round(least(greatest((y1 + y2) / 400, 0), 1) * 10000) AS INT) AS cy,
CAST(round(least(greatest((x2 - x1) / 400, 0), 1) * 10000) AS INT) AS w, CAST(round(least(greatest((y2 - y1) / 200, 0), 1) * 10000) AS INT) AS h FROM d""",
    d=DETECTIONS,
)
def pilot_boxes(d: DataFrame) -> DataFrame:
    box = protocol.pilot_box(F.col("x1") / 400, F.col("y1") / 200, F.col("x2") / 400, F.col("y2") / 200)
    return d.select("frame_index", "detection_id", box.alias("b")).where("b is not null").select("frame_index", "detection_id", "b.*")


@query(
    """SELECT k, CASE WHEN coalesce(g, 0) > 0 THEN price END AS latitude, k % 5 = 0 AS segmented, CASE WHEN price / 200000 >= 0.995 AND c >= 1000 THEN 'high' ELSE 'review' END AS confidence
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 4 END AS g FROM o)""",
    o=ORDERS,
)
def gps_gate_and_cadence(o: DataFrame) -> DataFrame:
    level = F.when(F.col("k") % 3 != 0, F.col("k") % 4)
    return o.select("k", gates.located(level, F.col("price")).alias("latitude"), gates.at_cadence(F.col("k"), 5).alias("segmented"), gates.component_confidence(F.col("price") / 200_000, F.col("c")).alias("confidence"))


@query(
    """SELECT k, cx - w / 2 AS x1, cy + h / 2 AS y2, CASE WHEN least(cx + w / 2, 100.0) > greatest(cx - w / 2, 0.0) THEN least(cx + w / 2, 100.0) END AS clipped_x2, (cx - 12) / 0.5 AS source_x
FROM b""",
    b="SELECT o_orderkey AS k, CAST(o_orderkey % 140 AS DOUBLE) AS cx, CAST(o_orderkey % 90 AS DOUBLE) AS cy, CAST(o_orderkey % 30 + 2 AS DOUBLE) AS w, CAST(o_orderkey % 20 + 2 AS DOUBLE) AS h FROM {orders}",
)
def box_conversions(b: DataFrame) -> DataFrame:
    """Boxes from center and size, clipped, and a coordinate taken out of its letterbox."""
    c = boxes.from_center(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    cut = boxes.clip(c["x1"], c["y1"] * 0, c["x2"], c["y2"] * 0 + 1, F.lit(100.0), F.lit(50.0))
    return b.select("k", c["x1"].alias("x1"), c["y2"].alias("y2"), cut["x2"].alias("clipped_x2"), boxes.unletterbox(F.col("cx"), F.lit(12.0), F.lit(0.5)).alias("source_x"))


@query(
    "SELECT k, 2.0 * 640 + k AS x, 2.0 * 300 - 1 AS y, k::DOUBLE AS x0, CAST(s - 4 AS DOUBLE) AS left_edge FROM (SELECT k, CAST(c AS DOUBLE) AS s FROM o)", o=ORDERS
)
def footprints(o: DataFrame) -> DataFrame:
    """The far corner of each frame's footprint down to its region of interest, and a gap's square."""
    k = F.col("k").cast("double")
    m = [F.lit(v) for v in (2.0, 0.0)] + [k] + [F.lit(v) for v in (0.0, 2.0, -1.0, 0.0, 0.0, 1.0)]
    f = geometry.footprint(m, F.lit(640.0), F.lit(480.0), F.lit(300.0))
    corner, first = F.get(f, F.lit(2)), F.get(f, F.lit(0))
    return o.select("k", corner["x"].alias("x"), corner["y"].alias("y"), first["x"].alias("x0"), F.get(geometry.square(F.col("c").cast("double"), k, 4.0), F.lit(0))["x"].alias("left_edge"))


@query("SELECT k, price FROM (SELECT k, price, row_number() OVER (ORDER BY price, k) - 1 AS i, count(*) OVER () AS n FROM o) WHERE i IN (SELECT round_even(j * (n - 1) / 8, 0) FROM range(9) r(j))", o=ORDERS)
def quantile_positions(o: DataFrame) -> DataFrame:
    """A sampling operator: nine evenly spaced places of the order by price."""
    return selection.quantile_positions(o.select("k", "price"), ["price", "k"], 9).select("k", "price")


@query("SELECT DISTINCT CAST(regexp_extract(path, 'frame_([0-9]+)', 1) AS BIGINT) AS frame_index FROM f WHERE k % 3 <> 0", f="SELECT concat('/run/', CASE WHEN o_orderkey % 3 = 0 THEN 'image_' ELSE 'frame_' END, CAST(o_orderkey AS STRING), '.jpg') AS path, o_orderkey AS k FROM {orders}".replace("AS STRING", "AS VARCHAR(20)"))
def frame_numbers(f: DataFrame) -> DataFrame:
    return f.select(readers.frame_number(F.col("path")).alias("frame_index")).where("frame_index is not null").distinct()


@query("SELECT 'running' AS key, max(k) FILTER (k % 4 = 1)::INT AS value FROM l UNION ALL SELECT 'snapshot_seq', max(k) FILTER (k % 4 = 2)::INT FROM l UNION ALL SELECT 'absent', 7", l="SELECT o_orderkey AS k FROM {orders}")
def control_values(l: DataFrame) -> DataFrame:
    """The last number of each known key; other keys and values that aren't numbers don't count."""
    k = F.col("k")
    text = F.when(k % 4 == 1, F.concat(F.lit("running = "), k)).when(k % 4 == 2, F.concat(F.lit("snapshot_seq="), k)).when(k % 4 == 3, F.lit("running=x")).otherwise(F.concat(F.lit("other="), k))
    return readers.parse_control(l.select(k.alias("line_no"), text.alias("value")), {"running": 0, "snapshot_seq": 0, "absent": 7})


@query("SELECT flight, frame_index FROM f WHERE frame_index >= 3 AND (frame_index - 3) % 7 = 0", f=FRAMES)
def strided_frames(f: DataFrame) -> DataFrame:
    """A sampling operator: every seventh frame from the third on."""
    return records.strided(f, "frame_index", 7, 3).select("flight", "frame_index")


_FLAGGED = "SELECT frame_index, confidence, CASE WHEN x1 < 30 THEN 'outside_rejected' WHEN x1 < 60 THEN 'boundary_review' ELSE 'accepted' END AS status FROM (" + DETECTIONS + ") AS q"


@query("SELECT frame_index, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'boundary_review') AS boundary_review, count(*) FILTER (status = 'outside_rejected') AS outside_rejected, count(*) FILTER (confidence < 0.35) AS low_confidence FROM d GROUP BY 1", d=_FLAGGED)
def frame_flags(d: DataFrame) -> DataFrame:
    return records.frame_flags(d, ["frame_index"], 0.35)


@query("SELECT frame_index, count(*) FILTER (status = 'outside_rejected') AS outside FROM d GROUP BY 1", d=_FLAGGED)
def counts_with_zeros(d: DataFrame) -> DataFrame:
    """Rejected boxes of each frame, also of frames that have none."""
    return records.counts_with_zeros(d, d.where("status = 'outside_rejected'"), ["frame_index"], "outside")


@query("SELECT k, k % 100 AS x, k % 50 + 10 AS height FROM o", o=ORDERS)
def regions(o: DataFrame) -> DataFrame:
    k = F.col("k").cast("int")
    box = records.region(k % 100, k % 70, F.lit(20), k % 50 + 10, F.lit(120), F.lit(130))
    return o.select("k", box["x"].cast("long").alias("x"), box["height"].cast("long").alias("height"))


def _folder(spark: SparkSession) -> str:
    ship(spark)
    return f"{checkpoint_root(spark)}/files/{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV in two appends, with a field that isn't there, and two columns read again."""
    at, o = _folder(spark), made(spark, sf_dir, ORDERS)
    for part in ("status = 'F'", "status <> 'F'"):
        files.write_csv(o.where(part), ["k", "absent", "status", "price"], at, "append")
    return readers.read_csv(spark, at, "k long, absent string, status string, price double", ["k", "price"])


def records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of two files read again; empty and malformed lines are dropped."""
    at, o = _folder(spark), made(spark, sf_dir, ORDERS)
    text = F.when(F.col("k") % 5 == 0, F.lit("{broken")).when(F.col("k") % 5 == 1, F.lit("")).otherwise(F.to_json(F.struct("k", "price")))
    for i, part in enumerate(("status = 'F'", "status <> 'F'")):
        o.where(part).select(text.alias("value")).write.text(f"{at}/log{i}.jsonl")
    return readers.read_records(spark, at, "log", "k long, price double").where("k is not null")


def areas_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons written as one feature collection and read again."""
    at, n = _folder(spark), made(spark, sf_dir, "SELECT n_nationkey AS k, n_name AS name FROM {nation}")
    x = F.col("k").cast("double")
    text = files.polygon_features(n.withColumn("xs", F.array(x, x + 1, x + 1)).withColumn("ys", F.array(x, x, x + 2)), "xs", "ys", ["name"])
    doc = text.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]}")).alias("value"))
    doc.coalesce(1).write.text(at)
    back = readers.read_areas(spark, at)
    return back.select(F.col("properties")["name"].alias("name"), "part", "ring_id", "hole", F.element_at("xs", 1).alias("x"), F.element_at("ys", -2).alias("top"), F.size("xs").alias("points"))


def raster_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage raster kept as Parquet and sampled again: each point's own pixel."""
    at, p = _folder(spark), made(spark, sf_dir, POINTS)
    pixel = p.groupBy("g", F.rint("x").cast("long").alias("px"), F.rint("y").cast("long").alias("py")).agg(F.count(F.lit(1)).alias("n"))
    pixel.write.parquet(at)
    return spatial.raster_at(p.select("id", "g", "x", "y"), spark.read.parquet(at), ["g"]).select("id", "n")


def subtitle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each flight's subtitles have a valid timing, and how many have a field; every fifth timing is broken."""
    ship(spark)
    e = made(spark, sf_dir, "SELECT event_id % 8 AS flight, event_id AS k FROM {events}")
    timing = F.when(F.col("k") % 5 == 0, F.lit("broken --> timing")).otherwise(F.lit("00:00:01,000 --> 00:00:02,000"))
    body = F.concat_ws("\n", F.col("k").cast("string"), timing, F.when(F.col("k") % 3 == 0, F.lit("[iso: 100] [latitude: 1.5]")).otherwise(F.lit("iso: none lat: 2.25 other: x")))
    texts = e.groupBy("flight").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("value"))
    return srt.report(texts).select("flight", "blocks", "parsed", "skipped", "iso_count", "latitude_count")


def exported_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run exported as CSV and JSON lines; the JSON lines read again."""
    at = _folder(spark)
    told = files.export_run({"orders": made(spark, sf_dir, ORDERS), "frames": made(spark, sf_dir, FRAMES)}, at)
    held = spark.read.schema("k long, c long, price double, status string").json(f"{at}/orders_jsonl")
    return held.withColumn("rows", F.lit(told["rows"]["orders"]).cast("long"))


def protocol_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a result, boxes and contours written as lines and parsed again."""
    ship(spark)
    o = made(spark, sf_dir, ORDERS).select(F.col("k").alias("message_id"), "c", "price")
    n = lambda v: F.lit(v)
    results = o.select("message_id", F.col("message_id").alias("frame_index"), n(1).cast("long").alias("capture_ns"), n(2).cast("long").alias("generated_ns"), F.round("price", 3).alias("latency_ms"), n(1.5).alias("fps"), n(3.25).alias("p50_ms"), n("ok").alias("status"), n(0).alias("warnings"), n(1).alias("detections"), n(1).alias("selected"), n(-1).alias("gaps"), n(1920).alias("width"), n(1080).alias("height"), n(5760).alias("stride"))
    at = lambda k: (F.col("message_id") % k).cast("double")
    shapes = o.select("message_id", n(0).alias("detection_id"), n(1).alias("class_id"), n(0.5).alias("confidence"), at(50).alias("x1"), at(60).alias("y1"), (at(50) + 100).alias("x2"), (at(60) + 100).alias("y2"))
    rings = o.where("message_id % 2 = 0").select("message_id", n(3).alias("contour_id"), F.array(*[F.struct((at(100) * k).alias("x"), (at(70) + k).alias("y")) for k in (1, 2, 3)]).alias("points"))
    lines = protocol.write_results(results, shapes, rings).select("message_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    got = protocol.parse_results(lines)
    third = got["contours"].select("message_id", F.size("points").alias("points"), F.round(F.get("points", F.lit(2))["x"] * 10_000, 4).alias("third_x"))
    held = got["results"].join(got["boxes"].select("message_id", F.round(F.col("x2") * 10_000, 4).alias("x2")), "message_id").join(third, "message_id", "left")
    return held.select("message_id", "frame_index", F.round("latency_ms", 3).alias("latency_ms"), "status", "gaps", "x2", "points", "third_x")


_ORDERS = plain(ORDERS)
for _f, _sql in (
    (csv_round_trip, f"SELECT k, price FROM ({_ORDERS})"),
    (records_round_trip, f"SELECT k, price FROM ({_ORDERS}) WHERE k % 5 > 1"),
    (areas_round_trip, "SELECT n_name AS name, 0 AS part, 0 AS ring_id, false AS hole, n_nationkey::DOUBLE AS x, n_nationkey + 2.0::DOUBLE AS top, 4 AS points FROM nation"),
    (raster_round_trip, f"WITH p AS ({plain(POINTS)}), r AS (SELECT g, round_even(x, 0) AS px, round_even(y, 0) AS py, count(*) AS n FROM p GROUP BY ALL) SELECT id, n FROM p JOIN r ON r.g = p.g AND px = round_even(x, 0) AND py = round_even(y, 0)"),
    (subtitle_report, "SELECT event_id % 8 AS flight, count(*) AS blocks, count(*) FILTER (event_id % 5 > 0) AS parsed, count(*) FILTER (event_id % 5 = 0) AS skipped, count(*) FILTER (event_id % 5 > 0 AND event_id % 3 = 0) AS iso_count, count(*) FILTER (event_id % 5 > 0) AS latitude_count FROM events GROUP BY 1"),
    (exported_run, f"SELECT k, c, price, status, count(*) OVER () AS rows FROM ({_ORDERS})"),
    (protocol_round_trip, f"SELECT k AS message_id, k AS frame_index, round(price, 3) AS latency_ms, 'ok' AS status, -1 AS gaps, k % 50 + 100.0::DOUBLE AS x2, CASE WHEN k % 2 = 0 THEN 3 END AS points, CASE WHEN k % 2 = 0 THEN k % 100 * 3.0::DOUBLE END AS third_x FROM ({_ORDERS})"),
):
    _queries[_f.__name__], _oracles[_f.__name__] = _f, _sql
