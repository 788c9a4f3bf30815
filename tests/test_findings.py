"""Queries on the rows that once told them from their SQL, and operators at the sizes that once stopped them, in small."""

from __future__ import annotations

import time
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import folds, fusion, reports, spatial
from furrow.plans.registry import oracle_sql, queries


@pytest.fixture
def equals_sql(spark, tmp_path):
    """A function that runs a query and its SQL on tables given as SQL for DuckDB, and holds all rows and columns against each other."""

    def check(name: str, **tables: str) -> int:
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"CREATE TABLE {t} AS {sql}")
            con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
        want = con.execute(oracle_sql()[name])
        cols = [c[0] for c in want.description]
        plain = lambda v: float(v) if isinstance(v, Decimal) else v
        rows = lambda found: sorted(repr([*map(plain, r)]) for r in found)
        want = rows(want.fetchall())
        got = rows(queries()[name](spark, str(tmp_path)).select(*cols).collect())
        assert got == want
        return len(got)

    return check


def events(ids: str) -> str:
    return f"SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts, (i % 10)::BIGINT AS user_id, ['click', 'view', 'signup', 'error'][i % 4 + 1] AS event_type, (i % 100) / 7.0::DOUBLE AS value, '' AS props FROM {ids} AS t(i)"


def test_clock_past_100_hours(equals_sql):
    assert equals_sql("clock_and_ids", events=events("(VALUES (0), (45460), (45461), (599999))")) == 4


def test_subtitles_past_100_hours(equals_sql):
    assert equals_sql("srt_blocks", events=events("(VALUES (0), (2880000), (2880008), (5999999))")) == 4


NATIONS = "SELECT i::BIGINT AS n_nationkey FROM range(25) AS t(i)"
#: Points that lie on an edge, or beside it by less than a double tells.
ON_EDGES = events("(VALUES (97454), (142467), (160494), (350773), (422961), (5))")


@pytest.mark.parametrize("name", ["point_in_polygon", "points_per_area", "ring_distance"])
def test_points_on_edges(equals_sql, name):
    assert equals_sql(name, events=ON_EDGES, nation=NATIONS) > 0


def test_scores_that_tie(equals_sql):
    """Boxes of which one is 18 times the square root of 5 further off the middle and 0.02 more confident have one score."""
    place = {((37 * p + 11 * s) % 360, (53 * p + 29) % 160): (p, s) for p in range(160) for s in range(360)}
    rows = []
    for frame, (m, q) in enumerate((m, q) for m in range(1, 22) for q in range(13, 49, 4)):
        for far, quantity in ((m, q), (m + 18, q + 1)):
            p, s = place[180 + far, (80 + 2 * far) % 160]
            rows.append(f"({8 * frame}, 1, {p}, {s}, {quantity}.0)")
    lineitem = f"SELECT a::BIGINT AS l_orderkey, b::INT AS l_linenumber, c::BIGINT AS l_partkey, d::BIGINT AS l_suppkey, e::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, TIMESTAMP '2024-01-01' AS l_shipdate FROM (VALUES {', '.join(rows)}) AS t(a, b, c, d, e)"
    assert equals_sql("overlay_topk", lineitem=lineitem) > 300


PARTS = "SELECT i::BIGINT AS p_partkey FROM range(1, 2200) AS t(i) WHERE i % 11 <> 0"


@pytest.mark.parametrize("name", ["evidence_selection", "gap_summary", "gap_rollup", "islands_consecutive_slots", "labelled_gaps", "missing_rate", "missing_slots", "rejected_first_per_plot", "set_difference_ids"])
def test_slots_are_not_broadcast(spark, equals_sql, tmp_path, name):
    """Whatever their files' size: exploded rows are many more than Spark takes them for."""
    assert equals_sql(name, part=PARTS) > 0
    lines = queries()[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString().split("\n")
    lines = [line for line in lines if line.strip()]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            sides = [j for j in range(i + 1, end) if depth[j] == depth[i] + 3]
            sent = sides[0] if "BuildLeft" in line else sides[1]
            stop = next((j for j in range(sent + 1, end) if depth[j] <= depth[sent]), end)
            assert not any("Generate" in x for x in lines[sent:stop]), line


def crowded(spark, n: int):
    """Points without an order in a square of 100, all in one cell of the size that is asked for below."""
    return spark.range(n).selectExpr("id", "0 AS g", "cast(id * 7919 % 100003 AS DOUBLE) / 1000 AS x", "cast(id * 104729 % 100019 AS DOUBLE) / 1000 AS y")


def test_crowded_path(spark):
    """60 000 points meet a few others each, not each other: 3.6 thousand million pairs take minutes."""
    began = time.time()
    got = reports.nonadjacent_minimum(crowded(spark, 60_000), ["g"], "id", 1e3, 30).first()["min_distance"]
    assert time.time() - began < 45
    i = np.arange(60_000)
    i = i[np.argsort(i * 7919 % 100003)]  # by x; neighbours of 500 places are 0.8 apart
    x, y = i * 7919 % 100003 / 1000, i * 104729 % 100019 / 1000
    pairs = [np.hypot(x[k:] - x[:-k], y[k:] - y[:-k])[abs(i[k:] - i[:-k]) >= 30].min() for k in range(1, 500)]
    assert abs(got - min(pairs)) < 1e-9


def test_crowded_frames(spark):
    """20 000 gaps under 40 000 frames that cover all of them meet the frames around them, not 800 million."""
    p = crowded(spark, 60_000)
    frames = p.where("id % 3 > 0").selectExpr("id AS frame_index", "x - 200 AS x0", "y - 200 AS y0", "x + 200 AS x1", "y + 200 AS y1")
    began = time.time()
    got = reports.central_frames(p.where("id % 3 = 0").selectExpr("id AS gap_id", "x", "y"), frames, 1e3).collect()
    assert time.time() - began < 30 and len(got) == 20_000
    i = np.arange(60_000)
    x, y, c = i * 7919 % 100003 / 1000, i * 104729 % 100019 / 1000, i[i % 3 > 0]
    for r in got[::400]:
        assert abs(r["distance"] - np.hypot(x[c] - x[r["gap_id"]], y[c] - y[r["gap_id"]]).min()) < 1e-9


def test_many_frames_see_many_plants(spark):
    """20 000 plants under 40 000 frames, of which each sees about a tenth: 80 million sightings are counted, not made; borders count as a loop over the frames has them."""
    p = crowded(spark, 60_000)
    x0, y0, one, no = F.col("x"), F.col("y"), F.lit(1.0), F.lit(0.0)
    tilt = F.col("id") % 7 / 1e5
    frames = p.where("id % 3 > 0").select(F.col("id").alias("frame_index"), (x0 - 1).alias("x0"), (y0 - 1).alias("y0"), (x0 + 45).alias("x1"), (y0 + 35).alias("y1"), F.array(one, no, -x0, no, one, -y0, tilt, no, one).alias("inverse"))
    plants = p.where("id % 3 = 0").select(F.col("id").alias("plant_id"), "x", "y")
    began = time.time()
    got = {r["plant_id"]: r["visibility_opportunity"] for r in fusion.visibility(plants, frames, 40.0, 30.0).collect()}
    assert time.time() - began < 30 and len(got) == 20_000
    i = np.arange(60_000)
    x, y, c = i * 7919 % 100003 / 1000, i * 104729 % 100019 / 1000, i[i % 3 > 0]
    for k in [*got][::100]:
        w = c % 7 / 1e5 * x[k] + 0.0 * y[k] + 1.0
        u, v = (x[k] + 0.0 * y[k] - x[c]) / w, (0.0 * x[k] + y[k] - y[c]) / w
        assert got[k] == np.count_nonzero((u >= 0) & (u < 40) & (v >= 0) & (v < 30))


@pytest.mark.parametrize("which", ["overlaps", "centers"])
def test_large_frames(spark, which, monkeypatch):
    """Boxes of all sizes, chained, nested, equal and empty: a grid keeps what the fold keeps."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000
    side = lambda k: F.when(F.col("id") % 50 == 0, 0.0).otherwise(F.pow(F.lit(2.0), u(k) * 7))
    p = spark.range(1500).select(F.col("id").alias("detection_id"), (F.col("id") % 2).alias("frame_index"), F.lit(0).alias("class_id"), F.round(u(0), 2).alias("confidence"), F.round(u(1) * 300).alias("x1"), F.round(u(2) * 300).alias("y1"), side(3).alias("w"), side(4).alias("h"))
    p = p.select("*", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2")).drop("w", "h").localCheckpoint()
    keep = lambda: {r["detection_id"] for t in ((0.0, 0.2, 0.5) if which == "overlaps" else (8.0, 40.0)) for r in (folds.suppress_overlaps(p, t) if which == "overlaps" else folds.suppress_close_centers(p, t)).selectExpr(f"concat(detection_id, '/', {t}) AS detection_id").collect()}
    got = keep()
    monkeypatch.setattr(folds, "_MOST_FOLDED", 10_000)
    assert got == keep() and len(got) > 100


def test_frame_of_many_boxes(spark):
    """40 000 boxes in one frame, two on each place: each meets those around it, not all that are kept."""
    d = spark.range(40_000).selectExpr("0L AS frame_index", "0 AS class_id", "0.9 - 0.3 * (id % 2) AS confidence", "cast(id div 2 % 200 * 40 + id % 2 AS DOUBLE) AS x1", "cast(id div 400 * 40 AS DOUBLE) AS y1", "id AS detection_id")
    d = d.selectExpr("*", "x1 + 18 AS x2", "y1 + 18 AS y2")
    began = time.time()
    assert folds.suppress_close_centers(folds.suppress_overlaps(d)).selectExpr("count(*) AS n", "max(detection_id % 2) AS k").first()[:] == (20_000, 0)
    assert time.time() - began < 30


def test_descriptors_are_sent_few_times(spark):
    """Every row is sent once for each block of the other side: 9000 rows made blocks of 2048, and 720 000 rows 352 copies of each."""
    assert spatial._blocks(720_000, 65_536) == 11 and spatial._blocks(2000, 65_536) == 1 and spatial._blocks(9000, 65_536) == 5
    rng = np.random.default_rng(0)
    v = rng.integers(0, 9, (700, 3))
    t = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v.tolist())], "a long, p array<double>")
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 6)
    np.fill_diagonal(d, np.inf)
    one, two = d.argmin(1), np.sort(d, 1)[:, 1]
    good = [i for i in range(700) if d[i, one[i]] < 0.95 * two[i]]
    want = {(i, int(one[i])) for i in good if one[i] in good and one[one[i]] == i}
    for block in (150, 65_536):
        assert {(r["a"], r["b"]) for r in spatial.mutual_matches(t, t.selectExpr("a AS b", "p AS q"), 0.95, block=block).collect()} == want
    assert want


def test_tracks_on_one_point(spark):
    """Tracks that lie on few points, some of which share frames, are merged as by all their pairs."""
    rng = np.random.default_rng(1)
    middle, seen = [], []
    for t in range(400):
        middle.append((t % 2, t, float(rng.integers(0, 4)), float(rng.integers(0, 3)) * 1.5))
        seen += [(t % 2, t, int(f)) for f in rng.integers(0, 400, rng.integers(1, 4))]
    middle = spark.createDataFrame(middle, "segment_id long, track_id long, x double, y double")
    seen = spark.createDataFrame(seen, "segment_id long, track_id long, frame_index long")
    want = fusion.merge_tracks(middle, seen, spatial.radius_pairs(middle.withColumnRenamed("track_id", "id"), 2.0, ["segment_id"]))
    got = fusion.merged_within(middle, seen, 2.0)
    assert sorted(got.collect()) == sorted(want.select("segment_id", "track_id", "plant").collect())
    assert 2 < got.select("plant").distinct().count() < 400


def test_many_tracks_of_one_plant(spark):
    """20 000 pieces of one plant make 200 million pairs, on five points only ten."""
    seen = spark.range(20_000).selectExpr("0L AS segment_id", "id AS track_id", "id AS frame_index", "cast(id % 5 AS DOUBLE) AS x", "0.0D AS y")
    began = time.time()
    assert fusion.merged_within(seen, seen, 6.0).selectExpr("count(*) AS n", "max(plant) AS p").first()[:] == (20_000, 0)
    assert time.time() - began < 40


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_pairs_of_a_dense_group_shuffle_little(spark, tmp_path):
    """What 20 000 points and their 1.6 million pairs shuffle where nothing is small enough to broadcast: 54 bytes a point, and 158 with nine rows for each point."""
    spark.range(20_000).selectExpr("id % 2 AS g", "id", "cast(id * 7919 % 1009 AS DOUBLE) / 10 AS x", "cast(id * 104729 % 1013 AS DOUBLE) / 10 AS y").write.parquet(f"{tmp_path}/p")
    before, small = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert spatial.radius_pairs(spark.read.parquet(f"{tmp_path}/p"), 7.5, ["g"]).count() == 1_591_823
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert _shuffled(spark) - before < 20_000 * 80


@pytest.mark.parametrize("block", [25, 8192])
@pytest.mark.parametrize("by", [["g"], []])
def test_pairs_equal_brute_force(spark, monkeypatch, block, by):
    """Cells of many blocks, points on one place, at the radius, far out, and without an id, a group or a position; ids that repeat."""
    monkeypatch.setattr(spatial, "_BLOCK", block)
    rng, inf, nan = np.random.default_rng(2), float("inf"), float("nan")
    rows = [(int(rng.integers(0, 3)), int(i), float(rng.integers(-60, 60)) / 2, float(rng.integers(-40, 40)) / 2) for i in rng.permutation(300)]
    rows += [(1, 1000 + i, 3.0, 4.0) for i in range(120)] + [(1, 1000, 3.5, 4.0), (1, 1000, 3.0, 4.0)]
    rows += [(2, 2000, -1e-20, 100.0), (2, 2001, 5.0, 100.0), (2, 2002, 5.0, 105.0), (2, 2003, 1e300, 0.0), (2, 2004, 1e300, 0.0), (2, 2005, -1e300, 4.0)]
    odd = [(None, 3000, 0.0, 0.0), (None, 3001, 0.0, 0.0), (1, None, 0.0, 0.0), (1, 3002, None, 0.0), (1, 3003, nan, 0.0), (1, 3004, inf, 0.0), (1, 3005, inf, 0.0), (1, 3006, 0.0, -inf)]
    points = spark.createDataFrame(rows + odd, "g long, id long, x double, y double")
    held = rows + ([] if by else odd[:2])
    want = []
    for g, i, x, y in held:
        for h, j, u, v in held:
            d = np.sqrt((x - u) * (x - u) + (y - v) * (y - v)) if max(abs(x), abs(u)) < 1e200 or x == u else inf
            if i < j and d <= 5.0 and (not by or g == h):
                want.append((*([g] if by else []), i, j, float(d)))
    got = spatial.radius_pairs(points, 5.0, by)
    assert got.columns == [*by, "id", "other_id", "distance"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    names = spatial.radius_pairs(points.where("id is not null").withColumn("id", F.format_string("n%05d", "id")), 5.0, by)
    assert sorted(r[:-3] + (int(r["id"][1:]), int(r["other_id"][1:]), r["distance"]) for r in names.collect()) == sorted(want)


def test_pairs_round_as_the_sql(equals_sql):
    assert equals_sql("radius_pairs", events=events("range(9000)")) > 10_000


def test_no_points_make_no_pairs(spark):
    assert spatial.radius_pairs(spark.range(0).selectExpr("id", "0.0D AS x", "0.0D AS y"), 5.0).count() == 0


def test_frames_as_near_by_the_sql_s_middles(equals_sql):
    """Two frames as near a gap but for the last bit, which half the sum of the corners has otherwise than the SQL's middles."""
    rows = events("(VALUES (396608), (489729), (118684))")
    assert equals_sql("most_central_frame", events=f"SELECT * REPLACE (CASE WHEN event_id = 396608 THEN 'click' ELSE 'view' END AS event_type) FROM ({rows})") == 1


def _two_by_brute_force(x, p, y, q):
    out = {}
    for i, v in zip(x, p, strict=True):
        d = np.round(np.sqrt(((q - v) ** 2).sum(1)), 6)
        d[(y == i) | ~np.isfinite(d)] = np.inf
        out[int(i)] = [(int(y[k]), float(d[k])) for k in np.lexsort((y, d))[:2] if np.isfinite(d[k])]
    return {i: found for i, found in out.items() if found}


@pytest.mark.parametrize("kind", ["even", "copies", "near copies", "far out", "mixed sizes", "tiny", "corners", "lattice", "not finite", "one place", "one row"])
def test_two_nearest_by_estimates(monkeypatch, kind):
    """Estimated squares leave out none of the two nearest, in either direction, over many tiles and several measurings."""
    monkeypatch.setattr(spatial, "_HIGH", 32)
    monkeypatch.setattr(spatial, "_WIDE", 50)
    monkeypatch.setattr(spatial, "_KEPT", 300)
    monkeypatch.setattr(spatial, "_MEASURED", 70)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if kind in ("copies", "near copies"):
        v[50:250] = v[7] + (1e-6 * rng.standard_normal((200, 24)) if kind == "near copies" else 0)
    elif kind == "not finite":
        v[5, 3], v[9], v[11, 0] = np.nan, np.inf, -np.inf
    elif kind == "mixed sizes":
        v[200:] *= 1e6
    else:
        v = {"far out": v + 1e6, "tiny": v * 1e-5, "corners": np.eye(400), "lattice": rng.integers(0, 3, (400, 2)).astype(float), "one place": 0 * v, "one row": v[:1]}.get(kind, v)
    x, y, q = np.arange(len(v)), np.arange(len(v))[::2] + len(v) // 4, v[::-1][: (len(v) + 1) // 2]
    got = {True: {}, False: {}}
    with np.errstate(invalid="ignore"):
        for forward, ids, others, d in spatial._two_nearest(x, v, y, q, 6, True):
            for f, i, o, a in zip(forward, ids, others, d, strict=True):
                got[bool(f)].setdefault(int(i), []).append((int(o), float(a)))
        assert got == {True: _two_by_brute_force(x, v, y, q), False: _two_by_brute_force(y, q, x, v)}


def test_matches_measure_few_pairs(monkeypatch):
    """Of 16 million pairs some thousands are measured; every one was before."""
    v, seen, held = np.random.default_rng(4).standard_normal((4000, 64)), [0], spatial._Tops.__init__

    def counted(self, n, measure, *rest):
        held(self, n, lambda i, j: (seen.__setitem__(0, seen[0] + len(i)), measure(i, j))[1], *rest)

    monkeypatch.setattr(spatial._Tops, "__init__", counted)
    assert sum(len(found[1]) for found in spatial._two_nearest(np.arange(4000), v, np.arange(4000), v, 6, False)) == 8000
    assert seen[0] < 20_000


def test_matches_of_rows_without_a_vector(spark):
    """Rows that have no finite vector, or no id, take nobody's match."""
    v = np.random.default_rng(5).standard_normal((40, 3)).round(3)
    v[20:] = v[:20] + 0.001
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, [float("nan"), 0.0, 0.0]), (101, [float("inf"), 0.0, 0.0]), (102, None), (None, [0.0, 0.0, 0.0])]
    t = spark.createDataFrame(rows, "a long, p array<double>")
    pairs = {(i, (i + 20) % 40) for i in range(40)}
    for right in (None, t.selectExpr("a AS b", "p AS q")):
        for block in (7, 65_536):
            assert {(r["a"], r["b"]) for r in spatial.mutual_matches(t, right, 0.95, block=block).collect()} == pairs
