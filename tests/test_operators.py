"""Operators against stated values and brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import boxes, gates, geometry, strings
from furrow.operators import folds, fusion, records, reports, rows, selection, spatial, statistics, sync

BOX = "frame_index long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double, detection_id long"


def test_overlap_suppression_is_per_class(spark):
    d = spark.createDataFrame([(0, 0, 0.9, 0.0, 0.0, 10.0, 10.0, 1), (0, 0, 0.8, 1.0, 1.0, 11.0, 11.0, 2), (0, 1, 0.7, 1.0, 1.0, 11.0, 11.0, 3)], BOX)
    assert sorted((r["class_id"], r["confidence"]) for r in folds.suppress_overlaps(d, 0.1).collect()) == [(0, 0.9), (1, 0.7)]


def test_close_centers(spark):
    d = spark.createDataFrame([(0, 0, 0.9, 0.0, 0.0, 10.0, 10.0, 1), (0, 0, 0.8, 2.0, 2.0, 12.0, 12.0, 2), (0, 0, 0.7, 30.0, 30.0, 40.0, 40.0, 3)], BOX)
    assert sorted(r["confidence"] for r in folds.suppress_close_centers(d, 8.0).collect()) == [0.7, 0.9]


def test_tiles(spark):
    f = spark.createDataFrame([(0, 3840, 2160), (1, 32, 24), (2, 1920, 1080)], "frame_id int, width int, height int")
    got = selection.tiles(f, 1024, 128).collect()
    by = {k: [r for r in got if r["frame_id"] == k] for k in (0, 1, 2)}
    assert len(by[0]) == 15 and {r["tile_x"] for r in by[0]} == {0, 896, 1792, 2688, 2816} and {r["tile_y"] for r in by[0]} == {0, 896, 1136}
    assert [(r["tile_x"], r["tile_y"], r["tile_width"], r["tile_height"]) for r in by[1]] == [(0, 0, 32, 24)]
    assert {(r["tile_x"], r["tile_y"]) for r in by[2]} == {(0, 0), (896, 0), (0, 56), (896, 56)}
    odd = selection.tiles(spark.createDataFrame([(0, 1733, 997)], "frame_id int, width int, height int"), 640, 96).collect()
    assert max(r["tile_x"] + r["tile_width"] for r in odd) == 1733 and max(r["tile_y"] + r["tile_height"] for r in odd) == 997


def test_overlay_cap(spark):
    d = spark.createDataFrame([(0, 0, i / 300, 0.0, 0.0, 10.0, 10.0, i) for i in range(300)], BOX)
    got = selection.overlay_top(d, 0.0, 255, 100.0, 100.0).collect()
    assert len(got) == 255 and {r["truncated"] for r in got} == {45}


def test_latest_value_queue(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "t string, n int")
    got = sync.latest_per_trigger(d, ["t"], "n", 2).collect()
    assert sorted(r["n"] for r in got) == [2, 3] and got[0]["pushed"] == 3 and got[0]["dropped"] == 1


def test_display_mapping_rounds_half_to_even_and_clamps(spark):
    x, y = boxes.to_display(F.col("x"), F.col("y"), F.lit(100.0), F.lit(100.0), "stretch", F.col("r"))
    d = spark.createDataFrame([(50.0, 25.0, 0), (50.0, 25.0, 90), (-5.0, 200.0, 0)], "x double, y double, r int")
    assert [(r[0], r[1]) for r in d.select(x, y).collect()] == [(5000, 2500), (7500, 5000), (0, 10000)]
    halves = boxes.to_display(F.lit(0.5), F.lit(1.5), F.lit(4.0), F.lit(4.0), "stretch", F.lit(0), space=4)
    assert [*spark.range(1).select(*halves).first()] == [0, 2]


def test_sync_prefers_the_interval_then_the_nearer_neighbour(spark):
    t = spark.createDataFrame([(0, 1, 0.0, 1.0), (0, 2, 2.0, 3.0), (0, 3, 3.0, 4.0)], "flight int, srt_index int, start_seconds double, end_seconds double")
    f = spark.createDataFrame([(0, i, q) for i, q in enumerate([-0.05, 0.0, 0.999, 1.0, 1.05, 1.5, 1.96, 3.0, 4.2])], "flight int, frame_index int, query_time double")
    got = {r["frame_index"]: (r["srt_index"], r["sync_status"]) for r in sync.sync_frames(f, t, ["flight"], 0.1).collect()}
    near, exact = "nearest_within_tolerance", "exact_interval"
    assert got == {0: (1, near), 1: (1, exact), 2: (1, exact), 3: (1, near), 4: (1, near), 5: (None, "missing"), 6: (2, near), 7: (3, exact), 8: (None, "missing")}


def test_nearest_is_exact(spark):
    r = random.Random(1)
    pts = [(i, i % 3, r.random() * 100 if i % 7 else 1000.0 + i, r.random() * 100) for i in range(300)] + [(900, 9, 0.0, 0.0), (901, 9, 5.0, 5.0)]
    p = spark.createDataFrame(pts, "id int, g int, x double, y double")
    got = {(x["id"], x["rank"]): round(x["distance"], 9) for x in spatial.nearest(p, p, 3, 4.0, ["g"]).collect()}
    want = {}
    for i, g, x, y in pts:
        ds = sorted(math.sqrt((x - u) ** 2 + (y - v) ** 2) for j, h, u, v in pts if h == g and j != i)[:3]
        want |= {(i, k + 1): round(d, 9) for k, d in enumerate(ds)}
    assert got == want


def test_robust_spacing_and_weighted_median(spark):
    d = spark.createDataFrame([("a", v, w) for v, w in [(1.0, 1.0), (2.0, 5.0), (3.0, 1.0), (100.0, 0.0)]], "g string, v double, w double")
    assert statistics.weighted_median(d, ["g"], "v", "w", []).first()["weighted_median"] == 2.0
    base = [v for v in (1.0, 2.0, 3.0, 100.0) if v <= np.quantile([1, 2, 3, 100], 0.65)]
    got = statistics.robust_spacing(d, ["g"], "v").first()
    assert got["spacing"] == np.median(base) and got["mad"] == np.median(np.abs(np.array(base) - np.median(base)))


def test_similarity_recovers_the_transform(spark):
    rng = np.random.default_rng(1)
    s = rng.standard_normal((50, 2)) * 100
    a, b = 1.2 * math.cos(0.3), 1.2 * math.sin(0.3)
    rows_ = [(0, float(x), float(y), float(a * x - b * y + 7), float(b * x + a * y - 3)) for x, y in s]
    fit = statistics.similarity(spark.createDataFrame(rows_, "g int, x double, y double, u double, v double"), ["g"], "x", "y", "u", "v").first()
    assert fit["scale"] == pytest.approx(1.2) and fit["rotation_deg"] == pytest.approx(math.degrees(0.3)) and fit["shift_x"] == pytest.approx(7)


def test_axis_ratio_equals_singular_values(spark):
    m = np.random.default_rng(2).standard_normal((40, 2)) @ np.array([[5, 1], [0, 2]])
    got = statistics.axis_ratio(spark.createDataFrame([(0, float(x), float(y)) for x, y in m], "g int, x double, y double"), ["g"], "x", "y").first()[1]
    s = np.linalg.svd(m - m.mean(0), compute_uv=False)
    assert got == pytest.approx(s[1] / s[0])


def test_row_frame_round_trip_and_geodesy(spark):
    d = spark.createDataFrame([(520.0, 100.0, 0.7, 41.3, -8.6)], "x double, y double, a double, lat double, lon double")
    u, v = geometry.along_across(F.col("x"), F.col("y"), F.col("a"))
    x, y = geometry.from_along_across(u, v, F.col("a"))
    r = d.select(x, y, *geometry.to_utm(F.col("lat"), F.col("lon")), geometry.utm_zone(F.col("lon"))).first()
    assert r[0] == pytest.approx(520, abs=1e-9) and r[1] == pytest.approx(100, abs=1e-9) and r[4] == 29
    # a degree of latitude near 41 degrees is about 111.04 km
    n2 = d.select(*geometry.to_utm(F.col("lat") + 1, F.col("lon"))).first()[1]
    assert n2 - r[3] == pytest.approx(111_040, abs=60)


def test_singular_transform_gives_null(spark):
    m = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    assert spark.range(1).select(*geometry.project(m, F.lit(1.0), F.lit(1.0))).first()[0] is None


def test_peaks_and_smoothing():
    v = np.zeros(60)
    v[[10, 30, 31, 50]] = [5, 4, 4, 1]
    assert rows.peaks(v).tolist() == [10, 30, 50] and rows.peaks(v, 25).tolist() == [10, 50] and rows.peaks(v, 1, 2.0).tolist() == [10, 30]
    s = rows.smoothed(v, 2.0)
    assert len(s) == 60 and s.sum() == pytest.approx(v.sum(), rel=1e-6) and rows.smoothed(np.ones(20), 3.0) == pytest.approx(np.ones(20))


def test_one_missing_plant_is_found(spark):
    """A grid of 50 places, one of them empty, gives one gap there."""
    plants = [(j * 100 + i, 0, j, 40.0 * i, 60.0 * j) for j in range(5) for i in range(10) if (i, j) != (6, 2)]
    p = spark.createDataFrame(plants, "plant_id long, plot_id long, row_id long, along double, across double")
    sp = spark.createDataFrame([(0, 40.0)], "plot_id long, spacing double")
    found = rows.row_bands(p.drop("row_id"), 2.0, 60.0)
    assert {(r["plant_id"], r["row_id"]) for r in found.collect()} == {(i, j) for i, _, j, _, _ in plants}
    missing = rows.missing_slots(rows.expected_slots(found, sp), found, sp).collect()
    assert [(r["along"], r["across"], r["slot_index"]) for r in missing] == [(240.0, 120.0, 6)]
    live = rows.live_slots(found, sp)
    assert live.where("row_id = 2").count() == 8


def test_association_and_merging(spark):
    obs = [(0, f, f * 10 + k, 30.0 * k + f, 0.0) for f in range(6) for k in range(4) if not (k == 2 and f in (2, 3))]
    o = spark.createDataFrame(obs, "segment_id long, frame_index long, observation_id long, x double, y double")
    tracks = fusion.associate(o, 5.0, 3)
    by = {}
    for r in tracks.collect():
        by.setdefault(r["track_id"], set()).add(r["observation_id"] % 10)
    assert sorted(map(sorted, by.values())) == [[0], [1], [2], [3]]
    broken = fusion.associate(o, 5.0, 1)
    assert broken.select("track_id").distinct().count() == 5
    middle = broken.groupBy("segment_id", "track_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    pairs = spatial.radius_pairs(middle.withColumnRenamed("track_id", "id"), 8.0, ["segment_id"])
    assert fusion.merge_tracks(middle, broken, pairs).select("plant").distinct().count() == 4


def test_greedy_matching_equals_brute_force(spark):
    r = random.Random(5)
    edges = [(g, a, b, float(r.randint(0, 5))) for g in range(5) for a in range(8) for b in range(8) if r.random() < 0.4]
    got = {(x["g"], x["prev"], x["cur"]) for x in folds.greedy_matching(spark.createDataFrame(edges, "g int, prev int, cur int, distance double"), ["g"]).collect()}
    want = set()
    for g in range(5):
        used_a, used_b = set(), set()
        for _, a, b in sorted((d, a, b) for h, a, b, d in edges if h == g):
            if a not in used_a and b not in used_b:
                want.add((g, a, b))
                used_a.add(a)
                used_b.add(b)
    assert got == want


def test_gates(spark):
    d = spark.createDataFrame([(50,), (34,), (17,), (1,), (0,), (7,), (-1,), (None,)], "c int")
    got = [(r[0], r[1]) for r in d.select(gates.rtk_meaning(F.col("c")), gates.rtk_quality(F.col("c"))).collect()]
    assert got == [("NARROW_INT", "FIXED"), ("FLOAT_SOLUTION", "FLOAT"), ("PSEUDORANGE_DIFFERENTIAL", "APPROXIMATE"), ("FIX_POSITION", "LOW_QUALITY"), ("NOT_AVAILABLE", "UNAVAILABLE"), ("UNKNOWN_7", "UNKNOWN"), ("UNKNOWN", "UNAVAILABLE"), ("UNKNOWN", "UNAVAILABLE")]
    with pytest.raises(Exception, match="confidence outside"):
        spark.range(1).select(gates.confidence_level(F.lit(1.5), strict=True)).collect()
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (0.5,), (None,)], "v double")
    assert bad.where(gates.confident(F.col("v"), 0.1)).count() == 1


def test_strings(spark):
    d = spark.range(1).select(strings.key(F.lit(" Rel-Alt (m) ")), strings.clock(F.lit(3723.0045)), strings.fraction(F.lit("30000/1001")), strings.fraction(F.lit("1/0")), strings.first_number(F.lit("x -1.5m")), strings.padded_id("plant_", F.lit(12)))
    assert [*d.first()] == ["rel_alt_m", "01:02:03.004", 30000 / 1001, None, -1.5, "plant_0000012"]


def test_quantile_positions(spark):
    p = spark.range(101).select(F.col("id"), (F.col("id") * 37 % 101).alias("v"))
    assert sorted(r["v"] for r in selection.quantile_positions(p, ["v"], 5).collect()) == [0, 25, 50, 75, 100]


def test_nonadjacent_minimum_of_sparse_paths(spark):
    """Paths whose points lie farther apart than a cell, one near itself, and one too short."""
    paths = {"wide": [(i, 1000.0 * i, 0.0) for i in range(8)], "near": [(i, float(i), 0.0) for i in range(8)], "one": [(0, 0.0, 0.0), (3, 9e5, 5e5), (4, None, 0.0)], "short": [(0, 0.0, 0.0), (1, 5.0, 0.0)]}
    df = spark.createDataFrame([(g, *p) for g, ps in paths.items() for p in ps], "g string, id long, x double, y double")
    got = {r["g"]: r["min_distance"] for r in reports.nonadjacent_minimum(df, ["g"], "id", 10.0, 3).collect()}
    assert got == {"wide": 3000.0, "near": 3.0, "one": pytest.approx(math.hypot(9e5, 5e5)), "short": None}


def tracks_by_hand(obs: list[tuple], frames: list[int], radius: float, max_gap: int, neighbours: int = 3) -> dict:
    """Every observation against every track ever made."""
    place, tracks, owner = {f: i for i, f in enumerate(frames)}, [], {}
    for f in frames:
        now = sorted((o, x, y) for g, o, x, y in obs if g == f)
        edges = []
        for k, (_, x, y) in enumerate(now):
            live = sorted((math.hypot(tx - x, ty - y), t) for t, (tx, ty, at) in enumerate(tracks) if place[f] - at <= max_gap)
            edges += [(d, t, k) for d, t in live[:neighbours] if d <= radius]
        used, own = set(), {}
        for _, t, k in sorted(edges):
            if t not in used and k not in own:
                used.add(t)
                own[k] = t
        for k, (o, x, y) in enumerate(now):
            if k not in own:
                own[k] = len(tracks)
                tracks.append(None)
            tracks[own[k]] = (x, y, place[f])
            owner[o] = own[k]
    return owner


def test_association_equals_brute_force(spark):
    """Frames are ten numbers apart and some hold nothing; a track's age counts the processed ones."""
    r = random.Random(3)
    frames, obs, want = [*range(0, 200, 10)], [], {}
    for segment in range(3):
        mine = []
        for f in frames:
            if f % 70:
                mine += [(f, segment * 100_000 + f * 100 + k, r.uniform(0, 120), r.uniform(0, 60)) for k in range(r.choice([0, 4, 15]))]
        want |= tracks_by_hand(mine, frames, 14.0, 2)
        obs += [(segment, *m) for m in mine]
    o = spark.createDataFrame(obs, "segment_id long, frame_index long, observation_id long, x double, y double").repartition(4)
    every = spark.createDataFrame([(s, f) for s in range(3) for f in frames], "segment_id long, frame_index long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # frames lie across batches
    got = {x["observation_id"]: x["track_id"] for x in fusion.associate(o, 14.0, 2, frames=every).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len({*want.values()}) > 20


def test_a_still_plant_in_sparse_frames_is_one_track(spark):
    o = spark.createDataFrame([(0, f, f, 5.0, 5.0) for f in (0, 10, 20, 30)] + [(0, 10, 99, None, 1.0), (0, 20, 98, float("nan"), 1.0)], "segment_id long, frame_index long, observation_id long, x double, y double")
    got = {r["observation_id"]: r["track_id"] for r in fusion.associate(o, 8.0, 3).collect()}
    assert {got[f] for f in (0, 10, 20, 30)} == {0} and len({got[99], got[98], 0}) == 3


def test_merging_equals_brute_force(spark):
    r = random.Random(9)
    nodes = {t: {r.randrange(12) for _ in range(3)} for t in range(40)}
    edges = [(float(r.randint(1, 30)), a, b) for a in nodes for b in nodes if a < b and r.random() < 0.2]
    groups = [({t}, {*f}) for t, f in nodes.items()]
    for _, a, b in sorted(edges):
        x, y = next(g for g in groups if a in g[0]), next(g for g in groups if b in g[0])
        if x is not y and not x[1] & y[1]:
            groups = [g for g in groups if g is not x and g is not y] + [(x[0] | y[0], x[1] | y[1])]
    want = {t: min(g) for g, _ in groups for t in g}
    tracks = spark.createDataFrame([(0, t) for t in nodes], "segment_id long, track_id long")
    seen = spark.createDataFrame([(0, t, f) for t, fs in nodes.items() for f in fs], "segment_id long, track_id long, frame_index long")
    pairs = spark.createDataFrame([(0, a, b, d) for d, a, b in edges], "segment_id long, id long, other_id long, distance double")
    assert {x["track_id"]: x["plant"] for x in fusion.merge_tracks(tracks, seen, pairs).collect()} == want


def test_an_island_in_a_hole_holds_points_and_repeats_stay(spark):
    ring = lambda r: ([-r, r, r, -r], [-r, -r, r, r])
    areas = spark.createDataFrame([(1, 0, False, *ring(10.0)), (1, 0, True, *ring(6.0)), (1, 1, False, *ring(2.0))], "area_id long, part int, hole boolean, xs array<double>, ys array<double>")
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 8.0, 0.0), (2, 8.0, 0.0), (3, 11.0, 0.0), (4, None, 0.0)], "id long, x double, y double")
    got = spatial.points_in_areas(points, areas, 5.0)
    assert sorted(r["id"] for r in got.collect()) == [0, 2, 2]
    assert sorted((r["id"], r["boundary_distance"]) for r in spatial.ring_distances(got, areas).collect()) == [(0, 2.0), (2, 2.0), (2, 2.0)]


def test_nearest_leaves_out_points_without_a_position(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, float("nan"), 0.0), (4, None, 1.0), (5, float("inf"), 0.0), (6, 1e6, 0.0)], "id long, x double, y double")
    got = {(r["id"], r["rank"]): (r["other_id"], r["distance"]) for r in spatial.nearest(p, p, 1).collect()}
    assert got == {(1, 1): (2, 5.0), (2, 1): (1, 5.0), (6, 1): (2, math.hypot(1e6 - 3, 4))}


def test_mutual_matches_in_blocks(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((60, 9)), rng.standard_normal((45, 9))
    b[:20] = a[:20] + 0.05 * rng.standard_normal((20, 9))
    left = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(a)], "g long, a long, p array<double>")
    right = spark.createDataFrame([(0, 1000 + i, v.tolist()) for i, v in enumerate(b)], "g long, b long, q array<double>")
    d = np.round(np.linalg.norm(a[:, None] - b[None], axis=2), 6)
    want = set()
    for i in range(60):
        j = int(d[i].argmin())
        if int(d[:, j].argmin()) == i and d[i, j] < 0.9 * np.sort(d[i])[1] and d[i, j] < 0.9 * np.sort(d[:, j])[1]:
            want.add((i, 1000 + j))
    for block in (2048, 10):
        assert {(r["a"], r["b"]) for r in spatial.mutual_matches(left, right, 0.9, ["g"], block).collect()} == want
    assert len(want) >= 20


def test_a_session_of_a_million_rows(spark):
    """Each fold passes a session once; chunks and acceptance of all rows follow from their formulas."""
    import time

    began = time.time()
    n = 1_000_000
    e = spark.range(n).select(F.lit(1).alias("s"), F.col("id"), (F.col("id") * 0.5).alias("t"), F.lit(10).cast("long").alias("size"))
    assert folds.accepted_at_interval(e, ["s"], "t", 2.0, [F.col("id")]).count() == n // 4
    last = folds.rotated_chunks(e, ["s"], "size", "id", 1000).agg(F.max("chunk"), F.count_if(F.col("chunk") == 0)).first()
    assert (last[0], last[1]) == (n // 100 - 1, 100)
    path = e.select("s", F.col("id").alias("frame_index"), F.lit(0).alias("segment"), F.col("t").alias("x"), F.lit(0.0).alias("y"))
    assert folds.keyframes(path, "s", 5.0).count() == n // 10 + 1
    assert time.time() - began < 60


def test_chain_begins_anew_at_breaks(spark):
    shift = lambda x: [1.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows_ = [(0, 0, shift(1.0), True), (0, 1, shift(2.0), True), (0, 2, None, True), (0, 3, shift(4.0), True), (0, 4, shift(9.0), False), (0, 5, shift(1.0), True)]
    out = folds.chained_transforms(spark.createDataFrame(rows_, "g long, frame_index long, matrix array<double>, accepted boolean"), ["g"], offset=100.0)
    assert [(r["chain_segment"], r["chain"][2]) for r in out.orderBy("frame_index").collect()] == [(0, 1.0), (0, 3.0), (1, 100.0), (1, 104.0), (2, 200.0), (2, 201.0)]
    m = [F.get("m", F.lit(i)) for i in range(9)]
    back = spark.createDataFrame([([2.0, 1.0, 3.0, 0.0, 4.0, 5.0, 0.0, 0.001, 1.0],), ([0.0] * 9,)], "m array<double>").select(F.array(*geometry.inverse(m)).alias("b")).collect()
    assert back[1]["b"] == [None] * 9 and np.array(back[0]["b"]).reshape(3, 3) @ np.array([[2, 1, 3], [0, 4, 5], [0, 0.001, 1]]) == pytest.approx(np.eye(3))


def test_one_to_one_join_rejects_repeats(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (None, "w")], "k long, v string"), spark.createDataFrame([(1, 5.0), (3, 6.0)], "k long, w double")
    assert sorted((r["v"], r["w"]) for r in records.joined_one_to_one(a, b, ["k"]).collect()) == [("w", None), ("x", 5.0), ("y", None), ("z", None)]
    with pytest.raises(Exception, match="key repeated on the right"):
        records.joined_one_to_one(a, b.unionByName(b), ["k"]).collect()


def test_budget_of_samples(spark):
    e = spark.createDataFrame([("s", i, float(t), n) for i, (t, n) in enumerate([(0, 60), (1, 10), (5, 50), (9, 30), (14, 20), (20, 10), (25, 1)])], "s string, id long, t double, n long")
    got = records.within_budget(e, ["s"], [F.col("id")], "t", "n", 4.0, 100).collect()
    assert sorted(r["id"] for r in got) == [0, 3, 5]


def test_rows_of_a_bent_field(spark):
    """Rows that drift sideways together along the field are straightened and found."""
    plants = [(j * 100 + i, 0, 40.0 * i, 104.0 * j + 30.0 * math.sin(i / 12)) for j in range(8) for i in range(60)] + [(9000, 0, 500.0, 156.0)]
    p = spark.createDataFrame(plants, "plant_id long, plot_id long, along double, across double")
    scale = spark.createDataFrame([(0, 40.0, 104.0)], "plot_id long, spacing double, inter_row double")
    got = {r["plant_id"]: r["row_id"] for r in rows.reconstructed(p, scale).collect()}
    assert all(got[j * 100 + i] == j + 1 for j in range(8) for i in range(60))
    near = spark.createDataFrame([(0, 1.0, 104.0 * (-1) ** k) for k in range(30)] + [(0, 40.0, 1.0)], "plot_id long, along double, across double")
    assert rows.row_distances(near, scale).first()["inter_row"] == pytest.approx(104.0, abs=1.0)
    assert rows.row_distances(near.limit(0), scale).first()["inter_row"] == pytest.approx(104.0)


def test_blocks_of_plants(spark):
    """Two groups farther apart than twice the radius, and a single plant."""
    pts = [(0, 10.0 + 6 * i, 10.0 + 6 * j) for i in range(4) for j in range(3)] + [(0, 80.0 + 6 * i, 4.0) for i in range(5)] + [(0, 200.0, 200.0)]
    got = records.plant_blocks(spark.createDataFrame(pts, "g long, x double, y double"), ["g"], 4, 3).orderBy("block").collect()
    assert [(r["block"], r["plants"]) for r in got] == [(1, 5), (2, 12)] and got[1]["x"] == pytest.approx(19.0) and got[1]["y"] == pytest.approx(16.0)


def test_regions_and_flags_reject_what_they_do_not_know(spark):
    one = spark.range(1)
    assert one.select(records.region(F.lit(0), F.lit(0), F.lit(5), F.lit(5), F.lit(5), F.lit(5))["width"]).first()[0] == 5
    with pytest.raises(Exception, match="region outside"):
        one.select(records.region(F.lit(1), F.lit(0), F.lit(5), F.lit(5), F.lit(5), F.lit(5))).collect()
    with pytest.raises(Exception, match="unknown gate status"):
        records.frame_flags(spark.createDataFrame([(1, "odd", 0.5)], "f long, status string, confidence double"), ["f"], 0.3).collect()


def test_numbers_over_a_whole_table(spark):
    from furrow.operators import records

    r = random.Random(3)
    rows = [(r.randrange(50), i) for i in range(700)]
    got = records.numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), [F.desc("a"), F.col("b")]).collect()
    assert [(x["a"], x["b"]) for x in sorted(got, key=lambda x: x["number"])] == sorted(rows, key=lambda x: (-x[0], x[1])) and sorted(x["number"] for x in got) == list(range(1, 701))
    assert records.numbered(spark.createDataFrame([], "a long"), [F.col("a")]).count() == 0


def test_reports_of_nothing(spark):
    from furrow.operators import records

    none = spark.createDataFrame([], "k string, v double, m map<string,int>")
    assert tuple(records.totals(none, {"n": "k"}, {"c": F.col("v") > 1}, {"v": ("lo", "hi")}).first()) == (0, 0, 0, None, None)
    assert records.group_sizes(none, ["k"]).count() == 0 and records.key_union(none, "m").first()["keys"] == []
    some = spark.createDataFrame([({"b": 1, "a": 2},), (None,), ({"c": 1},)], "m map<string,int>")
    assert records.key_union(some, "m").first()["keys"] == ["a", "b", "c"]
