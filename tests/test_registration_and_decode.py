from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.operators import decode, registration

LIMITS = {"min_mutual_matches": 12, "min_inliers": 8, "min_inlier_ratio": 0.4, "max_p95_reprojection": 4.0, "min_scale": 0.92, "max_scale": 1.08, "max_rotation_deg": 5.0}


def matched(r: random.Random, g: int, scale: float, degrees: float, tx: float, ty: float, n: int = 80, wrong: float = 0.4, noise: float = 0.0) -> list[tuple]:
    a, b = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    rows = []
    for i in range(n):
        x, y = r.uniform(0, 900), r.uniform(0, 600)
        u, v = a * x - b * y + tx + r.gauss(0, noise), b * x + a * y + ty + r.gauss(0, noise)
        if i < wrong * n:
            u, v = r.uniform(0, 900), r.uniform(0, 600)
        rows.append((g, x, y, u, v))
    return rows


MATCHES = "g long, x double, y double, u double, v double"


def test_planted_similarities_are_recovered(spark):
    r = random.Random(5)
    planted = {g: (r.uniform(0.9, 1.1), r.uniform(-20, 20), r.uniform(-50, 50), r.uniform(-50, 50)) for g in range(12)}
    rows = [x for g, p in planted.items() for x in matched(r, g, *p)]
    rows += [(20, 1.0, 1.0, 2.0, 2.0)] * 5 + [(21, 1.0, 1.0, 2.0, 2.0), (22, None, 1.0, 2.0, 2.0), (22, 3.0, float("nan"), 2.0, 2.0)]
    got = {x["g"]: x for x in registration.estimated(spark.createDataFrame(rows, MATCHES).repartition(5), ["g"]).collect()}
    assert sorted(got) == [*range(12), 20, 21] and got[20]["matrix"] is None and got[21]["match_count"] == 1 and got[21]["inlier_count"] == 0
    for g, (scale, degrees, tx, ty) in planted.items():
        x = got[g]
        assert (x["scale"], x["rotation_deg"], x["translation_x"], x["translation_y"]) == pytest.approx((scale, degrees, tx, ty), abs=0.05)
        assert x["match_count"] == 80 and 48 <= x["inlier_count"] <= 52 and x["reprojection_error_p95"] < 3 and x["determinant"] == pytest.approx(scale**2, abs=1e-3)


def test_the_fit_is_least_squares_over_the_inliers(spark):
    r = random.Random(9)
    rows = matched(r, 1, 1.02, 3.0, 12.0, -7.0, noise=0.4)
    m = registration.estimated(spark.createDataFrame(rows, MATCHES), ["g"], rounds=8).first()
    matrix = np.array(m["matrix"]).reshape(3, 3)
    p, q = np.array([x[1:3] for x in rows]), np.array([x[3:] for x in rows])
    near = np.linalg.norm(p @ matrix[:2, :2].T + matrix[:2, 2] - q, axis=1) <= 3.0
    design = np.vstack([np.column_stack([p[near, 0], -p[near, 1], np.ones(near.sum()), np.zeros(near.sum())]), np.column_stack([p[near, 1], p[near, 0], np.zeros(near.sum()), np.ones(near.sum())])])
    a, b, tx, ty = np.linalg.lstsq(design, np.concatenate([q[near, 0], q[near, 1]]), rcond=None)[0]
    assert matrix.ravel().tolist() == pytest.approx([a, -b, tx, b, a, ty, 0, 0, 1], abs=1e-6) and m["inlier_count"] == near.sum()
    errors = np.linalg.norm(p[near] @ matrix[:2, :2].T + matrix[:2, 2] - q[near], axis=1)
    assert (m["reprojection_error_p50"], m["reprojection_error_p95"]) == pytest.approx((np.median(errors), np.quantile(errors, 0.95)))


def test_registered_frames_lead_to_their_map(spark):
    r = random.Random(3)
    rows, maps = [], {}
    for flight in (1, 2):
        m, segment = np.eye(3), 0
        maps[flight, 0] = (0, m)
        for k in range(1, 6):
            scale, degrees, tx, ty = (1.0, 1.5, 14.0 * k, -6.0)
            if (flight, k) == (2, 3):
                segment, m = 1, np.eye(3)
            else:
                a, b = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
                m = m @ np.linalg.inv(np.array([[a, -b, 2 * tx], [b, a, 2 * ty], [0, 0, 1]]))
                rows += [(flight, k, *x[1:]) for x in matched(r, 0, scale, degrees, tx, ty, n=60)]
            maps[flight, k] = (segment, m)
    frames = spark.createDataFrame([(*k,) for k in maps], "flight long, frame_index long")
    matches = spark.createDataFrame(rows, "flight long, frame_index long, x double, y double, u double, v double")
    got = registration.registered(frames, matches, ["flight"], LIMITS, preview=(0.5, 0.5)).collect()
    assert len(got) == len(maps)
    for x in got:
        segment, m = maps[x["flight"], x["frame_index"]]
        assert x["chain_segment"] == segment and x["chain"] == pytest.approx(m.ravel().tolist(), abs=0.3)
    assert {x["gate_reasons"] for x in got if (x["flight"], x["frame_index"]) == (2, 3)} == {"insufficient_correspondences"}


def test_no_matches(spark):
    assert registration.estimated(spark.createDataFrame([], MATCHES), ["g"]).count() == 0


def test_utm_round_trip_under_a_millimetre(spark):
    rows = [(lat / 1.0, lon + off) for lat in (-79, -45, -1, 0, 12, 47, 60, 83) for lon in (-177.0, -3.0, 9.0, 177.0) for off in (-2.9, 0.0, 1.3, 2.9)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    east, north = geometry.to_utm(F.col("lat"), F.col("lon"))
    held = df.withColumns({"e": east, "n": north, "zone": geometry.utm_zone(F.col("lon"))})
    lat, lon = geometry.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    for x in held.withColumns({"lat2": lat, "lon2": lon}).collect():
        assert abs(x["lat2"] - x["lat"]) * 111_320 < 1e-3 and abs(x["lon2"] - x["lon"]) * 111_320 * math.cos(math.radians(x["lat"])) < 1e-3, x


def test_rescaled_transforms(spark):
    m = np.array([[1.1, 0.2, 5.0], [-0.1, 0.9, 7.0], [0.0, 0.0, 1.0]])
    got = spark.range(1).select(F.array(*geometry.rescaled([F.lit(float(v)) for v in m.ravel()], 0.5, 0.25)).alias("m")).first()["m"]
    s = np.diag([0.5, 0.25, 1.0])
    assert got == pytest.approx((np.linalg.inv(s) @ m @ s).ravel().tolist())


OUT = "frame_index long, output array<array<double>>"
METAS = "frame_index long, scale double, pad_left double, pad_top double, width double, height double"


def test_detections_from_either_layout(spark):
    """Two overlapping boxes of one class in a 200 x 100 frame that was fitted into 100 x 100."""
    tall = [[50.0, 51.0], [40.0, 41.0], [20.0, 20.0], [10.0, 10.0], [0.9, 0.8]]
    wide = [list(x) for x in zip(*tall, strict=True)]
    outputs = spark.createDataFrame([(1, tall), (2, wide), (3, None), (4, [[], [], [], [], []]), (5, [[50.0], [40.0], [20.0], [10.0], [float("nan")]])], OUT)
    metas = spark.createDataFrame([(i, 0.5, 0.0, 25.0, 200.0, 100.0) for i in range(1, 6)], METAS)
    got = decode.detections(outputs, metas, ["plant"]).orderBy("frame_index").collect()
    assert [(x["frame_index"], x["class_name"], x["confidence"], x["x1"], x["y1"], x["x2"], x["y2"]) for x in got] == [(1, "plant", 0.9, 80.0, 20.0, 120.0, 40.0), (2, "plant", 0.9, 80.0, 20.0, 120.0, 40.0)]
    same = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 200.0, 100.0)], METAS)
    first = decode.detections(outputs.where("frame_index = 1"), same, ["plant"]).first()
    assert (first["x1"], first["y1"], first["x2"], first["y2"]) == (40.0, 35.0, 60.0, 45.0)


def test_detections_of_several_classes(spark):
    """Suppression heeds classes; the threshold, the number and the frame's border count."""
    wide = [[5, 5, 10, 10, 0.9, 0.0], [6, 6, 10, 10, 0.8, 0.1], [6, 6, 10, 10, 0.1, 0.7], [50, 50, 4, 4, 0.2, 0.24], [-20, 5, 10, 10, 0.6, 0.0]]
    outputs = spark.createDataFrame([(1, [[float(v) for v in r] for r in wide])], OUT)
    metas = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 100.0, 100.0)], METAS)
    got = decode.detections(outputs, metas, ["a", "b"], overlap=0.1).orderBy("detection_id").collect()
    assert [(x["detection_id"], x["class_name"]) for x in got] == [(0, "a"), (2, "b")]
    assert [x["detection_id"] for x in decode.detections(outputs, metas, ["a", "b"], overlap=0.1, most=1).collect()] == [0]


def test_another_shape_is_an_error(spark):
    outputs = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])], OUT)
    with pytest.raises(Exception, match="isn't xywh"):
        decode.detections(outputs, spark.createDataFrame([(1, 1.0, 0.0, 0.0, 9.0, 9.0)], METAS), ["a"]).collect()


def test_segments_equal_the_product(spark):
    r = np.random.default_rng(4)
    k, n, h, w = 4, 6, 5, 7
    boxes = np.array([[20 * i, 10, 8, 8, 0.9 if i % 3 else 0.1] for i in range(n)], float)
    coefficients, protos = r.normal(size=(n, k)).round(2), r.normal(size=(k, h, w)).round(2)
    output = np.hstack([boxes, coefficients])
    want = {(x, y) for y in range(h) for x in range(w) if max(float(coefficients[i] @ protos[:, y, x]) for i in range(n) if i % 3) >= 0}
    pixels = spark.createDataFrame([(1, x, y, protos[:, y, x].tolist()) for y in range(h) for x in range(w)], "frame_index long, px long, py long, p array<double>")
    got = decode.segments(spark.createDataFrame([(1, output.T.tolist())], OUT), pixels, coefficients=k)
    assert {(x["px"], x["py"]) for x in got.collect()} == want and 0 < len(want) < h * w
    metas = spark.createDataFrame([(1, 0.5, 4.0, 0.0, 40.0, 30.0)], METAS)
    full = {(x["px"], x["py"]) for x in decode.to_frame(got, metas, 4.0).collect()}
    assert full == {(x, y) for x in range(40) for y in range(30) if (math.floor(((x + 0.5) * 0.5 + 4) / 4), math.floor((y + 0.5) * 0.5 / 4)) in want}
